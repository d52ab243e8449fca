"""Deterministic paths of answering: intent, follow-ups, critic, claims, verification, confidence."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Patterns that tell small talk and questions about files.
GREETINGS = (
    r"^(hi|hello|hey|greetings|howdy|sup|yo|hi\s+there|hello\s+there)\b",
    r"^(good\s+(morning|afternoon|evening|day|night))\b",
    r"^(how\s+are\s+you|how\s+are\s+you\s+doing|how's\s+it\s+going|hows\s+it\s+going|what's\s+up|whats\s+up)\b",
    r"^(who\s+are\s+you|what\s+is\s+your\s+name|what\s+can\s+you\s+do|introduce\s+yourself|help\s+me)\b",
    r"^(thanks|thank\s+you|thank\s+you\s+very\s+much|thanks\s+a\s+lot|bye|goodbye|see\s+you)\b",
)
FILE_WORDS = (
    r"\b(pdf|docx?|txt|markdown|document|documents|file|files|upload|uploaded|schematic|diagram|blueprint)\b",
    r"\b(video|audio|recording|transcript|presentation|keyframe|slide|slides|page\s+\d+|table\s+\d+)\b",
    r"\b(in\s+the\s+file|in\s+the\s+document|in\s+the\s+pdf|from\s+the\s+data|according\s+to\s+the|based\s+on\s+the\s+file)\b",
)
# Patterns of a question that leans on the turns before it.
FOLLOWUPS = (
    r"^(what|how)\s+about\b",
    r"^and\s+(for|what|how|who|where|why)\b",
    r"^(who|what|where|when|why|how)\s+(is|are|was|were|do|does|did)\s+(the|their|its|it|they|this|that)\b",
    r"\b(it|they|them|their|its|this|that|these|those)\b",
    r"^who\s+is\s+(the\s+)?(advisor|faculty|head|lead|coordinator)\b",
    r"^(tell me more|elaborate|explain more|more details)\b",
    r"^same\s+for\b",
    r"^(and\s+)?(for\s+)?[a-zA-Z\s]{1,25}\?*$",
)
# Words of asking that need not occur in a passage.
INQUIRY = "work mean happen tell give look know run use get find seem occur appear take make need want see show say call come state exist i ii iii iv v".split()


# What is said around a word that no passage holds.
ASPECT = ("Specific documentation on '", "'")
# How a sentence or an item before a claim ends, and the shares of words that ground a claim.
BOUNDARY = r"(?:[.?!] |\.\n|\n\n|\n[-*] )"
IN_PASSAGE, IN_SENTENCE = 0.30, 0.25
#: Places of tokens by sentences that are in memory at once, about; what is told of a claim; what a token can lie in.
CELLS, MET, _RUN = 1 << 24, ("n", "in_text", "in_sentence", "at"), re.compile("[a-z0-9_]+")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def n_words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def intent(query: Column) -> Column:
    """CASUAL, CORPUS_QUERY or GENERAL_KNOWLEDGE."""
    q = F.lower(F.btrim(query))
    files = any_of(q, FILE_WORDS)
    return F.when(any_of(q, GREETINGS) & ~files, "CASUAL").when(files, "CORPUS_QUERY").otherwise("GENERAL_KNOWLEDGE")


def intent_in_session(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, intent, target_filename, conversational) of (query_id, conversation_id, query).

    files: (conversation_id, filename, at). A question that names a file of its session (names of over three characters) is
    about the files as well; the target is the session's first file. Small talk of up to six words is conversational at once.
    """
    per = files.groupBy("conversation_id").agg(F.min_by("filename", "at").alias("first_name"))
    low = F.lower(F.col("query"))
    named = queries.join(files.where(F.length("filename") > 3).select("conversation_id", "filename"), "conversation_id").where(F.contains(low, F.lower("filename"))).select("query_id").distinct().withColumn("named", F.lit(True))
    kind = intent(F.col("query"))
    kind = F.when((kind == "GENERAL_KNOWLEDGE") & F.coalesce("named", F.lit(False)), "CORPUS_QUERY").otherwise(kind)
    rows = queries.join(per, "conversation_id", "left").join(named, "query_id", "left").withColumn("intent", kind)
    return rows.select("query_id", "intent", F.when(F.col("intent") == "CORPUS_QUERY", F.col("first_name")).alias("target_filename"), (small_talk(F.col("query")) | (F.col("intent") != "CORPUS_QUERY")).alias("conversational"))


def small_talk(query: Column) -> Column:
    """A greeting of six words at most."""
    return any_of(F.lower(F.btrim(query)), GREETINGS) & (n_words(query) <= 6)


# What is said to a greeting, and where no model answers.
GREETED = "Hello! How can I help you today? Feel free to ask any questions about your documents, general science, coding, or explore your data."


def conversational_answer(query: Column, n_turns: Column, said: Column, otherwise: str) -> Column:
    """The answer to small talk: a fixed greeting at the start of a session, else what a model said, else a fixed sentence."""
    said = F.btrim(said)
    return F.when(small_talk(query) & (F.coalesce(n_turns, F.lit(0)) <= 1), GREETED).otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit(otherwise)))


def is_followup(query: Column) -> Column:
    return any_of(F.lower(query), FOLLOWUPS) | (n_words(query) <= 4)


def contextualized(turns: DataFrame) -> DataFrame:
    """User turns (conversation_id, turn, role, text) with standalone: the query with the last user turn in front.

    A turn without earlier user turn, or of over 10 words that is no follow-up, stays.
    """
    order = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order)
    rows = turns.withColumn("last_user", last).where("role = 'user'")
    clean = F.btrim(F.regexp_replace("last_user", r"[^\w\s]", ""))
    subject = F.btrim(F.regexp_extract(F.lower("text"), r"(?:what|how)\s+about\s+([a-zA-Z\s]+)", 1))
    merged = F.concat(clean, F.lit(" "), F.when(subject != "", subject).otherwise(F.col("text")))
    stays = F.col("last_user").isNull() | (F.col("last_user") == "") | ((n_words(F.col("text")) > 10) & ~is_followup(F.col("text")))
    return rows.select("conversation_id", "turn", F.when(stays, F.col("text")).otherwise(merged).alias("standalone"))


def graded(answers: DataFrame) -> DataFrame:
    """Critic of (query_id, query, passages text, top_score): coverage, confidence, should_retry, missing."""
    asked = T.tokens(F.col("query"), drop_stopwords=True)
    held = T.tokens(F.col("passages"), drop_stopwords=True)
    lacks = T.let(F.struct(asked.alias("asked"), F.array_distinct(held).alias("held")), lambda x: F.struct(x["asked"].alias("asked"), F.filter(x["asked"], lambda w: ~F.array_contains(x["held"], w)).alias("missing")))
    rows = answers.withColumn("lacks", lacks).withColumns({"asked": F.col("lacks.asked"), "missing": F.col("lacks.missing")})
    rows = rows.withColumn("coverage", F.round((F.size("asked") - F.size("missing")) / F.greatest(F.size("asked"), F.lit(1)), 6))
    key = F.filter("missing", lambda w: ~w.isin(INQUIRY) & (F.length(w) > 2))
    c = F.col("coverage")
    level = F.when(F.size("asked") == 0, "medium").when(F.size(key) > 0, F.when(c >= 0.5, "medium").otherwise("low")).when((c >= 0.75) & (F.col("top_score") >= 0.5), "high").when(c >= 0.3, "medium").otherwise("low")
    rows = rows.withColumn("confidence", level)
    # what to ask for: documentation on the substantive words that lack, else all words that lack
    named = F.array_join(F.transform(key, lambda w: F.concat(F.lit(ASPECT[0]), w, F.lit(ASPECT[1]))), " ")
    aspects = F.when(F.size(key) > 0, named).when(F.col("confidence") == "high", "").otherwise(F.array_join("missing", " "))
    return rows.select("query_id", "coverage", "confidence", (F.col("confidence") == "low").alias("should_retry"), aspects.alias("missing"))


def reformulated(query: Column, missing: Column) -> Column:
    """The query without odd characters, and the missing words behind it."""
    return F.btrim(F.concat_ws(" ", F.regexp_replace(query, r"[^A-Za-z0-9_\s./-]", ""), missing))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, passage_number, claim) for each [n] of (answer_id, answer).

    The text before each marker, back to the last sentence or bullet boundary, or else 200 characters.
    """
    marks = F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(0))
    rows = answers.select("answer_id", marks.alias("marks"), F.split("answer", r"\[\d+\]", -1).alias("gaps"))
    # the text since the marker before holds the boundary nearly always; only where it does not, all that stands before is joined
    gaps = F.transform("marks", lambda m, i: F.struct(m.alias("mark"), F.regexp_replace(F.get("gaps", i), r"\s+$", "").alias("own")))
    joined = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.when(i > 0, F.get("marks", i - 1)).otherwise(""), F.get("gaps", i))), "")
    parts = F.transform(gaps, lambda g, i: F.struct(g["mark"].alias("mark"), F.when(g["own"].rlike(BOUNDARY), g["own"]).otherwise(F.regexp_replace(joined(i), r"^\s+|\s+$", "")).alias("before")))
    rows = rows.select("answer_id", F.posexplode(parts).alias("claim_no", "p")).select("answer_id", "claim_no", F.regexp_extract("p.mark", r"\d+", 0).cast("int").alias("passage_number"), "p.before")
    tail = F.regexp_replace("before", "(?s)^.*" + BOUNDARY, "")
    claim = F.when(tail == F.col("before"), F.right("before", F.lit(200))).otherwise(tail)
    claim = F.btrim(F.regexp_replace(claim, r"\[\d+\]", ""), F.lit(" \n\t\r"))
    claim = F.btrim(F.btrim(F.regexp_replace(claim, r"^(?:[-*•]|\d+\.)\s+", "")), F.lit("\"'"))
    return rows.select("answer_id", "claim_no", "passage_number", F.when(claim == "", F.btrim(F.right("before", F.lit(150)))).otherwise(claim).alias("claim"))


def verified(claimed: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims joined to (answer_id, passage_number, text, and what names the source): grounded, status, evidence.

    A word counts where it occurs anywhere in the passage. The evidence is the first sentence with most of the claim's
    words, or else the passage's first 200 characters; a stamp in it takes the place of the passage's ``timestamp``. A
    missing passage is unsupported and has no evidence. Other columns of the passages stay.

    The claims on a passage meet it in one row, so its text is divided once and not for each claim.
    """
    more = [c for c in passages.columns if c not in ("answer_id", "passage_number", "text", "timestamp")]
    stamp = F.col("timestamp") if "timestamp" in passages.columns else F.lit(None).cast("string")
    per = claimed.groupBy("answer_id", "passage_number").agg(F.collect_list(F.struct("claim_no", "claim", T.separated(F.col("claim")).alias("said"))).alias("claims"))
    rows = per.join(passages, ["answer_id", "passage_number"], "left").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    rows = rows.withColumn("sentences", F.transform(F.split("text", r"(?<=[.!?\n])\s+"), lambda s: F.btrim(s)))
    found = F.arrow_udf(_met, f"array<struct<{','.join(f'{c}:int' for c in MET)}>>")
    rows = rows.withColumn("met", found(F.col("claims.said"), F.transform("sentences", lambda s: F.lower(s)), F.transform("sentences", lambda s: F.length(s) > 10)))
    # of the texts, only what a claim quotes goes on
    quoted = F.transform("met", lambda m: F.get("sentences", F.nullif(m["at"], F.lit(-1))))
    rows = rows.withColumns({"quoted": quoted, "start": F.left("text", F.lit(200)), "there": F.col("text").isNotNull()})
    pair = F.explode(F.arrays_zip(F.col("claims"), F.col("met"), F.col("quoted"))).alias("c")
    rows = rows.select("answer_id", "passage_number", "start", "there", stamp.alias("timestamp"), *more, pair).select("*", "c.claims.claim_no", "c.claims.claim", "c.met", "c.quoted")
    share = lambda c: F.when(F.col("met.n") == 0, 1.0).otherwise(F.col(c) / F.col("met.n"))
    score = F.when(F.col("met.at") >= 0, share("met.in_sentence")).otherwise(0.0)
    rows = rows.withColumn("is_grounded", F.when(~F.col("there"), False).otherwise((F.col("met.n") == 0) | (share("met.in_text") >= IN_PASSAGE) | (score >= IN_SENTENCE)))
    quote = F.when(score > 0, F.col("quoted")).otherwise(F.col("start"))
    quote = F.btrim(F.regexp_replace(F.regexp_replace(quote, r"^\s+|\s+$", ""), r"^(?:[-*•]|\d+\.)\s+", ""), F.lit("\"'"))
    rows = rows.withColumn("evidence", F.coalesce(quote, F.lit("")))
    status = F.when(F.col("is_grounded"), "VERIFIED").otherwise("UNSUPPORTED")
    return rows.select("answer_id", "claim_no", "passage_number", "claim", "is_grounded", status.alias("status"), "evidence", F.coalesce(T.evidence_span(F.col("evidence")), F.col("timestamp")).alias("timestamp"), *more)


def _met(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For each claim of a row (claims as texts of :func:`T.separated`, the passage's lower-case sentences, whether a sentence can be evidence): how many words it has,
    how many occur in the passage, how many in the first sentence that holds most, and that sentence's place or -1."""
    for said, sentences, usable in batches:
        found = [_held(c or [], s or [], np.flatnonzero(u or [])) for c, s, u in zip(said.to_pylist(), sentences.to_pylist(), usable.to_pylist())]
        columns = [np.concatenate([np.zeros(0, np.int32), *c]).astype(np.int32) for c in zip(*found)]
        ends = np.cumsum([0, *(len(c[0]) for c in found)]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in columns], list(MET)))


@functools.lru_cache(1 << 16)
def _words(word: str) -> tuple[str, ...]:
    """The tokens of a word of a claim that count."""
    tokens = T.tokens_of(word)
    return tuple(t for t in tokens if len(t) > 2) if tokens and tokens[0] not in T.STOPWORD_SET else ()


def _held(said: list[str], sentences: list[str], usable: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words, those in the text, those in the best sentence, its place or -1) of each claim.

    A token is ASCII letters, digits and ``_``, so where it occurs it lies inside a run of these. Each different token is looked for once, in the passage's different runs.
    """
    claims = [[t for w in c.split(" ") for t in _words(w)] for c in said]
    n = np.array([len(c) for c in claims], np.int64)
    at = np.full(len(claims), usable[0] if len(usable) else -1, np.int64)
    in_text, best = np.zeros_like(n), np.zeros_like(n)
    words = [_RUN.findall(s) for s in sentences]
    runs = {r: k for k, r in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
    tokens: dict[str, int] = {}
    flat = np.array([tokens.setdefault(t, len(tokens)) for c in claims for t in c], np.int64)
    if not len(flat) or not runs:
        return n, in_text, best, at
    joined = "\n".join(runs)
    ends = np.cumsum([len(r) + 1 for r in runs])
    token, place = [], []
    for t, k in tokens.items():
        p = joined.find(t)
        while p >= 0:
            token.append(k)
            place.append(p)
            p = joined.find(t, p + 1)
    if not token:
        return n, in_text, best, at
    run = np.searchsorted(ends, place, "right")
    token = np.array(token)
    known = np.unique(token)
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    in_text[some] = np.add.reduceat(np.isin(flat, known), first, dtype=np.int64)
    starts = np.searchsorted(token, known)  # tokens were looked for in order
    wide = max(1, CELLS // (len(runs) + len(run) + len(tokens) + 5 * len(flat)))
    for k in range(0, len(usable), wide):
        part = usable[k : k + wide]
        own = [words[i] for i in part.tolist()]
        there = np.zeros((len(runs), len(part)), bool)
        there[[runs[r] for w in own for r in w], np.repeat(np.arange(len(part)), [len(w) for w in own])] = True
        held = np.zeros((len(tokens), len(part)), bool)
        held[known] = np.logical_or.reduceat(there[run], starts)
        counts = np.add.reduceat(held[flat], first, dtype=np.int32)
        most = counts.max(axis=1)
        better = most > best[some]
        at[some[better]] = part[counts.argmax(axis=1)[better]]
        best[some[better]] = most[better]
    return n, in_text, best, at


def groundedness(checked: DataFrame) -> DataFrame:
    return checked.groupBy("answer_id").agg(F.round(F.avg(F.col("is_grounded").cast("int")), 2).alias("groundedness"), F.count("*").alias("n_claims"))


def final_confidence(score: Column, n_claims: Column, critic: Column) -> Column:
    return F.when((score >= 0.75) & (n_claims > 0), "high").when(score >= 0.40, "medium").otherwise(critic)


def windows(hits: DataFrame, size: int = 4) -> DataFrame:
    """Adds start, score and excerpt to (query, text, ...): the ``size`` lines that hold most of the query's words.

    Lines of up to three characters do not count; the first best window wins; texts without lines go. Each line
    is tokenised once and reduced to the query's words.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: F.length(x) > 3)
    asked = F.array_distinct(T.tokens(F.col("query"), drop_stopwords=True))
    rows = hits.withColumn("_lines", lines).where(F.size("_lines") > 0)
    rows = rows.withColumn("_held", T.let(asked, lambda a: F.transform("_lines", lambda x: F.array_intersect(a, T.tokens(x, drop_stopwords=True)))))
    score = lambda i: F.size(F.array_distinct(F.flatten(F.slice("_held", i + 1, size))))
    scored = F.transform("_held", lambda _, i: F.struct(score(i).alias("score"), (-i).alias("back")))
    rows = rows.withColumn("_best", F.array_max(scored)).withColumn("start", -F.col("_best")["back"])
    return rows.withColumns({"score": F.col("_best")["score"], "excerpt": F.array_join(F.slice("_lines", F.col("start") + 1, F.lit(size)), "\n")}).drop("_lines", "_held", "_best")


def names_entity(text: Column, entity: Column) -> Column:
    """The text holds the entity, as it is or without punctuation, or holds its digits if there are four or more."""
    t, e = F.lower(F.btrim(text)), F.lower(F.btrim(entity))
    bare = lambda c: F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    return (e != "") & (F.contains(t, e) | ((F.length(bare(e)) >= 2) & F.contains(bare(t), bare(e))) | ((F.length(digits(e)) >= 4) & F.contains(digits(t), digits(e))))


def relevant_hops(hops: DataFrame, texts: DataFrame) -> DataFrame:
    """Hops (answer_id, seq, from_node, relation, to_node) that the answer of (answer_id, query, answer) tells of.

    The source is in the query or the answer and the target in the answer; mirrors go; the first of a pair of nodes stays.
    """
    rows = hops.where("from_node <> '' and to_node <> '' and relation <> ''").where(~F.startswith("relation", F.lit("INVERSE_"))).join(texts, "answer_id")
    both = F.concat_ws(" \n ", "query", "answer")
    rows = rows.where(names_entity(both, F.col("from_node")) & names_entity(F.col("answer"), F.col("to_node")))
    pair = F.array_sort(F.array(F.lower(F.btrim("from_node")), F.lower(F.btrim("to_node"))))
    first = rows.groupBy("answer_id", pair.alias("_pair")).agg(F.min_by(F.struct("seq", "from_node", "relation", "to_node"), "seq").alias("h"))
    return first.select("answer_id", "h.*")


def relevant_entities(hops: DataFrame, texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(answer_id, entity, place) of the ends of relevant hops (answer_id, seq, from_node, to_node) that the answer or the query names.

    entities: (answer_id, entity, at), those of the graph in order. Ends that only the query names come first; then graph
    entities, then other ends by name, as far as the answer names them.
    """
    part = hops.select("answer_id", F.explode(F.array("from_node", "to_node")).alias("entity")).distinct()
    known = entities.groupBy("answer_id", F.btrim("entity").alias("entity")).agg(F.min("at").alias("at"))
    rows = part.join(known, ["answer_id", "entity"], "left").join(texts, "answer_id")
    told, asked = names_entity(F.col("answer"), F.col("entity")), names_entity(F.col("query"), F.col("entity"))
    rows = rows.where(told | asked).withColumn("front", F.when(told, 1).otherwise(0))
    order = Window.partitionBy("answer_id").orderBy("front", F.asc_nulls_last("at"), "entity")
    return rows.select("answer_id", "entity", F.row_number().over(order).alias("place"))
