"""Answers from retrieved passages, end to end, and the texts around them: stamps, excerpts, narratives, histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

from . import synthesis

# What an answer says without sources, without the topic, and with a part missing.
NO_SOURCES = "Based on the provided documents, there is insufficient evidence to answer this question as no relevant source materials were found."
OFF_TOPIC = "Based on the provided documents, there is insufficient evidence to answer this question as the source materials do not contain information on this topic."
PARTIAL = ("The provided documentation does not explicitly state what happens regarding ", ". While related behavior is documented below, the exact interaction is not defined in the source materials:\n\n")
# Stamps that stand for an unknown time.
UNKNOWN_STAMPS = ("00:00 - 00:01", "00:00")
# Extensions of the viewer, more than uploads allow.
VIEWED = {"pdf": r"\.pdf$", "image": r"\.(png|jpe?g|webp|gif|svg|bmp)$", "audio": r"\.(mp3|wav|ogg|m4a|aac|flac)$", "video": r"\.(mp4|webm|mov|mkv|avi)$"}
HOPS_TOLD, TURN_CHARS = 15, 300
# The heading, the lines and the signs of a narrative of hops.
HEADING = ("### 🕸️ Knowledge Graph Relations (", " relation hops):", " relation hop):")
HOP_LINE = ("  • Rel ", ": ", " (", ") ➔ ", " ➔ ", " (", ")\n    - Source: [", ']\n    - Evidence: "', '"')
MONEY_SIGN, PAGE_SIGN, STAMP_SIGN = "💰 ", "📄 Page ", "⏱️ "


def effective_stamp(evidence: Column, fallback: Column) -> Column:
    """The evidence's span, else the fallback; an empty fallback is null. Placeholders count when there is nothing else."""
    return F.coalesce(T.evidence_span(evidence), F.nullif(fallback, F.lit("")))


def stamp_excerpt(text: Column, stamp: Column, before: int = 80, after: int = 400) -> Column:
    """The text around a stamp's first place, with dots at both ends; null where it does not occur."""
    at = F.when(stamp != "", F.instr(text, stamp) - 1)
    start = F.greatest(F.lit(0), at - before)
    return F.when(at >= 0, F.concat(F.lit("... "), F.btrim(F.substr(text, start + 1, at + after - start), F.lit(" \t\r\n")), F.lit(" ...")))


def viewed_as(filename: Column) -> Column:
    """How a viewer shows a file of this name; document where nothing else fits."""
    name, out = F.lower(filename), F
    for kind, pattern in VIEWED.items():
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise("document")


def unmarked(text: Column) -> Column:
    """The text without markdown marks: notes, emphasis, headings; links become their text, blanks single."""
    x = F.regexp_replace(text, r"(?i)\*\(note:[^)]*\)\*", "")
    for pair in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"__([^_]+)__", r"_{1,2}([^_]+)_{1,2}"):
        x = F.regexp_replace(x, pair, "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"#{1,6}\s*", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.btrim(F.regexp_replace(x, r"\s{2,}", " "), F.lit(" \t\r\n"))


# Signs of mathematical notation and their plain forms.
SIGNS = {"times": "×", "div": "÷", "pm": "±", "approx": "≈", "ge": "≥", "le": "≤", "cdot": "·", "neq": "≠", "rightarrow": "→", "leftarrow": "←"}


def plain_math(text: Column) -> Column:
    """Mathematical notation as plain text: no dollar signs around it, signs for commands, fractions with a stroke, no braces."""
    x = F.regexp_replace(F.btrim(text), r"^\$+|\$+$", "")
    x = F.regexp_replace(F.regexp_replace(F.btrim(x), r"\\text\{([^}]+)\}", "$1"), r"\\\$", r"\$")
    for name, sign in SIGNS.items():
        x = F.replace(x, F.lit("\\" + name), F.lit(sign))
    x = F.regexp_replace(x, r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1 / $2)")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"\\left|\\right", ""), "[{}]", ""))


def preview(text: Column, most: int = 150) -> Column:
    """The first characters of an answer, with dots where it goes on."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def told_once(hops: DataFrame) -> DataFrame:
    """The first hop (query_id, hop_no, source, relation, target) of each source, relation and target without regard to case."""
    keys = [F.lower(c).alias(f"_{c}") for c in ("source", "relation", "target")]
    first = hops.groupBy("query_id", *keys).agg(F.min_by(F.struct("hop_no", "source", "relation", "target"), "hop_no").alias("h"))
    return first.select("query_id", "h.*")


def cited(markers: DataFrame, checked: DataFrame) -> DataFrame:
    """(answer_id, occurrence, passage_number, claim_no): the verified claim that a marker of the shown answer stands for.

    markers: (answer_id, occurrence, passage_number, said), ``said`` the text before it; checked: (answer_id, claim_no,
    passage_number, claim). Of a passage's claims the one that shares most words with ``said``, the first of equals; where none
    shares any, the claim of the marker's own place if it cites the passage.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    pairs = markers.join(checked.select("answer_id", "passage_number", "claim_no", "claim"), ["answer_id", "passage_number"])
    shared = T.let(words(F.col("said")), lambda a: F.size(F.filter(words(F.coalesce("claim", F.lit(""))), lambda w: F.array_contains(a, w))))
    own = F.when((shared == 0) & (F.col("claim_no") == F.col("occurrence")), 1).otherwise(0)
    best = pairs.groupBy("answer_id", "occurrence", "passage_number").agg(F.max(F.struct(shared.alias("n"), own.alias("own"), (-F.col("claim_no")).alias("back"))).alias("b"))
    return best.select("answer_id", "occurrence", "passage_number", (-F.col("b.back")).alias("claim_no"))


def json_text(raw: Column) -> Column:
    """A model's reply as valid JSON: its code fence removed; cut-off lists closed after the last object; else {}."""
    bare = F.btrim(raw, F.lit(" \t\r\n"))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    whole = F.regexp_extract(bare, r"(?s)^(.*\})", 1)
    closed = F.when(whole != "", F.concat(whole, F.lit("\n  ]\n}")))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(bare), valid(closed), F.lit("{}"))


def history_text(messages: DataFrame, last: int = 4) -> DataFrame:
    """(conversation_id, history): the last turns as ``User: ...`` and ``Assistant: ...`` lines, long assistant turns cut."""
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("_n", n).where(F.col("_n") <= last)
    user = F.col("role") == "user"
    said = F.btrim(F.coalesce("text", F.lit("")))
    said = F.when(~user & (F.length(said) > TURN_CHARS), F.concat(F.left(said, F.lit(TURN_CHARS)), F.lit("..."))).otherwise(said)
    line = F.concat(F.when(user, "User: ").otherwise("Assistant: "), said)
    listed = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("history"))


def narrative(hops: DataFrame, told: int = HOPS_TOLD) -> DataFrame:
    """(query_id, n_hops, narrative) of hops (query_id, hop_no, from_node, from_type, relation, to_node, to_type, filename,
    evidence, amount, currency, page_number, timestamp): a heading and the first ``told`` hops, each with its source."""
    near = hops.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("hop_no")))
    money = F.concat(F.lit(MONEY_SIGN), F.when(F.coalesce("currency", F.lit("USD")) == "USD", "$").otherwise(F.concat("currency", F.lit(" "))), F.format_number("amount", 0), F.lit(" "), F.coalesce("currency", F.lit("USD")))
    place = F.concat_ws(" | ", "filename", F.when(F.col("amount") != 0, money), F.concat(F.lit(PAGE_SIGN), F.nullif("page_number", F.lit(0)).cast("string")), F.concat(F.lit(STAMP_SIGN), F.nullif("timestamp", F.lit(""))))
    bold = lambda c: F.concat(F.lit("**"), F.col(c), F.lit("**"))
    named = [F.col("_n").cast("string"), bold("from_node"), F.col("from_type"), bold("relation"), bold("to_node"), F.col("to_type"), place, F.col("evidence")]
    line = F.concat(*[x for text, name in zip(HOP_LINE, named) for x in (F.lit(text), name)], F.lit(HOP_LINE[-1]))
    listed = F.array_sort(F.collect_list(F.when(F.col("_n") <= told, F.struct("_n", line.alias("line")))))
    per = near.groupBy("query_id").agg(F.count("*").alias("n_hops"), listed.alias("_lines"))
    head = F.concat(F.lit(HEADING[0]), F.col("n_hops").cast("string"), F.when(F.col("n_hops") > 1, HEADING[1]).otherwise(HEADING[2]))
    return per.select("query_id", "n_hops", F.concat_ws("\n", head, F.transform("_lines", lambda x: x["line"])).alias("narrative"))


def extractive(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, answer): the two best excerpts of the three first passages, marked [n]; refusals where they do not fit.

    queries: (query_id, query); passages: (query_id, position, text).
    """
    top = passages.where("position <= 3").join(queries.select("query_id", "query"), "query_id")
    asked = F.array_distinct(T.tokens(F.col("query"), drop_stopwords=True))
    held = top.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(T.tokens(F.coalesce("text", F.lit("")), drop_stopwords=True)))).alias("held"))
    found = synthesis.windows(top)
    mark = F.concat(F.lit(" ["), F.col("position").cast("string"), F.lit("]"))
    part = F.concat(F.when(F.col("score") > 0, F.col("excerpt")).otherwise(F.split_part("excerpt", F.lit("\n"), F.lit(1))), mark)
    parts = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))).alias("parts"))
    rows = queries.select("query_id", asked.alias("asked")).join(held, "query_id", "left").join(parts, "query_id", "left")
    missing = F.array_except("asked", F.coalesce("held", F.array().cast("array<string>")))
    named = F.filter("missing", lambda w: ~w.isin(synthesis.INQUIRY) & (F.length(w) > 2))
    rows = rows.withColumn("missing", missing).withColumn("named", named)
    share = 1 - F.size("missing") / F.greatest(F.size("asked"), F.lit(1))
    excerpts = F.array_join(F.transform(F.slice(F.coalesce("parts", F.array().cast("array<struct<position:int,part:string>>")), 1, 2), lambda x: x["part"]), "\n\n")
    quoted = F.array_join(F.transform(F.slice("named", 1, 2), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    answer = F.when(F.col("held").isNull(), NO_SOURCES).when((F.size("asked") > 0) & (share < 0.2), OFF_TOPIC)
    answer = answer.when(F.size("named") > 0, F.concat(F.lit(PARTIAL[0]), quoted, F.lit(PARTIAL[1]), excerpts)).otherwise(excerpts)
    return rows.select("query_id", answer.alias("answer"))


def critic(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """synthesis.graded on the three first passages of each query; a query without passages is low and retried."""
    top = passages.where("position <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("all"), F.max_by("final_score", -F.col("position")).alias("top_score"))
    top = top.select("query_id", F.concat_ws(" ", F.transform("all", lambda x: x["text"])).alias("passages"), "top_score")
    graded = synthesis.graded(queries.join(top, "query_id"))
    rows = queries.select("query_id").join(graded, "query_id", "left")
    return rows.select("query_id", "coverage", F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce("should_retry", F.lit(True)).alias("should_retry"), F.coalesce("missing", F.lit("")).alias("missing"))


def synthesized(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Retrieve, grade, retry once with a reformulated query, answer, verify: one row per query.

    retrieve: from (query_id, conversation_id, query) to passages (query_id, position, final_score, text). ``keep``
    writes or checkpoints a frame that several of the following steps read. A query that is not graded low keeps its
    first passages; one that is gets those of the retry where the retry finds any. Columns: query_id, retried,
    answer, n_claims, groundedness (1 when nothing is cited), confidence.
    """
    first = keep(retrieve(queries))
    grade = keep(critic(queries, first))
    low = queries.join(grade.where("should_retry").select("query_id", "missing"), "query_id")
    again = keep(retrieve(low.select("query_id", "conversation_id", synthesis.reformulated(F.col("query"), F.col("missing")).alias("query"))))
    redone = again.select("query_id").distinct()
    passages = keep(first.join(redone, "query_id", "left_anti").unionByName(again))
    graded = critic(queries, passages).select("query_id", F.col("confidence").alias("critic"))
    answers = keep(extractive(queries, passages))
    cited = synthesis.claims(answers.withColumnRenamed("query_id", "answer_id"))
    sources = passages.select(F.col("query_id").alias("answer_id"), F.col("position").cast("int").alias("passage_number"), "text")
    score = synthesis.groundedness(synthesis.verified(cited, sources)).withColumnRenamed("answer_id", "query_id")
    rows = answers.join(score, "query_id", "left").join(graded, "query_id").join(redone.withColumn("retried", F.lit(True)), "query_id", "left")
    n, g = F.coalesce("n_claims", F.lit(0)).cast("long"), F.coalesce("groundedness", F.lit(1.0))
    return rows.select("query_id", F.coalesce("retried", F.lit(False)).alias("retried"), "answer", n.alias("n_claims"), g.alias("groundedness"), synthesis.final_confidence(g, n, F.col("critic")).alias("confidence"))


def stages(done: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, seq, event, data as JSON): the progress events of answered queries in order."""
    types = passages.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file_type")).alias("types"))
    rows = done.join(types, "query_id", "left")
    event = lambda name, *cols: F.struct(F.lit(name).alias("event"), F.to_json(F.struct(*cols)).alias("data"))
    found = F.coalesce("n", F.lit(0)).alias("n_passages")
    kinds = F.coalesce("types", F.array().cast("array<string>")).alias("categories")
    label = F.when(F.size(kinds) > 1, "Multi-Modal").otherwise(F.coalesce(F.get(kinds, 0), F.lit("none"))).alias("intent_label")
    listed = F.array(event("route", kinds, label), event("retrieve", found, "retried"), event("confidence", "confidence"), event("answer", "answer"), event("verify", "groundedness", "n_claims"), event("done", F.lit(True).alias("done")))
    return rows.select("query_id", F.posexplode(listed).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")
