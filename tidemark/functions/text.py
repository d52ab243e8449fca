"""Column expressions: tokens, stems, names, media times; and the tokens of a word, for tasks that count words as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words of queries and passages. Words that cannot be tokens (with an apostrophe, or of
# one letter) are left out.
STOPWORDS = (
    "about above after again against all am an and any are as at be because been before being below between both but by "
    "cannot could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how if in into is it its itself me more most my myself no nor not of off on once only or other ought our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these "
    "they this those through to too under until up very was we were what when where which while who whom why with would you "
    "your yours yourself yourselves actually instead later earlier rather repeating repeat repeated explain explained "
    "explaining reference referenced referencing show tell give find mentions stated talks talking etc also well really "
    "simply basically exactly like just query document doc docs file files information detail details mention mentioned "
    "contain contains say says said ask asked please help"
).split()
STOPWORD_SET = frozenset(STOPWORDS)
# Ordinals and their words, both ways.
ORDINALS = dict(zip("1st 2nd 3rd 4th 5th 6th 7th 8th 9th 10th".split(), "first second third fourth fifth sixth seventh eighth ninth tenth".split()))
TWINS = ORDINALS | {v: k for k, v in ORDINALS.items()}
# Titles in front of names.
HONORIFICS = "mr mrs ms miss dr prof professor advisor lead director dept department".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where a lambda inside would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case ASCII words of two characters or more; words with other letters are dropped."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    ascii_only = F.transform(F.filter(split, lambda w: w.rlike("^[a-z0-9_]+$")), lambda w: F.btrim(w, F.lit("_")))
    return F.filter(ascii_only, lambda w: F.length(w) >= 2)


def word_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, word): a row for each of the words of :func:`words`, so that what follows runs in compiled code."""
    split = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")).alias("word"))
    return split.where(F.col("word").rlike("^[a-z0-9_]+$")).withColumn("word", F.btrim("word", F.lit("_"))).where(F.length("word") >= 2)


def stem(w: Column) -> Column:
    """First rule that fits: short words stay; -ies to -y; final s (not ss) goes; -ing and -ed go."""
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 4), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), n - 1))
        .when(w.endswith("ing") & (n > 4), w.substr(F.lit(1), n - 3))
        .when(w.endswith("ed") & (n > 4), w.substr(F.lit(1), n - 2))
        .otherwise(w)
    )


def twin(w: Column) -> Column:
    """The other spelling of an ordinal, or null."""
    return F.create_map(*[F.lit(x) for kv in TWINS.items() for x in kv])[w]


def emitted(w: Column) -> Column:
    """The tokens of a word: itself, its stem if different, its ordinal twin."""
    return F.array_compact(F.array(w, F.nullif(stem(w), w), twin(w)))


def token_rows(words: DataFrame) -> DataFrame:
    """The rows of :func:`word_rows`, one for each token of their word, as term; the same tokens as :func:`emitted`, in compiled code."""
    w = F.col("word")
    return words.withColumn("term", F.explode(F.array(w, F.nullif(stem(w), w), twin(w)))).where("term is not null")


def separated(text: Column) -> Column:
    """The lower-case text with one blank for all between two words; :func:`tokens_of` tells what each of them emits."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")


def tokens_of(word: str) -> list[str]:
    """The tokens of a word of :func:`separated`, as :func:`token_rows` gives them, itself first; none for a word that is dropped."""
    w = word.strip("_")
    if not word.isascii() or len(w) < 2:
        return []
    s, n = w, len(w)
    if n > 3 and w[-1] in "sgd":
        if w.endswith("ies") and n > 4:
            s = w[:-3] + "y"
        elif w[-1] == "s" and w[-2] != "s":
            s = w[:-1]
        elif w.endswith("ing") and n > 4:
            s = w[:-3]
        elif w.endswith("ed") and n > 4:
            s = w[:-2]
    if s is w and w not in TWINS:
        return [w]
    return list(dict.fromkeys((w, s, TWINS.get(w, w))))


def tokens(text: Column, drop_stopwords: bool = False) -> Column:
    """Each word, then its stem if different, then its ordinal twin."""
    base = words(text)
    if drop_stopwords:
        base = F.filter(base, lambda w: ~w.isin(STOPWORDS))
    return F.flatten(F.transform(base, emitted))


def expanded(query: Column) -> Column:
    """The query with the ordinal twins of its words behind it."""
    twins = F.filter(F.transform(words(query), twin), lambda w: w.isNotNull())
    return F.btrim(F.concat_ws(" ", query, F.array_join(twins, " ")))


def media_time(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = (s / 3600).cast("long"), (s % 3600 / 60).cast("long")
    return F.when(h > 0, F.concat_ws(":", two(h), two(m), two(s % 60))).otherwise(F.concat_ws(":", two(m), two(s % 60)))


def seconds_of(stamp: Column) -> Column:
    """Seconds of the start of a stamp such as MM:SS - MM:SS, HH:MM:SS or 45s; bad parts count 0."""
    start = F.btrim(F.split_part(stamp, F.lit("-"), F.lit(1)), F.lit("[] s"))
    return F.aggregate(F.split(start, ":"), F.lit(0), lambda a, x: a * 60 + F.coalesce(x.try_cast("int"), F.lit(0)))


def strip_title(name: Column) -> Column:
    """A name without one leading title, if something remains."""
    return F.regexp_replace(F.btrim(name), r"(?i)^(" + "|".join(HONORIFICS) + r")[.:,]*\s+(?=\S)", "")


def canonical_id(name: Column) -> Column:
    """Identifier of an entity name: ENTITY_..., ENTITY_VAL_n for numbers, ENTITY_UNKNOWN for nothing."""
    x = F.regexp_replace(strip_title(name), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[\s\-_/\\|:,.]+", "_"), r"[^A-Za-z0-9_]", "")
    x = F.upper(F.btrim(F.regexp_replace(x, "_+", "_"), F.lit("_")))
    # one chain without branches, so that the expression stays small where filters on it are pushed down
    x = F.regexp_replace(F.regexp_replace(x, "^$", "UNKNOWN"), "^([0-9]+)$", "VAL_$1")
    return F.concat(F.lit("ENTITY_"), x)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of trimmed lower-case names; 0 if one is empty."""
    x, y = F.lower(F.btrim(a)), F.lower(F.btrim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def snippet(text: Column, term: Column, before: int = 100, after: int = 240, whole: int = 320) -> Column:
    """The text around the term's first place, with dots where it is cut; without the term, the first 300 characters."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(text), at - 1 + after)
    around = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    head = F.when(F.length(text) > whole, F.concat(F.left(text, F.lit(300)), F.lit("..."))).otherwise(text)
    return F.when((at > 0) & (F.length(term) > 0), around).otherwise(head)


def page_text(text: Column, number: Column) -> Column:
    """The text between a page's tag, ``[Page n]``, ``--- Page n ---`` or ``Page n:``, and the next tag; null without that page."""
    tag = r"(?i)(?:\[Page\s*\d+(?:\s*\(OCR\))?\]|---\s*Page\s*\d+\s*---|Page\s*\d+:)"
    bodies = F.split(text, tag, -1)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({tag})"), F.lit(1)), lambda t: F.regexp_extract(t, r"\d+", 0).cast("int"))
    return F.btrim(F.get(bodies, F.nullif(F.array_position(numbers, number), F.lit(0)).cast("int")), F.lit(" \n\t\r"))


# A stamp, with its end where it has one.
STAMP = r"\[(\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2})?)\]"


def evidence_span(text: Column) -> Column:
    """The stamp of a text, or from the start of its first to the end of its last; null without stamps."""
    stamps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STAMP), F.lit(1))
    start = F.btrim(F.split_part(F.get(stamps, 0), F.lit("-"), F.lit(1)))
    end = F.btrim(F.split_part(F.element_at(stamps, -1), F.lit("-"), F.lit(-1)))
    return F.when(F.size(stamps) == 1, F.get(stamps, 0)).when(F.size(stamps) > 1, F.concat(start, F.lit(" - "), end))
