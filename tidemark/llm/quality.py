"""Operator 6: quality rules as a short-circuit cascade. DataFrame functions only.

A rule is a Boolean expression that is true for a bad document. On a sample, each rule's rejection share
and running time are measured; the rules are ordered by rejection per cost, and the verdict is one CASE
whose later branches run only for rows that earlier ones let pass. The order changes the work, never the
verdict, which covers every row and whole texts. The base test stands in front of the cascade: a row that fails it
runs no rule, and what only rules need is part of their expressions.

Repeated words: a text's 5-word windows are 64-bit hashes of word hashes. Where they are all different, and in
most texts they are, nothing repeats. Elsewhere they are sorted with their positions; equal neighbours mark windows
found twice, and the covered words are counted from the sorted positions. No window leaves its row.

Defined results: a null or empty text has no words, and base_failed is true for it; a very long text costs one
sort of its windows; a rule is bad only beyond its bound, not at it. Rows are independent of each other, so ties and
repeats have equal results; with no rows the result is empty. Other columns stay, whatever their names, but for
those of the measures and kept, which are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, renamed, written

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: What rules may read besides the measures: the text and its words.
READ = ("doc_text", "words", *MEASURES)


@dataclass(frozen=True)
class Rule:
    """``bad``: SQL over the columns of READ."""

    name: str
    bad: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines > 0 and 10 * n_dup_lines > 4 * size(filter(split(doc_text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'))"),
    Rule("few_letters", "2 * size(filter(words, w -> w rlike '[\\\\p{L}]')) < n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "2 * size(filter(words, w -> w rlike '^[^\\\\p{Ll}]*[\\\\p{Lu}]{2}[^\\\\p{Ll}]*$')) > n_words"),
    Rule("few_distinct", "10 * size(array_distinct(words)) < n_words"),
)


def measured(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of docs, those of READ behind them; docs has in0, in1, ... and text."""
    rows = docs.withColumn("doc_text", F.coalesce("text", F.lit(""))).drop("text")
    inner = F.btrim("doc_text", F.lit(BLANKS))
    rows = rows.withColumn("words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn("coded", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("doc_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    windows = F.transform(F.slice("coded", 1, F.greatest(F.size("coded") - (window - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("coded", i + k) for k in range(1, window)]))
    rows = rows.withColumns({"windows": windows, "lines": lines})
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(placed))
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("placed", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    rows = rows.withColumn("found", F.array_sort(F.transform(twice, lambda x: x["p"])))
    # each place covers the words up to the next one, ``window`` at the most
    gaps = F.zip_with("found", F.slice("found", 2, F.greatest(F.size("found"), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    repeats = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return rows.select(
        *[c for c in docs.columns if c != "text"],
        "doc_text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("doc_text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("doc_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def ordered(sample: DataFrame, rules: tuple[Rule, ...] = RULES, runs: int = 3) -> list[Rule]:
    """Rules by rejection per cost on ``sample`` (a measured frame); ties by name.

    A rule's cost is the least time of ``runs`` passes over the sample, less that of a pass that reads the same
    columns and runs no rule, so that what a job costs in any case does not count.
    """
    sample = written(sample.select(*READ)).where("not base_failed")  # a filter on what is written yet would compute the measures again
    read = [F.count(F.when(F.col(c).isNull(), 1)) for c in READ]

    def timed(bad: Column) -> tuple[float, int]:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            rejected = sample.agg(F.count(F.when(bad, 1)), *read).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), rejected

    timed(F.lit(False))  # the first pass also loads code
    base, _ = timed(F.col("n_words") < 0)
    scores = []
    for rule in rules:
        seconds, rejected = timed(F.expr(rule.bad))
        scores.append((-rejected / max(seconds - base, 1e-3), rule.name, rule))
    return [rule for _, _, rule in sorted(scores, key=lambda x: x[:2])]


def verdict(rules: list[Rule]) -> Column:
    """True for a row that no rule rejects; evaluated in order, as far as needed."""
    kept = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        kept = kept.when(F.expr(rule.bad), F.lit(False))
    return kept.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Adds the measures and ``kept``. ``sample_rows``: expected size of the sample for the order."""
    docs = docs.drop(*MEASURES, "kept")
    n = docs.count()
    order = ordered(measured(docs.select("text").sample(False, min(1.0, sample_rows / max(1, n)), 7)), rules)
    rows, own = renamed(docs)
    found = measured(rows.withColumn("text", F.col(own["text"])))
    return found.select(*[F.col(k).alias(c) for c, k in own.items()], *MEASURES, verdict(order).alias("kept"))
