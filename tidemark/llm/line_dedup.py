"""Operator 9: drop lines that several documents share.

Lines are exploded to 128-bit hashes of their normalised form, in the JVM, so that no task holds more than a text and its
lines. Per hash the least and the greatest doc_id (combined before the shuffle) tell whether two documents hold it,
which equals a distinct count of at least two without a set per hash. The hashes found twice are a table, joined back
to the line rows, and each document gets the list of its lines that go. Nothing is gathered per line, and both sides
of the join come straight from their exchanges, so a line that every document holds is dealt over several tasks.

Defined results: a null or empty text is one empty line; blank and short lines stay; in the smallest
doc_id that holds a line all its repeats stay; rows with a null doc_id keep all lines and count for no
key; rows that repeat a doc_id are one document; equal rows give equal rows; very long texts are hashed in one
pass and cost their own length. With no rows the result is empty. Other columns stay, whatever their names, but
for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, renamed, text_key, written


def line_key(line: Column) -> Column:
    """A trimmed line with A-Z in lower case; lower() does just that where a line is ASCII, and is faster than a translation."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, ascii_uppercase, ascii_lowercase))


def shared_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, row_key, drop): the positions of the lines that go, for documents that lose any."""
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("row_key"), "text")
    split = slim.select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    long = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= least).withColumn("line", line_key(F.col("line")))
    # two seeds, so that a clash of one half says nothing of the other
    lines = written(long.select("doc_id", "row_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2")))
    shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    gone = lines.join(written(shared.select("h1", "h2", "first_id")), ["h1", "h2"]).where("doc_id > first_id")
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """The documents with their shared lines dropped; adds n_lines and n_dropped, replacing such columns."""
    docs = docs.drop("n_lines", "n_dropped")
    gone = shared_lines(docs, least).toDF("id", "key", "drop")
    rows, own = renamed(docs)
    text = F.col(own["text"])
    joined = rows.join(gone, (F.col(own["doc_id"]) == F.col("id")) & (text_key(text) == F.col("key")), "left")
    joined = joined.withColumn("lines", F.split(F.coalesce(text, F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.select(*[(kept if c == "text" else F.col(n)).alias(c) for c, n in own.items()], F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
