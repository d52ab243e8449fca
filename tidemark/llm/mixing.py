"""Operator 1: mixing sources to target weights by systematic sampling. DataFrame functions only.

Documents of a source stand in the order (size, md5 of doc_id, doc_id). Each is expected to be taken
``target / source size`` times; the running sum of these expectations, moved by one random offset per source,
crosses some whole numbers inside a document's interval, and the document is emitted once for each.
The order by size spreads the copies evenly over short and long documents, so the words taken differ
from the target by about one long document at most. The offset is seeded by the source's name.

A running sum over a source that holds a third of all rows would be one task's work. It is split
instead: totals per (source, size), totals per (source, size, first two digits of the md5), then row
numbers inside such a block; only the last step handles rows, in blocks of a 256th of a size's rows.

Defined results: a null or empty text has size 0; a very long one is a document like others and is taken whole; a
null source is a source of its own, the last in order; a source without words has target 0 and its documents
are not emitted; with no rows the result is empty. Rows with the same doc_id, or none, are documents of their
own, ordered by their text's hash; equal rows are interchangeable. Other columns of the input stay, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, partitions, text_key, written


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds n, the rank by (source is null, source): rows of a range are numbered on their own, after those of earlier ranges."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sources.repartitionByRange(partitions(sources.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").count()
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a task
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("own", own).join(before, "part").select("source", "source_size", (F.col("before") + F.col("own")).alias("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> with target: weights by code point order, shares of all words, capped.

    The excess over ``cap`` times a source's size goes to the others by weight, again and again: each round
    is one aggregate over the sources, and a source that reached its cap stays there.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    sources = written(_numbered(sizes).select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("cap")))
    level, total = 0.0, float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        held, open_ = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        risen = (total - (held or 0.0)) / open_ if open_ else level
        if risen == level:
            return sources.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))
        level = risen


def expected(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, row_key, source, size, source_size, target, copies."""
    slim = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("row_key"),
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )
    slim = written(slim.withColumn("part", F.substring("digest", 1, 2)))
    blocks = slim.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    in_size = blocks.withColumn("before_part", F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n"))
    sizes = blocks.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("before_size", F.sum("n").over(Window.partitionBy("source").orderBy("size")) - F.col("n"))
    sources = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    starts = _joined(_joined(in_size.drop("n"), sizes.drop("n"), "source", "size"), sources, "source")

    row = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("digest", "doc_id", "row_key"))
    ranked = _joined(slim.withColumn("row", row), starts, "source", "size", "part")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("before_size") + F.col("before_part") + F.col("row")).cast("double")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("long")
    return ranked.select("doc_id", "row_key", "source", "size", "source_size", "target", copies.alias("copies"))


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join in which a null key matches a null key."""
    right = right.toDF(*[f"_{c}" if c in keys else c for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond).drop(*[f"_{k}" for k in keys])


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix: every row as often as it is taken, with the columns it came with.

    Rows equal in doc_id, text and source share their copies: of k such rows in a fixed order, the n-th gets the part of
    the total between (n - 1) / k and n / k. Rows equal in all columns are counted before they are ordered.
    """
    names = F.concat_ws("|", F.isnull("doc_id"), F.isnull("source"), F.coalesce("source", F.lit("")))
    keys = {"k0": F.coalesce("doc_id", F.lit(0)), "k1": F.col("row_key"), "k2": names}
    spread = expected(docs, seed).groupBy(*[k.alias(name) for name, k in keys.items()]).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    spread = written(spread.where("copies > 0"))
    keys["k1"] = text_key(F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[k.alias(name) for name, k in keys.items()])
    joined = rows.join(spread, list(keys))
    upto = lambda n: F.floor(F.col("copies") * n / F.col("rows"))
    once = joined.where("rows = 1").select("row", F.col("copies").cast("int").alias("times"), F.lit(1).alias("like"))
    alike = joined.where("rows > 1").groupBy("row", *keys, "copies", "rows").agg(F.count("*").alias("like"))
    before = F.sum("like").over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("like")
    alike = alike.withColumn("before", before).select("row", (upto(F.col("before") + F.col("like")) - upto(F.col("before"))).cast("int").alias("times"), F.lit(1).alias("like"))
    both = once.unionByName(alike).where("times > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
