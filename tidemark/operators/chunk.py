"""Chunkers: greedy packing of blocks. Where a chunk begins follows from the lengths of the blocks alone, so only these leave the
JVM (an Arrow function); texts are split and joined by expressions, each once, in work linear in the text. No shuffle, but for the
numbers of a file's chunks in page mode.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

TARGET, PAGE_WHOLE, JOIN = 1800, 2400, 2
_BLANK = " \t\n\x0b\f\r"


def starts(sizes: list[np.ndarray], room: int, glue: int) -> list[list[int]]:
    """Per row of block lengths, the places (from 0) where a chunk begins, and the row's length behind them.

    The joined length of blocks i to j is a difference of prefix sums, so each block's next cut is found by search
    in them, for all rows at once; the chunks of a row are then a walk from cut to cut.
    """
    counts = np.array([len(x) for x in sizes], dtype=np.int64)
    ends = np.cumsum(counts)
    flat = np.concatenate([*sizes, np.empty(0, dtype=np.int64)]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat + glue)])
    # block m still fits behind i while total[m + 1] - total[i] - 2 * glue + JOIN <= room
    at = np.arange(len(flat))
    after = np.maximum(at + 1, np.searchsorted(total, total[:-1] + room + 2 * glue - JOIN, side="right") - 1)
    after = np.minimum(after, np.repeat(ends, counts)).tolist()
    found = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        first = i = end - n
        own = []
        while i < end:
            own.append(i - first)
            i = after[i]
        found.append([*own, n])
    return found


@F.arrow_udf(ArrayType(IntegerType()))
def _starts(sizes: pa.Array, room: pa.Array, glue: pa.Array) -> pa.Array:
    rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, dtype=np.int64) for x in sizes]
    if not rows:
        return pa.array([], pa.list_(pa.int32()))
    return pa.array(starts(rows, room[0].as_py(), glue[0].as_py()), pa.list_(pa.int32()))


def cut(rows: DataFrame, blocks: str, target: int, glue: str) -> DataFrame:
    """Adds _starts, the cuts of the list ``blocks``: it is joined while the length with the next block, plus 2, stays within the target.

    A block over the target is a chunk of its own; an empty or null list has none.
    """
    return rows.withColumn("_starts", _starts(F.transform(blocks, lambda x: F.length(x)), F.lit(target), F.lit(len(glue))))


def joined(blocks: str, glue: str) -> Column:
    """The chunks behind :func:`cut`. To be exploded as it is: of a named list, Spark computes the size once more, to filter by it."""
    begin = F.slice("_starts", F.lit(1), F.size("_starts") - 1)
    return F.transform(begin, lambda s, k: F.array_join(F.slice(blocks, s + 1, F.get("_starts", k + 1) - s), glue))


def packed(rows: DataFrame, blocks: str, target: int, glue: str, number: str, name: str) -> DataFrame:
    """One row a chunk of the list ``blocks``, which its number and text replace."""
    own = [c for c in rows.columns if c != blocks]
    return cut(rows, blocks, target, glue).select(*own, F.posexplode(joined(blocks, glue)).alias(number, name))


def filled(parts: Column) -> Column:
    """Trimmed parts that are not blank."""
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.filter(trimmed, lambda x: x != "")


def page_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\[Page\s*(\d+)", 1), F.lit("")).try_cast("int")


def first_stamp(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\[(\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2})?)\]", 1), F.lit(""))


def by_blocks(files: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks of paragraphs, or of time-stamped parts where the text has stamps.

    (file_id, chunk_index, chunk_id, text, timestamp, page_number); blank texts give none.
    """
    text = F.coalesce("text", F.lit(""))
    stamped = text.rlike(r"\[\d{1,2}:\d{2}")
    parts = F.when(stamped, F.split(text, r"(?=\[\d{1,2}:\d{2})")).otherwise(F.split(text, r"\n\s*\n"))
    rows = files.select("file_id", "filename", filled(parts).alias("parts"))
    rows = packed(rows, "parts", target, "\n", "chunk_index", "body")
    return _labelled(rows, first_stamp(F.col("body")), page_number(F.col("body")), F.concat(F.lit("["), _label(), F.lit("]\n"), "body"))


def chunked(files: DataFrame) -> DataFrame:
    """The chunks of each file: by pages where its text has page tags, else by blocks."""
    paged = F.contains(F.coalesce("text", F.lit("")), F.lit("[Page "))
    return by_pages(files.where(paged)).unionByName(by_blocks(files.where(~paged)))


def by_pages(files: DataFrame, target: int = TARGET, whole: int = PAGE_WHOLE) -> DataFrame:
    """Chunks of pages: a page within ``whole`` characters stays one chunk, a longer one is packed by paragraph."""
    pages = filled(F.split(F.coalesce("text", F.lit("")), r"(?=\[Page\s*\d+)"))
    rows = files.select("file_id", "filename", F.posexplode(pages).alias("page_no", "page"))
    body = F.regexp_replace("page", r"^\[Page\s*\d+(?:\s*\(OCR\))?\]\s*", "")
    rows = rows.select("file_id", "filename", "page_no", page_number(F.col("page")).alias("number"), F.btrim(body, F.lit(_BLANK)).alias("body")).where("body <> ''")
    # a page that stays whole is the only block of its list
    divided = F.when(F.length("body") > whole, filled(F.split("body", r"\n\s*\n"))).otherwise(F.array("body"))
    rows = cut(rows.withColumn("parts", divided), "parts", target, "\n\n")
    # a chunk's index in its file: the chunks of the pages before, and its place in its own page
    before = Window.partitionBy("file_id", "filename").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(F.size("_starts") - 1).over(before), F.lit(0)))
    rows = rows.select("file_id", "filename", "number", "ahead", F.posexplode(joined("parts", "\n\n")).alias("part_no", "body"))
    rows = rows.withColumn("chunk_index", F.col("ahead") + F.col("part_no"))
    head = F.when(F.col("number").isNull(), F.concat(F.lit("["), _label(), F.lit("]\n"))).otherwise(F.concat(F.lit("["), _label(), F.lit(" | Page "), F.col("number").cast("string"), F.lit("]\n")))
    return _labelled(rows, F.lit(None).cast("string"), F.col("number"), F.concat(head, "body"))


def _label() -> Column:
    return F.translate("filename", "_-", "  ")


def _labelled(rows: DataFrame, stamp: Column, page: Column, text: Column) -> DataFrame:
    name = F.concat_ws("_chunk_", F.col("file_id").cast("string"), F.col("chunk_index").cast("string"))
    return rows.select("file_id", F.col("chunk_index").cast("long").alias("chunk_index"), name.alias("chunk_id"), text.alias("text"), stamp.alias("timestamp"), page.alias("page_number"))


def sliding(files: DataFrame, size: int = 3500, overlap: int = 400, least: int = 20) -> DataFrame:
    """Overlapping windows of plain text for triple extraction: (file_id, start, text)."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))
    rows = files.where("text is not null").select("file_id", "text", F.explode(starts).alias("start"))
    rows = rows.select("file_id", F.col("start").cast("long").alias("start"), F.btrim(F.substring("text", F.col("start") + 1, F.lit(size)), F.lit(" \n\t\r")).alias("text"))
    return rows.where(F.length("text") >= least)


def windows(files: DataFrame, before: str, size: int, least: int, glue: str = "\n\n") -> DataFrame:
    """Windows for triple extraction of texts with tags: (file_id, window_no, text, timestamp, page_number).

    The text is split in front of each tag (4,200 characters and parts of 20 for pages; 3,000 and 15 for
    stamps), and short parts go; a window has the first page or stamp in it, with what stands in brackets behind.
    """
    parts = F.filter(filled(F.split(F.coalesce("text", F.lit("")), before)), lambda x: F.length(x) >= least)
    rows = packed(files.select("file_id", parts.alias("parts")), "parts", size, glue, "window_no", "text")
    stamp = F.nullif(F.regexp_extract("text", r"\[(\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2})?(?:\s*\([^)]+\))?)\]", 1), F.lit(""))
    return rows.select("file_id", "window_no", "text", stamp.alias("timestamp"), page_number(F.col("text")).alias("page_number"))
