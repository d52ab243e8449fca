"""Operator 5: token ids of a corpus as patched frame-of-reference files, in doc_id order.

Documents are range-partitioned by doc_id and sorted, then encoded; each task writes segments of whole
documents through Spark's own writer, so a retried task leaves no half file. A segment is one binary
value: a header, an index of block starts, and blocks of 1,024 ids. A block holds its minimum, the bit
width that covers a given percentile of the differences from it, the packed differences, and an exception
list (positions, values) for those that need more bits.

Words repeat, so each task encodes each distinct word once (the tokenizer drops white space between words
and no rule spans it) and lays the ids out by code; the memo is bounded and only saves work.

Defined results: a null text is empty, an empty text is the end id alone; null doc_ids come first; rows
with equal doc_id follow each other by the hash of their text, then the text, and equal rows are written each;
a very long text is encoded on its own and makes a segment of its own length; with no rows there are no segments
and the result is empty; other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, coded, laid_out, lists, partitions, shared_dir, text_slices

BLOCK = 1024
MAGIC = b"PFOR"
SEGMENTS = "shard int, segment int, start long, n_tokens long, doc_ids array<long>, counts array<long>, data binary"
READ = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


def pack(values: np.ndarray, percentile: float = 95.0) -> bytes:
    """A segment of unsigned 32-bit values."""
    values = np.asarray(values, dtype=np.uint32)
    n, blocks = len(values), -(-len(values) // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint32)
    padded[:n] = values
    padded[n:] = values[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    at = np.partition(grid, rank, axis=1)[:, rank] if blocks else low
    widths = np.frexp(at.astype(np.float64))[1].astype(np.uint8)
    out: list[bytes] = [b""] * blocks
    for width, rows in _runs(widths):
        part = grid[rows]
        fits = part < (1 << width)
        bits = np.unpackbits(np.where(fits, part, 0).astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for k, row in enumerate(rows.tolist()):
            odd = np.flatnonzero(~fits[k])
            out[row] = struct.pack("<IBH", int(low[row]), width, len(odd)) + packed[k].tobytes() + odd.astype("<u2").tobytes() + part[k, odd].astype("<u4").tobytes()
    starts = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype("<u8")
    return MAGIC + struct.pack("<QI", n, blocks) + starts.tobytes() + b"".join(out)


def _runs(widths: np.ndarray, most: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of one width, some at a time, so that the unpacked bits stay small."""
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for i in range(0, len(rows), most):
            yield width, rows[i : i + most]


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values [first, last) of a segment; reads only the blocks that hold them."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = struct.unpack_from("<QI", data, 4)
    last = n if last is None else min(last, n)
    starts = np.frombuffer(data, "<u8", blocks + 1, 16)
    base = 16 + 8 * (blocks + 1)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    grid = np.zeros((max(0, b1 - b0), BLOCK), dtype=np.uint32)
    heads = [struct.unpack_from("<IBH", data, base + int(s)) for s in starts[b0:b1]]
    for width, rows in _runs(np.array([h[1] for h in heads], dtype=np.uint8)):
        size = BLOCK * width // 8
        packed = np.frombuffer(b"".join(data[(p := base + int(starts[b0 + k]) + 7) : p + size] for k in rows.tolist()), np.uint8)
        full = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
        if width:
            full[:, :, :width] = np.unpackbits(packed.reshape(len(rows), size), axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        grid[rows] = np.packbits(full, axis=2, bitorder="little").reshape(len(rows), BLOCK * 4).view("<u4")
    for k, (_, width, odd) in enumerate(heads):
        if odd:
            p = base + int(starts[b0 + k]) + 7 + BLOCK * width // 8
            grid[k, np.frombuffer(data, "<u2", odd, p)] = np.frombuffer(data, "<u4", odd, p + 2 * odd)
    grid += np.array([h[0] for h in heads], dtype=np.uint32).reshape(-1, 1)
    return grid.reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


class WordEncoder:
    """Ids of texts by their distinct words, in a memo of ``memo`` words.

    Words are cut at blanks and line feeds, and between an ASCII letter and a full stop or comma: the
    tokenizer splits there itself, whatever stands around.
    """

    def __init__(self, path: str, memo: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self.ids, memo)

    def ids(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 20_000):
            out += [e.ids for e in self.tokenizer.encode_batch(words[i : i + 20_000], add_special_tokens=False)]
        return out

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and the number of each text's ids."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        offsets, words = lists(pc.split_pattern(pc.replace_substring_regex(spaced, "([A-Za-z])([.,])", r"\1 \2"), " "))
        codes, distinct = coded(words)
        laid, ends = laid_out(self.memo.lookup(distinct), codes, offsets)
        return np.insert(laid, ends[1:], end_id), np.diff(ends) + 1


_ENCODERS: dict[str, WordEncoder] = {}


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, target: int) -> Iterator[pa.RecordBatch]:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    encoder = _ENCODERS[path]
    shard, segment, start = TaskContext.get().partitionId(), 0, 0
    doc_ids, counts, ids, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        row = [[shard], [segment], [start], [held], [doc_ids], [counts], [pack(np.concatenate(ids))]]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()])], names=["shard", "segment", "start", "n_tokens", "doc_ids", "counts", "data"])

    for batch in batches:
        for i, j in text_slices(batch.column(1), 3_000_000):
            laid, n = encoder.texts(batch.column(1)[i:j], end_id)
            doc_ids += batch.column(0)[i:j].to_pylist()
            counts += n.tolist()
            ids.append(laid)
            held += len(laid)
            if held >= target:
                yield flush()
                segment, start = segment + 1, start + held
                doc_ids, counts, ids, held = [], [], [], 0
    if doc_ids:
        yield flush()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, target: int = 1 << 19, path: str | None = None) -> str:
    """Writes the files and returns their folder. ``target``: ids of a segment, at least; whole texts."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows.mapInArrow(lambda batches: _segments(batches, tokenizer, end_id, target), SEGMENTS).write.option("compression", "zstd").parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["data"]).astype("<u4")
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(crc)
            yield pa.record_batch([pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    The start adds the sizes of earlier shards; that table has one row per task that wrote, which bounds
    the broadcast.
    """
    table = spark.read.parquet(path)
    shards = table.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("size"))
    shards = shards.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    rows = table.select("shard", "start", "doc_ids", "counts", "data").mapInArrow(_read, READ)
    joined = rows.join(F.broadcast(shards), "shard")
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
