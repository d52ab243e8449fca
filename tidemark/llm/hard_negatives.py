"""Operator 13: hard negatives by the threshold algorithm over per-dimension lists.

Rows become integer vectors and lie in blocks of one label and at most ``BLOCK`` rows; a block keeps its rows sorted by each
dimension. Anchors lie in chunks of one label and meet the blocks that can hold what they seek: blocks of their
label for the positives, of the other labels for the negatives. In a block, an anchor reads the lists of all its non-zero dimensions to
a growing depth, from the top where its component is positive and from the bottom where it is negative; rows met first are scored in
integers by random access to their vectors; the threshold, the product of the anchor with the values at that depth, bounds
all other rows. It stops once the threshold is strictly below the k-th score of each window (while a window isn't full: below the
least score that it admits), as rows of equal score rank by vec_id. A block whose threshold is too low at depth 0 isn't read. Each
block passes on its first k rows for each window, and these are ranked again across blocks.

The work is the stated query set (a hundredth of all rows) against all rows, in blocks; a label with any share of the rows is many blocks
and many chunks. In vectors with many dimensions of even weight the threshold falls slowly, so most rows of a block are met.

Defined results: rows with a null vec_id, label, vector or component, or a component that isn't finite, take no part. Rows equal
in vec_id, label and vector count once; rows that share vec_id but differ stay, and are not "other rows" of each other. A vector
shorter than the longest has zeros at its end; an empty one scores 0. Equal scores rank by vec_id. Labels are taken as they are, negative ones too.
Integers up to 2^53 are exact; products that may be larger are computed in whole numbers of any size and returned clipped to 64 bits.
An anchor without a positive, or a positive without a negative in its window, has no rows; an empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block and anchors of a chunk, at most; depths of the rounds of sorted access.
BLOCK, CHUNK = 8192, 2048
DEPTHS = (16, 64, 256, 1024, 4096, 8192)
PACKED = "shard int, seq int, label long, size int, ids binary, vectors binary, lists binary, windows binary"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"
TOP = np.iinfo(np.int64).max


def quantized(rows: DataFrame, relabel: Column) -> DataFrame:
    """vec_id, label, v: the rows that take part, floor(256 * x) for each component, all of one length."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(whole)
    rows = rows.select(F.col("vec_id").cast("long"), relabel.cast("long").alias("label"), F.transform(wide, lambda x: F.floor(256 * x).cast("double")).alias("v")).distinct()
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))))


def _packed(batches: Iterator[pa.RecordBatch], most: int, lists: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that follow each other and share a label."""
    shard, seq = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def block(ids: np.ndarray, label: int, vectors: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.uint16) if lists else np.zeros(0, np.uint16)
        narrow = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
        row = [[shard], [seq], [label], [len(ids)], [ids.tobytes()], [narrow.dtype.char.encode() + narrow.tobytes()], [order.tobytes()], [windows.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds)], names=["shard", "seq", "label", "size", "ids", "vectors", "lists", "windows"])

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, seq
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        held = []
        for part in rows:
            labels = part.column(1).to_numpy()
            ends = np.flatnonzero(np.diff(labels, append=labels[-1] + 1)) + 1
            at = 0
            for end in ends.tolist():
                while at < end and (end - at >= most or end < len(labels) or last):
                    n = min(most, end - at)
                    own = part.slice(at, n)
                    vectors = np.asarray(own.column(2).flatten(), dtype=np.float64).reshape(n, -1)
                    windows = np.asarray(own.column(3).flatten(), dtype=np.int64) if own.num_columns > 3 else np.zeros(0, np.int64)
                    yield block(own.column(0).to_numpy(), int(labels[at]), vectors, windows)
                    at, seq = at + n, seq + 1
            if at < len(labels):
                held = [part.slice(at)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield from cut(False)
    if held:
        yield from cut(True)


def blocks(rows: DataFrame, shards: int, most: int = BLOCK, lists: bool = True) -> DataFrame:
    """The rows (vec_id, label, v, further arrays of whole numbers) packed, ``most`` a block at most; written once."""
    spread = rows.repartitionByRange(shards, "label", F.xxhash64("vec_id")).sortWithinPartitions("label", "vec_id")
    return written(spread.mapInArrow(lambda batches: _packed(batches, most, lists), PACKED))


def _vectors(raw: bytes, n: int) -> np.ndarray:
    found = np.frombuffer(raw, dtype=np.dtype(chr(raw[0])), offset=1).reshape(n, -1)
    return found.astype(np.float64)


class Block:
    """A block's rows and lists. Scores are exact: as doubles below 2^53, else as whole numbers of any size."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.x = _vectors(row["vectors"], row["size"])
        n, d = self.x.shape
        self.down = np.frombuffer(row["lists"], dtype=np.uint16).reshape(d, n) if d else np.zeros((0, n), np.uint16)
        self.depths = [0, *[h for h in DEPTHS if h < n], n]
        at = lambda k: self.x[self.down[:, k], np.arange(d)]
        self.high = np.array([at(min(h, n - 1)) for h in self.depths])
        self.low = np.array([at(max(n - 1 - h, 0)) for h in self.depths])

    def thresholds(self, a: np.ndarray) -> np.ndarray:
        """Of each anchor at each depth: no row that isn't met above that depth scores more; none is left at the last one."""
        t = np.maximum(a, 0) @ self.high.T + np.minimum(a, 0) @ self.low.T
        t[:, -1] = -np.inf
        return t

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if np.abs(self.x).max(initial=0) * np.abs(a).max(initial=0) * max(1, len(a)) < 1 << 53:
            return self.x[rows] @ a
        weights = [int(w) for w in a]
        return np.array([sum(int(v) * w for v, w in zip(x, weights)) for x in self.x[rows]], dtype=object)

    def search(self, a: np.ndarray, thresholds: np.ndarray, own: int, k: int, windows: list[tuple[int, int]] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first k rows of each window (low * 100, high) by (score descending, vec_id), as (vec_ids, scores); None: of all rows.

        ``own`` is the anchor's vec_id, whose rows never count.
        """
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        n, d = self.x.shape
        seen = np.zeros(n, dtype=bool)
        seen[self.ids == own] = True
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in windows or [None]]
        before = 0
        for step, h in enumerate(self.depths):
            if step:
                met = np.zeros(n, dtype=bool)
                if h == n:
                    met[:] = True
                else:
                    met[self.down[up, before:h].ravel()] = True
                    met[self.down[down, n - h : n - before].ravel()] = True
                new = np.flatnonzero(met & ~seen)
                seen[new] = True
                score, ids, before = self.scores(new, a), self.ids[new], h
                for w, (old_ids, old_scores) in enumerate(best):
                    fits = slice(None)
                    if windows:
                        fits = (100 * score >= windows[w][0]) & (score <= windows[w][1])
                    all_ids, all_scores = np.concatenate((old_ids, ids[fits])), np.concatenate((old_scores, score[fits]))
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best[w] = all_ids[order], all_scores[order]
            bars = [s[-1] if len(s) == k else windows[w][0] / 100 if windows else -np.inf for w, (_, s) in enumerate(best)]
            if thresholds[step] < min(bars):
                break
        return best


def _clipped(score) -> int:
    return max(-TOP - 1, min(TOP, int(score)))


def _cells(batches: Iterator[pa.RecordBatch], k: int, windowed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk of anchors and a block: what each anchor finds in the block."""
    names = FOUND.replace(" long", "").split(", ")
    last, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("shard", "seq", "a_size", "a_ids", "a_vectors", "a_windows")}
            if (row["shard"], row["seq"]) != last:
                last, block = (row["shard"], row["seq"]), Block({c: batch.column(c)[i].as_py() for c in ("size", "ids", "vectors", "lists")})
            anchors, a = np.frombuffer(row["a_ids"], dtype=np.int64).tolist(), _vectors(row["a_vectors"], row["a_size"])
            positives = np.frombuffer(row["a_windows"], dtype=np.int64).reshape(len(anchors), -1, 2) if windowed else [None] * len(anchors)
            out: list[tuple] = []
            for anchor, vector, t, own in zip(anchors, a, block.thresholds(a), positives):
                pairs = [p for p in own.tolist() if p[1] >= 0] if windowed else []
                if windowed and not pairs:
                    continue
                found = block.search(vector, t, anchor, k, [(80 * s, s) for _, s in pairs] if windowed else None)
                for (p, s), (ids, scores) in zip(pairs or [(None, None)], found):
                    out += [(anchor, p, s, x, _clipped(y)) for x, y in zip(ids.tolist(), scores.tolist())]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def _met(chunks: DataFrame, index: DataFrame, shards: int, alike: bool, k: int) -> DataFrame:
    """Each chunk of anchors against each block of its label, or of the other labels; chunks are copied to the shards of blocks."""
    copies = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to"), F.col("label").alias("a_label"), *[F.col(c).alias(f"a_{c}") for c in ("size", "ids", "vectors", "windows")])
    on = (F.col("shard") == F.col("to")) & ((F.col("label") == F.col("a_label")) if alike else (F.col("label") != F.col("a_label")))
    cells = index.join(copies, on).select("shard", "seq", "size", "ids", "vectors", "lists", "a_size", "a_ids", "a_vectors", "a_windows")
    return cells.mapInArrow(lambda batches: _cells(batches, k, not alike), FOUND)


def mine(rows: DataFrame, anchor: Column, relabel: Column | None = None, positives: int = 5, negatives: int = 5, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows that ``anchor`` picks."""
    rows = written(quantized(rows, F.col("label") if relabel is None else relabel))
    count = rows.count()
    shards = max(1, -(-count // block))
    index = blocks(rows, shards, block)
    picked = rows.where(anchor)
    near = _met(blocks(picked, max(1, shards // 16), CHUNK, lists=False), index, shards, True, positives)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = written(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives))
    own = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("own"))
    # an anchor's positives as (id, score) pairs laid flat, filled up with pairs that have no window
    pairs = F.flatten(F.transform("own", lambda x: F.array(x["id"], x["score"])))
    fill = F.flatten(F.array_repeat(F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long")), F.lit(positives) - F.size("own")))
    asked = picked.join(own, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", F.concat(pairs, fill).alias("windows"))
    hard = _met(blocks(asked, max(1, shards // 16), CHUNK, lists=False), index, shards, False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    found = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
