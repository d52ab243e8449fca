"""Helpers that the operators share: components, and Arrow text handling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import shared_dir, written  # noqa: F401 - the operators take them from here

#: ASCII white space as the contracts define it.
BLANKS = " \t\n\x0b\f\r"


def text_key(text: Column) -> Column:
    """With doc_id, names a row where doc_id repeats; equal rows share it and share results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns in0, in1, ..., so that an operator's own columns clash with none, and the new name of each old one."""
    new = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` together; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together."""
    return slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), limit)


def lists(parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and flat values of a list array."""
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    return offsets - offsets[0], parts.flatten()


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's code, and the distinct words."""
    found = words.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


class Memo:
    """Numbers of each word (ids), laid end to end; a word is computed once while there is room.

    ``compute`` gives the numbers of a list of new words: a list each, or all end to end and their counts. Words beyond ``size``, and words of over ``longest``
    characters, are computed again when they come again, so the bounds cost time only.
    """

    def __init__(self, compute, size: int, longest: int = 256):
        self.compute, self.size, self.longest, self.slots = compute, size, longest, {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, lengths): the numbers of words[k] are flat[starts[k] : starts[k] + lengths[k]]."""
        slots = np.fromiter((-1 if s is None else s for s in map(self.slots.get, words)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(slots < 0)
        starts, lengths, flat = self.starts[slots], self.lengths[slots], self.flat
        if len(new):
            found = self.compute([words[k] for k in new.tolist()])
            if isinstance(found, tuple):
                extra, sizes = found[0].astype(np.uint32), found[1]
            else:
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                extra = np.fromiter((x for ids in found for x in ids), dtype=np.uint32, count=int(sizes.sum()))
            at = np.cumsum(sizes) - sizes
            fresh = [words[k] for k in new.tolist()]
            short = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) <= self.longest
            room = len(self.slots) + len(new) <= self.size
            if room and short.all():
                self._keep(fresh, extra, at, sizes)
                starts[new], flat = at + self.used - len(extra), self.flat
            else:
                starts[new], flat = at + self.used, np.concatenate((self.flat[: self.used], extra))
                if room and short.any():
                    own = np.cumsum(sizes[short]) - sizes[short]
                    self._keep([w for w, s in zip(fresh, short.tolist()) if s], extra[ragged(at[short], sizes[short])], own, sizes[short])
            lengths[new] = sizes
        return flat, starts, lengths

    def _keep(self, words: list[str], extra: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.slots), len(words)
        while self.used + len(extra) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + m > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(extra)] = extra
        self.starts[n : n + m], self.lengths[n : n + m] = at + self.used, sizes
        self.slots.update(zip(words, range(n, n + m)))
        self.used += len(extra)


def laid_out(found: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words by code, and where each text's numbers end (with a leading 0)."""
    flat, starts, lengths = found
    sizes = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
    return flat[ragged(starts[codes], sizes)], ends


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), both long, as (node, component = least node).

    Alternating large-star and small-star rounds; each round is two aggregations and two equi-joins
    over tables in the shared folder, and rounds grow with the logarithm of the largest component.
    No neighbour list is gathered, and the joins read both sides straight from their exchanges, so
    that a node with very many edges is dealt over several tasks.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct())
    while not _stars(now):
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")))
        large = written(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.*").where("u <> v").distinct())
    return spark.createDataFrame([], "node long, component long").union(now.select("u", "v")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each edge (u, v), v below u, joins a node that has no other edge to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or out = 1 and into > 0").isEmpty()
