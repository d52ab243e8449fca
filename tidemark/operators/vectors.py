"""An approximate vector index: inverted lists around trained centroids, product codes of residuals, exact re-ranking.

    <path>/model     one row: the parameters, the centroids and the codebooks
    <path>/vectors   (conversation_id, list_no, segment, chunk_id, vector): every vector with its list
    <path>/segments  (conversation_id, list_no, segment, n, ids, codes): the chunks of a segment and their codes, packed in one row
    <path>/counts    (conversation_id, list_no, n, segments)

The model is fitted on a bounded sample (``sample`` vectors at most, dealt over the conversations); every
vector is indexed. A list of a conversation is cut into segments of about ``SEGMENT`` vectors by a hash of the id, so a row stays small however large a
conversation is, and a search of it is the work of many tasks. A query reads the lists nearest to it until these hold a share of its
conversation, which the fit measures on its sample for a target recall, and at least ``least`` vectors, scores their codes with one table of ``parts`` times 16 numbers, and computes the best ``rerank`` exactly.
So small conversations are searched in full. :func:`recall` compares with every vector; ``retrieve.dense_topk`` and, for many queries, :func:`exact` stay the exact ways.

Vectors that are null or empty, hold a null or a component that is not finite, or have another length than the first of the sample, have no place in the
index, and queries with such vectors find nothing. A chunk_id names one vector of its conversation; rows that
repeat it are one hit, by the best of them. With no vectors the index is empty and searches find nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieve
from .segments import shared_files

#: Vectors of a segment, about; centroids of a part of a residual, so that a code is one of 16 values; salts of a sampled conversation.
SEGMENT, CODES, SALTS = 1024, 16, 64
#: Queries and vectors of a cell of all products, about.
CELL = (2048, 16_384)
#: Part of the paths of indexes that are found by name; it changes with the form of the tables.
FORMAT = "f2"


@dataclass(frozen=True)
class Model:
    """centroids: lists x size; books: parts x 16 x (size / parts), with zeros behind the last component where parts do not divide size;
    share: how much of a conversation a search reads."""

    centroids: np.ndarray
    books: np.ndarray
    size: int
    share: float

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.centroids.shape[1] - self.size)))

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and a code for each part of what its centroid leaves."""
        rows = self.padded(rows)
        lists = nearest(rows, self.centroids)
        rest = (rows - self.centroids[lists]).reshape(len(rows), len(self.books), -1)
        return lists, np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def asked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of the queries with all centroids (n x lists) and with all codes (n x parts x 16)."""
        rows = self.padded(rows)
        return rows @ self.centroids.T, np.einsum("npd,pcd->npc", rows.reshape(len(rows), len(self.books), -1), self.books)


def nearest(rows: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """The nearest centre of each row by distance, in blocks of rows."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(rows), block)] or [np.zeros(0, dtype=np.int64)])


def means(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres by Lloyd's rounds from k rows; a centre that loses all its rows moves to a row at random."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = nearest(rows, centres)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        centres = sums / np.maximum(sizes, 1)[:, None]
        lost = np.flatnonzero(sizes == 0)
        centres[lost] = rows[rng.integers(len(rows), size=len(lost))]
    return centres


def fitted(vectors: DataFrame, lists: int = 64, parts: int = 32, sample: int = 20_000, rounds: int = 12, seed: int = 7, target: float = 0.97) -> Model | None:
    """The model of a sample of at most ``sample`` vectors: one of each conversation and salt, then a second of each, and so on, by a hash of the id.

    The salts keep a conversation from being numbered in one task, and each task passes on its first few rows only.
    """
    rows = vectors.where(_usable("vector")).withColumn("h", F.xxhash64("chunk_id", "conversation_id", "vector"))
    rows = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy("conversation_id", "salt").orderBy("h"))).where(F.col("turn") <= math.ceil(sample / SALTS))
    found = turns.orderBy("turn", "salt", "h").limit(sample).select("vector").toArrow()["vector"].to_pylist()
    found = [v for v in found if len(v) == len(found[0])]
    if not found:
        return None
    data = np.asarray(found, dtype=np.float64)
    size, wide = data.shape[1], math.ceil(data.shape[1] / parts)
    data = np.pad(data, ((0, 0), (0, wide * parts - size)))
    centres = means(data, min(lists, len(data)), rounds, seed)
    rest = (data - centres[nearest(data, centres)]).reshape(len(data), parts, wide)
    books = np.stack([_filled(means(rest[:, p], min(CODES, len(data)), rounds, seed + p + 1)) for p in range(parts)])
    return Model(centres, books, size, _share(data, centres, target))


def _share(data: np.ndarray, centres: np.ndarray, target: float, asked: int = 256, hits: int = 30) -> float:
    """How much of the sample must be read, nearest lists first, to meet ``target`` of the ``hits`` best of its first vectors.

    The best of a sample lie farther away than those of all vectors, so this reads rather too much than too little.
    """
    own = nearest(data, centres)
    queries, sizes = data[:asked], np.bincount(own, minlength=len(centres))
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    before = np.empty(order.shape)
    np.put_along_axis(before, order, np.cumsum(sizes[order], axis=1) - sizes[order], axis=1)
    best = np.argsort(-(queries @ data.T), axis=1, kind="stable")[:, :hits]
    return float(np.quantile(np.take_along_axis(before, own[best], axis=1), target, method="higher") + 1) / len(data)


def _usable(vector: str, size: int | None = None) -> Column:
    """Whether it has components (``size`` of them), all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size if size else F.size(vector) > 0) & ~bad, F.lit(False))


def _filled(book: np.ndarray) -> np.ndarray:
    """The book with its first entry repeated up to 16."""
    return np.concatenate((book, np.repeat(book[:1], CODES - len(book), axis=0)))


def built(vectors: DataFrame, path: str, **fit) -> None:
    """Writes the index of (conversation_id, chunk_id, vector) under ``path``; ``fit`` goes to :func:`fitted`."""
    spark, model = vectors.sparkSession, fitted(vectors, **fit)
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    told = [] if model is None else [(model.size, model.share, len(model.books), model.centroids.ravel().tolist(), model.books.ravel().tolist())]
    slim = vectors.where("vector is not null").select("conversation_id", "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    if model is None:
        rows = slim.limit(0).withColumns({"list_no": F.lit(0), "code": F.lit(b"")})
    else:
        rows = slim.where(_usable("vector", model.size)).mapInArrow(lambda batches: _placed(batches, model), f"conversation_id string, chunk_id {id_type}, vector array<double>, list_no int, code binary")
    rows.write.parquet(f"{path}/placed")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/placed")
    counts = rows.groupBy("conversation_id", "list_no").agg(F.count("*").alias("n")).withColumn("segments", F.ceil(F.col("n") / SEGMENT).cast("int"))
    counts.write.parquet(f"{path}/counts")
    cut = rows.join(spark.read.parquet(f"{path}/counts").drop("n"), ["conversation_id", "list_no"]).withColumn("segment", F.pmod(F.xxhash64("chunk_id", "vector"), F.col("segments")).cast("int"))
    keys = ["conversation_id", "list_no", "segment"]
    cut.select(*keys, "chunk_id", "vector").write.parquet(f"{path}/vectors")
    # a segment holds about SEGMENT rows, so the list it gathers is bounded
    packed = cut.groupBy(*keys).agg(F.collect_list(F.struct("chunk_id", "code")).alias("all"))
    packed.select(*keys, F.size("all").alias("n"), F.col("all.chunk_id").alias("ids"), _joined(F.col("all.code")).alias("codes")).write.parquet(f"{path}/segments")
    spark.createDataFrame(told, "size int, share double, parts int, centroids array<double>, books array<double>").write.parquet(f"{path}/model")
    fs, placed = shared_files(spark, f"{path}/placed")
    fs.delete(placed, True)


def stored(vectors: DataFrame, path: str, **fit) -> None:
    """:func:`built`, unless the index is there already; it is made beside its place and moved there whole."""
    spark = vectors.sparkSession
    fs, where = shared_files(spark, path)
    if not fs.exists(where):
        draft = f"{path}-{uuid.uuid4().hex}"
        built(vectors, draft, **fit)
        made = shared_files(spark, draft)[1]
        if fs.exists(where) or not fs.rename(made, where):  # another session was first
            fs.delete(made, True)


def _joined(codes: Column) -> Column:
    """Binary values of an array, one after another."""
    return F.unhex(F.array_join(F.transform(codes, F.hex), ""))


def _placed(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), SEGMENT):
            part = batch.slice(i, SEGMENT)
            lists, codes = model.placed(_matrix(part.column(2), model.size))
            yield pa.record_batch([*part.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["conversation_id", "chunk_id", "vector", "list_no", "code"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def opened(spark: SparkSession, path: str) -> tuple[Model | None, DataFrame, DataFrame, DataFrame]:
    """(model, vectors, segments, counts) of the index under ``path``."""
    row = spark.read.parquet(f"{path}/model").first()  # one row of bounded size
    model = row and Model(np.asarray(row["centroids"]).reshape(-1, -(-row["size"] // row["parts"]) * row["parts"]), np.asarray(row["books"]).reshape(row["parts"], CODES, -1), row["size"], row["share"])
    return model, *(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "segments", "counts"))


def _asked(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            near, tables = model.asked(_matrix(part.column(2), model.size))
            flat = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
            yield pa.record_batch([part.column(0), part.column(1), flat, pa.array([t.astype("<f4").tobytes() for t in tables], pa.binary())], names=["query_id", "conversation_id", "near", "scores"])


def _scored(batches: Iterator[pa.RecordBatch], parts: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The best ``keep`` chunks of each (query, segment) row by their codes."""
    at = np.arange(parts) * CODES
    for batch in batches:
        queries, base, tables, ids, codes = batch.columns
        for i in range(len(batch)):
            code = np.frombuffer(codes[i].as_buffer(), dtype=np.uint8).reshape(-1, parts)
            score = np.frombuffer(tables[i].as_buffer(), dtype="<f4")[code + at].sum(axis=1) + base[i].as_py()
            best = np.argpartition(-score, keep)[:keep] if len(score) > keep else np.arange(len(score))
            yield pa.record_batch([queries.take(pa.array(np.full(len(best), i))), ids[i].values.take(pa.array(best)), pa.array(score[best].astype(np.float64))], names=["query_id", "chunk_id", "about"])


def searched(queries: DataFrame, path: str, limit: int = 30, rerank: int | None = 300, share: float | None = None, least: int = 2_000) -> DataFrame:
    """(query_id, chunk_id, dense_score, dense_rank) as ``retrieve.dense_topk`` gives them, for queries (query_id, conversation_id, query_vector).

    share: of the conversation, in place of the model's; 1 reads all lists. rerank: None computes every vector that is read exactly, without its
    code, where its segment lies, and passes on the ``limit`` best of each; with share 1, the result is exact at any size.
    """
    model, vectors, segments, counts = opened(queries.sparkSession, path)
    id_type, query_type = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if model is None:
        return queries.sparkSession.createDataFrame([], f"query_id {query_type}, chunk_id {id_type}, dense_score double, dense_rank int")
    asked = queries.where(_usable("query_vector", model.size)).select("query_id", "conversation_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    tables = asked.mapInArrow(lambda batches: _asked(batches, model), f"query_id {query_type}, conversation_id string, near array<double>, scores binary")
    # a row for each list of the query's conversation, at most as many as the model has lists
    lists = tables.join(counts, "conversation_id").withColumn("base", F.get("near", F.col("list_no"))).drop("near")
    order = Window.partitionBy("query_id").orderBy(F.desc("base"), "list_no")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    read = lists.withColumns({"before": before, "total": total}).where(F.col("before") < F.greatest(F.col("total") * (model.share if share is None else share), F.lit(least)))
    read = read.select("query_id", "conversation_id", "list_no", "base", "scores", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    keys = ["conversation_id", "list_no", "segment"]
    if rerank is None:
        whole = read.select("query_id", *keys).join(asked.drop("conversation_id"), "query_id").join(vectors, keys)
        each = whole.select("query_id", "list_no", "segment", "chunk_id", F.round(retrieve.dot("query_vector", "vector"), 6).alias("dense_score")).groupBy("query_id", "list_no", "segment", "chunk_id").agg(F.max("dense_score").alias("dense_score"))
        own = Window.partitionBy("query_id", "list_no", "segment").orderBy(F.desc("dense_score"), "chunk_id")
        return _first(each.withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit), limit)
    met = read.join(segments, keys).select("query_id", "base", "scores", "ids", "codes")
    parts = len(model.books)
    rough = met.mapInArrow(lambda batches: _scored(batches, parts, rerank), f"query_id {query_type}, chunk_id {id_type}, about double")
    first = rough.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "chunk_id"))).where(F.col("n") <= rerank)
    exact = first.select("query_id", "chunk_id").distinct().join(asked, "query_id").join(vectors.select("conversation_id", "chunk_id", "vector"), ["conversation_id", "chunk_id"])
    return _first(exact.select("query_id", "chunk_id", F.round(retrieve.dot("query_vector", "vector"), 6).alias("dense_score")), limit)


def _first(scored: DataFrame, limit: int) -> DataFrame:
    """The best chunks of each query by (query_id, chunk_id, dense_score), each once."""
    hits = scored.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score"))
    ranked = hits.withColumn("dense_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "chunk_id")))
    return ranked.where(F.col("dense_rank") <= limit)


def exact(queries: DataFrame, vectors: DataFrame, limit: int = 30) -> DataFrame:
    """The rows of ``retrieve.dense_topk`` by matrix products, for many queries; vectors and queries without a place in the index have none here either.

    The products are as many as queries times vectors. They are dealt in cells of about ``CELL`` queries and vectors of a conversation, so a task's memory is
    bounded, and each cell passes on the ``limit`` best of its queries only.
    """
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ["conversation_id", "size"]
    sized = lambda rows, key, vector: rows.where(_usable(vector)).select(F.col("conversation_id").alias("conversation_id"), F.size(vector).alias("size"), key, F.col(vector).cast("array<double>").alias("vector"))
    parts = lambda rows, most, name: rows.groupBy(*own).agg(F.ceil(F.count("*") / most).alias(name))
    asked, rows = sized(queries, "query_id", "query_vector"), sized(vectors, "chunk_id", "vector")
    cells = parts(asked, CELL[0], "q").join(parts(rows, CELL[1], "v"), own)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = asked.join(cells, own).select(*own, F.pmod(F.xxhash64("query_id"), F.col("q")).alias("i"), every("v").alias("j"), "query_id", "vector")
    rows = rows.join(cells, own).select(*own, every("q").alias("i"), F.pmod(F.xxhash64("chunk_id", "vector"), F.col("v")).alias("j"), "chunk_id", "vector")
    dealt = [df.repartition(n, *own, "i", "j").groupBy(*own, "i", "j") for df in (asked, rows)]
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "chunk_id"))}
    near = dealt[0].cogroup(dealt[1]).applyInArrow(lambda a, b: _nearest(a, b, limit), f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, dense_score double")
    ranked = near.withColumn("dense_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "chunk_id")))
    return ranked.where(F.col("dense_rank") <= limit)


def _nearest(asked: pa.Table, rows: pa.Table, limit: int) -> pa.Table:
    """The ``limit`` best rows of each query of a cell, equal ones by chunk_id."""
    rows, found = rows.sort_by("chunk_id"), []
    vectors = _rows(rows)
    for k in range(0, len(asked) if len(rows) else 0, 64):
        part = asked.slice(k, 64)
        score = _rows(part) @ vectors.T
        score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score)
        if len(rows) > limit:
            query, row = np.nonzero(score >= -np.partition(-score, limit - 1, axis=1)[:, limit - 1 : limit])
        else:
            query, row = (x.ravel() for x in np.indices(score.shape))
        order = np.lexsort((row, -score[query, row], query))
        query, row = query[order], row[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < limit
        query, row = query[first], row[first]
        found.append(pa.table([part["query_id"].take(pa.array(query)), rows["chunk_id"].take(pa.array(row)), pa.array(score[query, row])], ["query_id", "chunk_id", "dense_score"]))
    none = pa.table([asked["query_id"].slice(0, 0), rows["chunk_id"].slice(0, 0), pa.array([], pa.float64())], ["query_id", "chunk_id", "dense_score"])
    return pa.concat_tables([none, *found])


def _rows(table: pa.Table) -> np.ndarray:
    return _matrix(table["vector"].combine_chunks(), table["size"][0].as_py())


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, found): how many of the exact hits (query_id, chunk_id) a search has."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
