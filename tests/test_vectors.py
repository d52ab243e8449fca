"""The vector index against all vectors: clusters, near-random vectors, many conversations, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieve, vectors

ROWS = "conversation_id string, chunk_id long, vector array<double>"
ASKED = "query_id long, conversation_id string, query_vector array<double>"


def frames(spark, data, conversation, every=40):
    rows = [(conversation(i), i, v.tolist()) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame([(i, c, v) for c, i, v in rows if i % every == 0], ASKED)


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def clustered(n, size, centres, noise):
    rng = np.random.default_rng(3)
    middles = unit(rng.normal(size=(centres, size)))
    return unit(middles[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, size)) / size**0.5)


@pytest.mark.parametrize("noise, share", [(0.5, 0.15), (20.0, 1.0)])
def test_recall_in_one_large_conversation(spark, tmp_path, monkeypatch, noise, share):
    monkeypatch.setattr(vectors, "SEGMENT", 100)
    every, asked = frames(spark, clustered(4000, 32, 40, noise), lambda i: "c")
    path = str(tmp_path / "v")
    vectors.built(every, path, lists=32, sample=1500)
    model, stored, segments, counts = vectors.opened(spark, path)
    assert model.share <= share and stored.count() == 4000 == counts.agg({"n": "sum"}).first()[0]
    assert segments.agg({"n": "max"}).first()[0] < 200
    found = vectors.searched(asked, path, limit=10, least=0).cache()
    told = vectors.recall(found, retrieve.dense_topk(asked, every, 10)).agg({"wanted": "sum", "found": "sum"}).first()
    assert told["sum(wanted)"] == 1000 and told["sum(found)"] >= 900
    # what it finds has exact scores
    exact = {(r.query_id, r.chunk_id): r.dense_score for r in retrieve.dense_topk(asked, every, 4000).collect()}
    assert all(exact[r.query_id, r.chunk_id] == r.dense_score for r in found.collect())


def test_small_conversations_and_full_reading_are_exact(spark, tmp_path):
    every, asked = frames(spark, clustered(1200, 30, 10, 5.0), lambda i: "hot" if i % 3 else f"c{i % 7}")
    path = str(tmp_path / "v")
    vectors.stored(every, path, lists=16)
    vectors.stored(every.limit(0), path)  # it is there already
    for options in ({}, {"share": 1.0, "least": 0, "rerank": 1200}):
        got = {tuple(r) for r in vectors.searched(asked, path, 12, **({"rerank": 1200} | options)).collect()}
        assert got == {tuple(r) for r in retrieve.dense_topk(asked, every, 12).collect()}


def test_large_conversations_are_exact_without_codes(spark, tmp_path, monkeypatch):
    """More vectors than are read in full anyway, nearly random, so that a share of the lists would miss some of the best."""
    monkeypatch.setattr(vectors, "SEGMENT", 200)
    every, asked = frames(spark, clustered(5000, 24, 3000, 20.0), lambda i: "c")
    path = str(tmp_path / "v")
    vectors.stored(every, path, sample=1000)
    got = {tuple(r) for r in vectors.searched(asked, path, rerank=None, share=1.0).collect()}
    assert got == {tuple(r) for r in retrieve.dense_topk(asked, every).collect()} and len(got) == 125 * 30
    assert got != {tuple(r) for r in vectors.searched(asked, path, rerank=100).collect()}


def test_odd_rows(spark, tmp_path):
    rows = [("c", 1, [1.0, 0.0, 0.5]), ("c", 2, None), ("c", 3, []), ("c", 4, [1.0, None, 0.0]), ("c", 5, [float("nan"), 0.0, 0.0]), ("c", 6, [1.0, 2.0]), ("c", 7, [0.0, 1.0, 0.0]), ("c", 7, [0.0, 1.0, 0.0]), ("d", 8, [1.0, 1.0, 1.0]), ("c", 9, [0.0, 1.0, 0.0])]
    asked = spark.createDataFrame([(1, "c", [0.0, 2.0, 0.0]), (2, "c", None), (3, "none", [1.0, 0.0, 0.0]), (4, "c", [1.0])], ASKED)
    path = str(tmp_path / "v")
    # one vector of the sample, one of another length: the first in the sample's order gives the length
    vectors.built(spark.createDataFrame([r for r in rows if r[1] != 6], ROWS), path, parts=2)
    got = [tuple(r) for r in vectors.searched(asked, path).orderBy("query_id", "dense_rank").collect()]
    assert got == [(1, 7, 2.0, 1), (1, 9, 2.0, 2), (1, 1, 0.0, 3)]
    for i, none in enumerate(([], rows[1:3])):
        vectors.built(spark.createDataFrame(none, ROWS), f"{path}{i}")
        assert vectors.searched(asked, f"{path}{i}").collect() == [] and vectors.opened(spark, f"{path}{i}")[1].count() == 0


def test_every_part_has_16_codes_and_lists_are_deterministic(spark, tmp_path):
    every, _ = frames(spark, clustered(300, 10, 5, 1.0), lambda i: f"c{i % 50}")
    a, b = (vectors.fitted(every.repartition(n), sample=200, parts=4) for n in (2, 5))
    assert a.books.shape == (4, 16, 3) and np.array_equal(a.centroids, b.centroids) and a.share == b.share
    assert np.allclose(a.books[3, :, 1:], 0)  # components past the tenth


def test_all_products_in_cells(spark, monkeypatch):
    """Equal to dense_topk with copies, ties and several conversations, from cells of a few vectors; rows without a usable vector are no hits."""
    monkeypatch.setattr(vectors, "CELL", (3, 20))
    data = np.repeat(unit(np.random.default_rng(5).normal(size=(60, 8))), 5, axis=0)
    every, asked = frames(spark, data, lambda i: f"c{i % 7 // 3}", every=11)
    odd = spark.createDataFrame([("c0", 900, None), ("c0", 901, [float("nan")] * 8), ("c1", 902, [1.0]), ("none", 903, [1.0] * 8)], ROWS)
    found = vectors.exact(asked, every.union(odd), 12)
    want = {tuple(r) for r in retrieve.dense_topk(asked, every, 12).collect()}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 28 * 12
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    same = every.select(F.col("chunk_id").alias("query_id"), "conversation_id", F.col("vector").alias("query_vector")).where("query_id % 11 = 0")  # queries and vectors of one table
    assert {tuple(r) for r in vectors.exact(same, every, 12).collect()} == want
    assert vectors.exact(asked.where("query_id = 0"), every.where("chunk_id < 20"), 12).count() == every.where("chunk_id < 20 and conversation_id = 'c0'").count()
