"""Graphs kept up by changes against graphs built afresh, after random changes."""

import random

import pytest

from tidemark.operators import graph, graph_store

ROWS = "conversation_id string, seq long, source string, relation string, target string, file_id string"
FILES = "conversation_id string, file_id string"


def made(rng, conversation, file, n=12):
    end = lambda: rng.choice(["hub", "", *[f"n{i}" for i in range(6)]])
    return [(conversation, rng.randrange(10_000), end(), rng.choice("RS"), end(), file) for _ in range(n)]


def agrees(spark, path, held):
    """held: {(conversation, file): rows}."""
    rows = [r for own in held.values() for r in own]
    for conversation in {k[0] for k in held} | {"a"}:
        df = spark.createDataFrame([r for r in rows if r[0] == conversation], ROWS).fillna("", ["file_id"])
        fresh = {(r.source, r.relation, r.target, r.seq, r.file_id, r.sightings) for r in graph.dedup_edges(df).collect()}
        own = graph_store.edges(spark, path).where(f"conversation_id <=> {'null' if conversation is None else repr(conversation)}").collect()
        assert {(r.source, r.relation, r.target, r.seq, r.file_id, r.sightings) for r in own} == fresh
        got = {r.node for r in graph_store.nodes(spark, path).where(f"conversation_id <=> {'null' if conversation is None else repr(conversation)}").collect()}
        assert got == {x for e in fresh for x in (e[0], e[2])}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_fresh_graph(spark, tmp_path, seed):
    rng, path, held = random.Random(seed), str(tmp_path / "g"), {}
    names = [(c, f) for c in ("a", "b", None) for f in ("f1", "f2", "f3", None)]
    for step in range(5):
        gone = rng.sample(names, 4) if step else []
        new = [k for k in rng.sample(names, 5)] if step else names
        fresh = {k: made(rng, *k) for k in new}
        graph_store.changed(spark, path, spark.createDataFrame(gone, FILES), spark.createDataFrame([r for own in fresh.values() for r in own], ROWS))
        held = {k: v for k, v in held.items() if k not in gone}
        for k, own in fresh.items():
            held[k] = held.get(k, []) + own
        if step == 2:
            graph_store.merged(spark, path)
            assert len(graph_store.folders(spark, path)) == 1
    agrees(spark, path, held)
    active = [k for k in names if k[0] == "a" and k[1] in ("f1", None)]
    graph_store.pruned(spark, path, spark.createDataFrame([("a",), ("b",)], "conversation_id string"), spark.createDataFrame(active, FILES))
    held = {k: v for k, v in held.items() if k[0] is None or k[0] == "a" and k[1] in ("f1", None)}
    agrees(spark, path, held)


def test_same_rows_twice_go_together_and_a_rebuild_is_one_change(spark, tmp_path):
    path, rows = str(tmp_path / "g"), [("a", 1, "x", "R", "y", "f"), ("a", 2, "y", "R", "z", "g")]
    df = spark.createDataFrame(rows, ROWS)
    for _ in range(2):
        graph_store.changed(spark, path, new=df)
    assert sorted((r.source, r.sightings) for r in graph_store.edges(spark, path).collect()) == [("x", 2), ("y", 2)]
    graph_store.changed(spark, path, gone=spark.createDataFrame([("a", "f")], FILES))
    assert [r.source for r in graph_store.edges(spark, path).collect()] == ["y"]
    assert sorted(r.node for r in graph_store.nodes(spark, path).collect()) == ["y", "z"]
    every = spark.createDataFrame([("a",)], "conversation_id string")
    before = len(graph_store.folders(spark, path))
    graph_store.rebuilt(spark, path, every, df)
    assert len(graph_store.folders(spark, path)) == before + 1 and sorted(r.sightings for r in graph_store.edges(spark, path).collect()) == [1, 1]
    graph_store.cleared(spark, path, every)
    assert graph_store.nodes(spark, path).count() == graph_store.edges(spark, path).count() == graph_store.files(spark, path).count() == 0
    graph_store.ready(spark, path, every, spark.createDataFrame([("a", "g")], FILES), df)
    assert [r.source for r in graph_store.edges(spark, path).collect()] == ["y"]


def test_an_empty_store_and_a_taken_number(spark, tmp_path, monkeypatch):
    path, none = str(tmp_path / "g"), spark.createDataFrame([], ROWS)
    assert graph_store.edges(spark, path).count() == graph_store.nodes(spark, path).count() == 0
    graph_store.changed(spark, path, spark.createDataFrame([], FILES), none)
    assert graph_store.edges(spark, path).count() == 0
    monkeypatch.setattr(graph_store, "folders", lambda *_: [])
    with pytest.raises(RuntimeError):
        graph_store.changed(spark, path, new=none)


def test_a_large_file_is_dealt_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_store, "PIECE", 200)
    path, rng = str(tmp_path / "g"), random.Random(3)
    rows = [("a", i, f"n{rng.randrange(900)}", "R", f"m{rng.randrange(900)}", "f") for i in range(6_000)] + [("a", 9_000, "x", "R", "y", "g")]
    graph_store.changed(spark, path, new=spark.createDataFrame(rows, ROWS))
    graph_store.changed(spark, path, gone=spark.createDataFrame([("a", "g")], FILES))
    graph_store.merged(spark, path)
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "g").glob("*/edges/*/*.parquet")]
    assert max(files) < 300 and len(files) > 40
    held = graph_store.edges(spark, path)
    assert held.rdd.getNumPartitions() > 20 and graph_store.nodes(spark, path).rdd.getNumPartitions() > 5
    agrees(spark, path, {("a", "f"): rows[:-1]})


def test_a_saved_graph_is_packed_and_reads_back(spark, tmp_path):
    rows = [(i, f"n{i}", "R", f"m{i}", "f", f"n{i} R m{i}") for i in range(2_000)]
    edges = spark.createDataFrame(rows, "seq long, source string, relation string, target string, file_id string, evidence string")
    graph.saved(spark.createDataFrame([("n1", "Näme")], "id string, name string"), edges, str(tmp_path / "g"))
    plain = sum(len(r) for r in edges.toJSON().collect())
    assert sum(f.stat().st_size for f in (tmp_path / "g/edges").glob("part-*")) < plain / 4
    nodes, back = graph.loaded(spark, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in back.select(*edges.columns).collect()) == rows and [(r.node, r.name) for r in nodes.collect()] == [("n1", "Näme")]
