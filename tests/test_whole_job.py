"""Cases in which an operator once did less than its whole job."""

from tidemark.operators import graph, resolve
from tidemark.plans.answers import traverse
from tidemark.plans.catalogue import extractive_window, index_updated, shortest_path
from tidemark.plans.upkeep import path_hops_metadata


def test_paths_of_any_length(spark):
    chain = [(i, f"n{i}", "NEXT", f"n{i + 1}", "") for i in range(9)]
    edges = spark.createDataFrame(chain + [(20, "n4", "NEXT", "n0", ""), (21, "x", "NEXT", "y", "")], "seq long, source string, relation string, target string, file_id string")
    found = graph.shortest_paths(edges, "n9", "n0").collect()
    assert [(r.path, r.length) for r in found] == [(["n9", "n8", "n7", "n6", "n5", "n4", "n0"], 6)]
    assert graph.shortest_paths(edges.where("seq < 20"), "n0", "n9").first().length == 9
    assert graph.shortest_paths(edges, "n0", "y").count() == 0 and graph.shortest_paths(edges, "x", "x").first().path == ["x"]
    hops = [(r.source, r.target) for r in resolve.traversed(edges.where("seq < 20"), "n0", "n9").collect() if r.part == "path"]
    assert hops == [(f"n{i}", f"n{i + 1}") for i in range(9)]


def test_supplier_path_of_more_than_two_steps(spark, tmp_path):
    """S:1 and S:2 in two nations of one region, with no part in common."""
    tables = {
        "nation": ("n_nationkey int, n_regionkey int", [(1, 0), (2, 0)]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 1)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 1), (2, 2)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long", [(1, 1, 1, 1), (1, 2, 2, 2)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [tuple(r) for r in shortest_path(spark, str(tmp_path)).collect()] == [("S:1>N:1>R:0>N:2>S:2", 4)]
    assert path_hops_metadata(spark, str(tmp_path)).count() == 4


def test_edges_of_a_walk_are_made_once(spark):
    """What follows the walk reads the edges as they were written, not the line items again."""
    assert not [f for f in traverse(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_excerpts_read_the_few_texts_found(spark):
    """The texts of the best chunks are written once; what follows does not move all texts to meet them."""
    found = extractive_window(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "documents" in f]
    assert found.where("score >= 0 and position <= 3").count() == found.count() > 0


def test_lengths_lie_beside_the_terms(spark):
    """No posting is joined to its chunk by the chunk's id."""
    plan = index_updated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "chunk_id" in line]
