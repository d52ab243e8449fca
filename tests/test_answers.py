"""Answers end to end, and the texts around them, on small cases."""

import json

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import answer, graph, resolve

QUERIES = [(1, "c", "What voltage does the reactor pump need?"), (2, "c", "Zebra migration calendar dates"), (3, "c", "anything unknown")]
TEXTS = {1: ["Intro line here\nThe reactor pump needs a voltage of 400 units", "Other words only"], 2: ["Nothing of that kind at all"]}


def frames(spark):
    queries = spark.createDataFrame(QUERIES, "query_id long, conversation_id string, query string")
    rows = [(q, i + 1, 0.9 - i / 10, "document", t) for q, ts in TEXTS.items() for i, t in enumerate(ts)]
    return queries, spark.createDataFrame(rows, "query_id long, position int, final_score double, file_type string, text string")


def test_extractive_answers(spark):
    queries, passages = frames(spark)
    got = {r.query_id: r.answer for r in answer.extractive(queries, passages).collect()}
    assert got[1].startswith("Intro line here\nThe reactor pump") and "400 units [1]" in got[1]
    assert got[2] == answer.OFF_TOPIC and got[3] == answer.NO_SOURCES


def test_synthesis_retries_once(spark):
    queries, passages = frames(spark)
    asked = []

    def retrieve(q):
        asked.append(sorted(r.query_id for r in q.collect()))
        return passages.join(q.select("query_id"), "query_id", "left_semi")

    got = {r.query_id: r for r in answer.synthesized(queries, retrieve, lambda df: df).collect()}
    assert asked == [[1, 2, 3], [2, 3]]
    assert not got[1].retried and got[1].groundedness == 1.0 and got[1].n_claims >= 1 and got[1].confidence == "high"
    assert got[2].retried and got[2].n_claims == 0 and not got[3].retried
    # nothing cited counts as grounded, which lifts the critic's low to medium
    assert got[2].confidence == got[3].confidence == "medium"
    events = answer.stages(answer.synthesized(queries, retrieve, lambda df: df), passages).where("query_id = 1").orderBy("seq").collect()
    assert [r.event for r in events] == ["route", "retrieve", "confidence", "answer", "verify", "done"]
    assert json.loads(events[1].data)["n_passages"] == 2


def test_texts(spark):
    row = spark.range(1).select(
        T.evidence_span(F.lit("[00:05] a [1:10 - 01:20] b")).alias("span"),
        answer.effective_stamp(F.lit("none"), F.lit("00:00")).alias("placeholder"),
        answer.effective_stamp(F.lit(None).cast("string"), F.lit("")).alias("nothing"),
        answer.stamp_excerpt(F.lit("x" * 100 + "12:30 said"), F.lit("12:30")).alias("excerpt"),
        answer.stamp_excerpt(F.lit("abc"), F.lit("")).alias("no_stamp"),
        answer.unmarked(F.lit("# A **b** *c*  [d](e) *(Note: f)*")).alias("plain"),
        answer.json_text(F.lit('```json\n{"t": [{"a": 1}, {"b')).alias("cut"),
        answer.json_text(F.lit("x")).alias("bad"),
    ).first()
    assert (row.span, row.placeholder, row.nothing, row.no_stamp) == ("00:05 - 01:20", "00:00", None, None)
    assert row.excerpt == "... " + "x" * 80 + "12:30 said ..." and row.plain == "A b c d"
    assert json.loads(row.cut) == {"t": [{"a": 1}]} and row.bad == "{}"


def test_traverse_keeps_the_path_first(spark):
    edges = spark.createDataFrame([(1, "a", "R", "b", ""), (2, "c", "R", "b", ""), (3, "c", "R", "d", ""), (4, "e", "R", "f", "")], "seq long, source string, relation string, target string, file_id string")
    got = [(r.source, r.target, r.part) for r in resolve.traversed(graph.dedup_edges(edges), "a", "c", depth=2).orderBy("hop_no").collect()]
    assert got == [("a", "b", "path"), ("b", "c", "path"), ("c", "b", "search"), ("c", "d", "search")]
