"""Triples are told with each expression computed once a row, and by all tasks."""

from tidemark.operators import extract


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _times(df, pattern):
    return _plan(df).count(pattern)


def test_names_of_sentences_are_cleaned_once(spark):
    text = "Big Gear uses Small Bolt; the Old Bolt relies on a Gear. Dana Vance works at Gear Works"
    df = extract.sentence_triples(spark.createDataFrame([(1, text), (2, None), (3, "no verb stands here at all"), (4, "Gear Works USES\tSmall Bolt")], "chunk_id long, text string"))
    assert _times(df, extract.LOOSE_END) == 2  # of the source and of the target
    assert "RepartitionByExpression [chunk_id" in _plan(df)
    got = {(r.chunk_id, r.source, r.relation, r.target) for r in df.collect()}
    assert got == {(1, "Big Gear", "INTEGRATES_WITH", "Small Bolt"), (1, "Old Bolt", "DEPENDS_ON", "Gear"), (1, "Dana Vance", "EMPLOYED_AT", "Gear Works"), (4, "Gear Works", "INTEGRATES_WITH", "Small Bolt")}


def test_curriculum_patterns_run_once(spark):
    text = "School of Art\nMinor in Dance\nAdvisor: Vance\nabc123 4 None spring"
    df = extract.curriculum_triples(spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "chunk_id long, text string"))
    assert _times(df, extract.DEPARTMENT.replace("\n", "\\n")) == 1 and _times(df, extract.LOOSE_END) == 2
    assert "RepartitionByExpression [chunk_id" in _plan(df)
    assert {r.relation for r in df.where("chunk_id = 1").collect()} == {"OFFERED_BY", "PART_OF", "ROLE_AS", "HAS_ADVISOR", "AWARDS_CREDITS", "OFFERED_IN"} and df.where("chunk_id > 1").count() == 0
