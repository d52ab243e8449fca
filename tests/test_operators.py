"""Worked examples of the operators."""

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunk, graph, index, ingest, retrieve, session, synthesis
from tidemark.streaming.ingest import ingest as stream_ingest


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_stems(spark):
    words = "policies makes boxes classes glass ties running thing used bus".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == "policy make boxe classe glass tie runn th used bus".split()


def test_tokens(spark):
    r = one(spark, a=T.tokens(F.lit("Running 2nd a-b")), b=T.tokens(F.lit("café elle")), c=T.tokens(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == (["running", "runn", "2nd", "second"], ["elle"], [])


def test_names_and_times(spark):
    r = one(spark, a=T.canonical_id(F.lit("Dr. David Vance")), b=T.canonical_id(F.lit("2024")), c=T.canonical_id(F.lit("Department of Physics")), d=T.media_time(F.lit(75)), e=T.media_time(F.lit(3675)), f=T.similarity(F.lit("abcd"), F.lit("ABCE")), g=T.seconds_of(F.lit("[01:15 - 02:00]")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("ENTITY_DAVID_VANCE", "ENTITY_VAL_2024", "ENTITY_OF_PHYSICS", "01:15", "01:01:15", 0.75, 75)


def test_bm25_baseline(spark):
    chunks = spark.createDataFrame([("c", 1, "document", "aa bb"), ("c", 2, "document", "aa cc")], "conversation_id string, chunk_id long, file_type string, text string")
    asked = spark.createDataFrame([(7, "c", "bb")], "query_id long, conversation_id string, query string")
    got = {r.chunk_id: r.bm25_score for r in retrieve.bm25_topk(asked, index.built(chunks)).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_fusion_values(spark):
    """Ranks (3, 2), coverage 0.2949 and weight 1.0 give 0.4419; ranks (2, 3) at 0.1815 give 0.0295."""
    chunks = spark.createDataFrame([(1, "audio"), (2, "audio")], "chunk_id long, file_type string")
    dense = spark.createDataFrame([(7, 1, 0.5, 3), (7, 2, 0.6, 2)], "query_id long, chunk_id long, dense_score double, dense_rank int")
    sparse = spark.createDataFrame([(7, 1, 1.0, 1.0, 2), (7, 2, 0.9, 0.9, 3)], "query_id long, chunk_id long, bm25_raw double, bm25_score double, bm25_rank int")
    ratios = spark.createDataFrame([(7, 1, 0.2949), (7, 2, 0.1815)], "query_id long, chunk_id long, ratio double")
    weights = spark.createDataFrame([(7, "audio", 1.0)], "query_id long, file_type string, weight double")
    got = {r.chunk_id: r for r in retrieve.fuse(dense, sparse, ratios, chunks, weights).collect()}
    assert abs(got[1].final_score - 0.4419) < 2e-4 and abs(got[2].final_score - 0.0295) < 2e-4
    assert got[1].confidence_tier == "HIGH" and got[1].modality_boost == 0.075


def test_chunks(spark):
    text = "[Recording]\n[00:08 - 00:14] first line\n[00:15 - 00:20] second"
    files = spark.createDataFrame([(1, "my_talk.mp3", text), (2, "x.txt", None), (3, "y.txt", "  ")], "file_id long, filename string, text string")
    got = chunk.by_blocks(files).collect()
    assert [(r.file_id, r.timestamp) for r in got] == [(1, "00:08 - 00:14")] and got[0].text.startswith("[my talk.mp3]\n")
    long_ = "\n\n".join(["x" * 1000] * 3)
    pages = spark.createDataFrame([(1, "a-b.pdf", f"[Page 1]\nshort\n\n[Page 2]\n{long_}")], "file_id long, filename string, text string")
    assert [(r.chunk_index, r.page_number) for r in chunk.by_pages(pages).orderBy("chunk_index").collect()] == [(0, 1), (1, 2), (2, 2), (3, 2)]
    plain = spark.createDataFrame([(1, "x" * 7000)], "file_id long, text string")
    assert [(r.start, len(r.text)) for r in chunk.sliding(plain).orderBy("start").collect()] == [(0, 3500), (3100, 3500), (6200, 800)]


EDGES = [(1, "Project Alpha", "DEPENDS_ON", "PostgreSQL", "pdf"), (2, "Alice", "DESIGNED", "Project Alpha", "pdf"), (3, "David", "APPROVED", "Security Audit", "audio"), (4, "Security Audit", "VERIFIED", "PostgreSQL", "audio")]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES + [(5, *EDGES[0][1:]), (6, "x", "SAME", "x", "pdf")], "seq long, source string, relation string, target string, file_id string")
    kept = graph.dedup_edges(edges)
    assert {(r.seq, r.sightings) for r in kept.collect()} == {(1, 2), (2, 1), (3, 1), (4, 1)}
    path = graph.shortest_paths(kept, "Alice", "David").first()
    assert path.length == 4 and path.path[2] == "PostgreSQL"
    reached = graph.bfs(kept, spark.createDataFrame([("Alice",)], "node string"), 3)
    assert {r.seq for r in graph.hops(kept, reached, 3).collect()} == {1, 2, 4}
    assert graph.prune(kept, spark.createDataFrame([("pdf",)], "file_id string")).count() == 2
    nodes = spark.createDataFrame([("The CSE minor",), ("computer science and engineering",)], "node string")
    made = graph.bridges(nodes, kept, [("cse", "computer science and engineering")]).collect()
    assert [(r.source, r.target) for r in made] == [("The CSE minor", "computer science and engineering")]


def test_verification(spark):
    answers = spark.createDataFrame([(1, "The port is 8000 on the gateway [1]. Unicorns govern Atlantis quietly [2].")], "answer_id long, answer string")
    passages = spark.createDataFrame([(1, 1, "The gateway listens on port 8000."), (1, 2, "Security audits took place.")], "answer_id long, passage_number int, text string")
    checked = synthesis.verified(synthesis.claims(answers), passages)
    assert [r.status for r in checked.orderBy("claim_no").collect()] == ["VERIFIED", "UNSUPPORTED"]
    assert synthesis.groundedness(checked).first().groundedness == 0.5
    r = one(spark, a=synthesis.final_confidence(F.lit(1.0), F.lit(0), F.lit("low")), b=synthesis.intent(F.lit("hello there")), c=synthesis.intent(F.lit("hi, open the file")), d=synthesis.is_followup(F.lit("what about physics?")))
    assert (r.a, r.b, r.c, r.d) == ("medium", "CASUAL", "CORPUS_QUERY", True)


def test_sessions_and_sources(spark):
    long_ = "q" * 45
    r = one(spark, a=session.auto_title(F.lit("New Conversation"), F.lit(long_)), b=ingest.keyframes(F.lit(30.0)), c=ingest.keyframes(F.lit(100.0)), d=ingest.keyframes(F.lit(1.5)), e=ingest.decoded(F.unhex(F.lit("636166E9"))))
    assert r.a == "q" * 40 + "..." and r.b == [2, 14, 26] and r.c == [2, 14, 26, 38, 50, 62] and r.d == [0.5] and r.e == "café"
    old = spark.createDataFrame([(1, "a")], "chunk_id long, text string")
    assert index.add_new(old, spark.createDataFrame([(1, "b"), (2, "c")], "chunk_id long, text string")).count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a.txt", "one paragraph\n\nanother")], "file_id long, filename string, text string").write.parquet(str(tmp_path / "in"))
    stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_models_are_tried_in_turn(spark):
    import pandas as pd

    from tidemark.operators import ports

    def broken(batch):
        raise OSError("no answer")

    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "k long, text string")
    model = ports.rotated([broken, lambda b: b["text"].str.len()])
    assert [r.n for r in ports.applied(rows, ["text"], "n", "long", model).orderBy("k").collect()] == [1, 2]
    silent = ports.rotated([broken], otherwise=lambda b: pd.Series([0] * len(b)))
    assert {r.n for r in ports.applied(rows, ["text"], "n", "long", silent).collect()} == {0}


def test_new_files_of_a_folder(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    done = spark.createDataFrame([("b.txt",)], "filename string")
    assert [(r.filename, bytes(r.content)) for r in ingest.new_files(spark, str(tmp_path), done).collect()] == [("a.txt", b"a.txt"), ("c.txt", b"c.txt")]


def test_pruning_takes_lonely_nodes(spark):
    edges = spark.createDataFrame([(1, "a", "R", "b", "f"), (2, "b", "R", "c", "g")], "seq long, source string, relation string, target string, file_id string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    kept, left = graph.pruned(nodes, edges, spark.createDataFrame([("f",)], "file_id string"))
    assert sorted(r.node for r in kept.collect()) == ["a", "b"] and left.count() == 1
    assert [x.count() for x in graph.pruned(nodes, edges, spark.createDataFrame([], "file_id string"))] == [0, 0]


def test_claims_meet_their_passage_in_one_row(spark, monkeypatch):
    """Many claims on one text: the joined rows are as many as passages, and each claim gets what a plain comparison gives, whatever fits in memory at once."""
    import re

    from tidemark.functions import text as T

    passage = "Pumps raised 12 units in Q3. Short. The KKelvin reactor_pump needs cafés!  Voltages were raised twice \nRaised voltages twice again? _x9_ tail words here"
    said = ["raised voltage twice", "kelvin pump", "pump, pump and unknown things", "", "the of and", "caf needs", "nothing matches zebra", "tail words x9 here", "12th unit"]
    claimed = spark.createDataFrame([(1, i, 1 + i % 2, c) for i, c in enumerate(said)] + [(2, 0, 1, "pump")], "answer_id long, claim_no int, passage_number int, claim string")
    passages = spark.createDataFrame([(1, 1, passage), (1, 2, passage), (2, 2, "x")], "answer_id long, passage_number int, text string")

    def words(c):
        base = [w for w in re.split(r"[^\w]+", c.lower()) if w]
        return [t for w in base for t in T.tokens_of(w) if T.tokens_of(w)[0] not in T.STOPWORD_SET and len(t) > 2]

    sentences = [s.strip(" ") for s in re.split(r"(?<=[.!?\n])\s+", passage) if len(s.strip(" ")) > 10]
    want = {}
    for i, c in enumerate(said):
        w = words(c)
        score = [sum(t in s.lower() for t in w) / max(len(w), 1) if w else 1.0 for s in sentences]
        best = max(score)
        grounded = not w or sum(t in passage.lower() for t in w) / len(w) >= synthesis.IN_PASSAGE or best >= synthesis.IN_SENTENCE
        want[1, i] = (grounded, (sentences[score.index(best)] if best > 0 else passage[:200]).strip())
    want[2, 0] = (False, "")
    checked = synthesis.verified(claimed, passages)
    assert {(r.answer_id, r.claim_no): (r.is_grounded, r.evidence) for r in checked.collect()} == want
    assert "collect_list" in checked._jdf.queryExecution().executedPlan().toString()
    lower, usable = [s.lower() for s in sentences], synthesis.np.arange(len(sentences))
    texts = [" ".join(re.split(r"\W+", c.lower())) for c in said]
    whole = [c.tolist() for c in synthesis._held(texts, lower, usable)]
    monkeypatch.setattr(synthesis, "CELLS", 1)
    assert [c.tolist() for c in synthesis._held(texts, lower, usable)] == whole
