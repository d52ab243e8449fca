"""The stored lexical index: changes against a fresh build, sessions, bytes written, merges, and the pruned search against the whole one."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, retrieve, segments
from tidemark.sources import tables

CHUNKS = "conversation_id string, chunk_id long, text string"
WORDS = [f"word{i}" for i in range(120)] + ["1st", "second", "the", "minings", "tested"]


def chunk(rng, i):
    text = rng.choice([None, "", "?!", "the"]) if rng.random() < 0.1 else " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(1, 60)))
    return (f"c{i % 3}", i, text)


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def same(own: index.Index, fresh: index.Index):
    cols = {"postings": ["conversation_id", "term", "chunk_id", "tf", "content"], "stats": ["conversation_id", "chunk_id", "dl"], "corpus": ["conversation_id", "n", "avgdl"], "idf": ["conversation_id", "term", "df", "idf"]}
    for name, c in cols.items():
        assert plain(getattr(own, name).select(*c)) == plain(getattr(fresh, name).select(*c)), name


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "c0", "word1 word5 word77"), (2, "c1", "the 2nd testing of word3, word40"), (3, "c2", "nothing here"), (4, "c9", "word1"), (5, "c0", "word0 word0 word2 word110 mining")], "query_id int, conversation_id string, query string")


def test_changes_equal_a_fresh_build(spark, queries, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/lexicon"
    held = {i: chunk(rng, i) for i in range(160)}
    segments.created(spark.createDataFrame(list(held.values()), CHUNKS), path)
    for _ in range(4):
        other = spark.newSession()
        now = segments.opened(other, path)
        new = [chunk(rng, i) for i in rng.sample(range(260), 9)]
        gone = rng.sample(range(260), 12)
        held = {i: r for i, r in held.items() if i not in gone} | {r[1]: r for r in new}
        segments.changed(now, other.createDataFrame(new, CHUNKS), other.createDataFrame([(g,) for g in gone], "chunk_id long"))
    now = segments.opened(spark, path)
    assert len(now.segments) <= 2 and now.version > 5  # four small neighbours were merged on the way
    fresh = index.built(spark.createDataFrame(list(held.values()), CHUNKS))
    same(now.opened(), fresh)
    for limit in (2, 30):
        expected = plain(retrieve.bm25_topk(queries, fresh, limit))
        assert plain(segments.every(queries, now, limit)) == expected and plain(segments.topk(queries, now, limit)) == expected
    again = [chunk(rng, i) for i in range(0, 240, 3)]
    now = segments.recast(now, spark.createDataFrame(again, CHUNKS))
    held = {i: r for i, r in held.items() if i % 3} | {r[1]: r for r in again}
    same(now.opened(), index.built(spark.createDataFrame(list(held.values()), CHUNKS)))
    swept = segments.swept(now)
    assert swept and segments.versions(spark, path) == [now.version]
    same(segments.opened(spark, path).opened(), index.built(spark.createDataFrame(list(held.values()), CHUNKS)))


def test_a_change_writes_what_it_brings(spark, tmp_path):
    rng = random.Random(4)
    rows = [("c0", i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(60))) for i in range(3000)]
    now = segments.created(spark.createDataFrame(rows, CHUNKS), f"file://{tmp_path}/lexicon")
    before = size(tmp_path)
    after = segments.changed(now, spark.createDataFrame(rows[:30], CHUNKS), spark.createDataFrame([(2999,)], "chunk_id long"))
    assert size(tmp_path) - before < before / 10 and len(after.segments) == 2
    assert after.corpus().first()["n"] == 2999
    with pytest.raises(RuntimeError):  # another writer was first
        segments.changed(now, spark.createDataFrame(rows[:1], CHUNKS))
    with pytest.raises(FileNotFoundError):
        segments.opened(spark, f"file://{tmp_path}/none")


def test_long_lists_are_not_read_whole(spark, tmp_path, monkeypatch):
    """A common word's list and the tails of rare words' lists stay unread; results are those of the whole search."""
    rng = random.Random(5)
    rows = [("c0", i, " ".join(["common"] * rng.randrange(1, 3) + ["seldom"] * (rng.randrange(1, 9) if i % 9 == 0 else 0) + [f"w{rng.randrange(50)}" for _ in range(20)])) for i in range(4000)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    now = segments.created(chunks, f"file://{tmp_path}/lexicon")
    asked = spark.createDataFrame([(1, "c0", "common seldom"), (2, "c0", "seldom"), (3, "c0", "common")], "query_id int, conversation_id string, query string")
    got = segments.found(asked, now, 5)
    assert plain(segments.topk(asked, now, 5)) == plain(retrieve.bm25_topk(asked, index.built(chunks), 5))
    read = {r.query_id: r for r in got.read.collect()}
    assert read[1].scored < 0.1 * read[1].postings and read[2].scored < 0.5 * read[2].postings
    monkeypatch.setattr(segments, "GROUP", 700)  # several groups of a conversation
    split = segments.created(chunks, f"file://{tmp_path}/split")
    assert split.table("blocks").select((F.col("no") / 1_000_000).cast("int")).distinct().count() == 6
    assert plain(segments.topk(asked, split, 5)) == plain(segments.topk(asked, now, 5))


def test_counts_without_an_index(spark, tmp_path):
    """The same statistics as those of an index, with repeated chunks and odd rows, and no row of a posting after the texts were dealt."""
    rows = [("a", 1, "The gears and gear, first"), ("a", 1, "gears again"), ("a", 2, "1st boxes"), ("a", 3, None), ("b", 4, "été gears"), ("b", 5, ""), (None, 6, "lost gears")]
    chunks = spark.createDataFrame(rows, "conversation_id string, chunk_id long, text string")
    counted = segments.term_counts(chunks)
    told = lambda df: sorted((r.conversation_id, r.term, r.df, round(r.idf, 9)) for r in df.collect())
    assert told(counted) == told(segments.created(chunks, str(tmp_path / "x")).idf())
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and not [x for x in plan.split("Exchange hashpartitioning(")[1:] if x.startswith("conversation_id") and "term" in x.split(",")[2]]


def test_no_posting_moves(spark, tmp_path):
    """Lists are made where their chunks are dealt, and a search sums a chunk's postings before a row moves; odd words as the text functions tell them."""
    rng = random.Random(6)
    odd = ["_Gears_ İstanbul 2nd first dies boxes classes", "x __ été_gear naïve\n\tTESTED-minings", "²nd ٣ tests", "KKing ſing"]
    rows = [(f"c{i % 2}" if i % 7 else None, i, rng.choice(odd) + " " + " ".join(rng.choices(WORDS, k=rng.randrange(40)))) for i in range(300)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    same(segments.created(chunks, f"file://{tmp_path}/lexicon").opened(), index.built(chunks))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(segments.blocks_of(segments.docs_of(chunks))) and "Generate" not in plan(segments.blocks_of(segments.docs_of(chunks)))
    now = segments.opened(spark, f"file://{tmp_path}/lexicon")
    hits = plan(segments.matched(retrieve.query_terms(spark.createDataFrame([(1, "c0", "word1 word5")], "query_id int, conversation_id string, query string")), now)[1])
    assert "partial_sum" in hits and hits.count("Exchange hashpartitioning(") == 1


def test_weights_of_the_terms_asked(spark, tmp_path):
    """A search for the weights of a few terms joins the counts before they are summed."""
    own = segments.created(spark.createDataFrame([("c", 1, "pump voltage"), ("c", 2, "pump"), ("d", 3, "pump valve")], "conversation_id string, chunk_id long, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([("c", "pump"), ("c", "pump"), ("c", "none"), ("d", "valve")], "conversation_id string, term string")
    few = own.opened().idf_of(asked)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in own.idf().collect() if (r.conversation_id, r.term) in {("c", "pump"), ("d", "valve")}}
    assert few.count() == 2 and index.Index(None, None, None, own.idf()).idf_of(asked).count() == own.idf().count()
    queries = spark.createDataFrame([(1, "c", "pump voltage?")], "query_id long, conversation_id string, query string")
    hits = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, chunk_id long")
    plan = retrieve.coordination(queries, hits, own.opened())._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[: plan.index("/counts")] if "/counts" in plan else "LeftSemi" in plan


def test_active_files_are_told_without_their_texts(spark):
    """The rows as by the files' statuses; what is joined to the labels holds no text."""
    d = "/root/testdata/sf0.01"
    done = F.coalesce(F.col("status") == "done", F.length("text") > 0)
    assert {r[0] for r in tables.active(spark, d).collect()} == {r[0] for r in tables.files(spark, d).where(done).select("file_id").collect()}
    plan = tables.active(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "text" not in plan[:join].replace("has_text", "") and "has_text" in plan[join:]
