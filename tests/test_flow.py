"""The ingest stream: states, commits, a stop between writes, and batches that come again."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, ingest, segments
from tidemark.streaming import flow

EXTRACTORS = {"text": ingest.plain_texts}


def row(i, text, kind="document", name=None):
    return (i, f"c{i % 2}", name or f"f{i}.txt", kind, None if text is None else bytearray(text.encode()))


BATCHES = [
    [row(1, "first words here"), row(2, "will break", "image"), row(3, ""), row(4, "old text of four")],
    [row(2, "now it reads"), row(4, "new text of four\n\nwith more"), row(5, "x", "audio")],
    [row(5, "x", "audio"), row(1, "late break", "video"), row(6, "six", name="a.txt"), row(6, "six again", name="b.txt")],
]


def run(spark, path, batches):
    for n, rows in enumerate(batches):
        flow.applied(spark.createDataFrame(rows, flow.FILES), n, path, EXTRACTORS)
    return state(spark, path)


def state(spark, path):
    store = flow.opened(spark, path)
    lex = store.lexicon().opened()
    list_ = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    fresh = index.built(store.chunks().select("conversation_id", "chunk_id", "text"))
    assert list_(lex.postings, "chunk_id", "term", "tf") == list_(fresh.postings, "chunk_id", "term", "tf")
    assert list_(lex.idf, "conversation_id", "term", "df") == list_(fresh.idf, "conversation_id", "term", "df")
    return list_(store.status(), "file_id", "status", "attempts"), list_(store.chunks(), "file_id", "chunk_id", "text"), list_(store.vectors(), "chunk_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("n"))


def test_states_and_repeats(spark, tmp_path, monkeypatch):
    whole = run(spark, f"file://{tmp_path}/a", BATCHES)
    assert whole[0] == [(1, "retry", 1), (2, "done", 2), (3, "done", 1), (4, "done", 1), (5, "failed", 2), (6, "done", 1)]
    texts = dict((i, t) for i, _, t in whole[1])
    assert set(texts) == {1, 2, 4, 6} and "new text" in texts[4] and "six again" in texts[6] and "first words" in texts[1]
    assert all(n == 1.0 for _, n in whole[2]) and len(whole[2]) == len(whole[1])
    assert run(spark, f"file://{tmp_path}/a", BATCHES) == whole  # all came again

    # stopped after the index changed, and once more before it; then run again
    path, marked, changed = f"file://{tmp_path}/b", flow._marked, segments.changed
    run(spark, path, BATCHES[:1])

    def stop(*_):
        raise OSError("stopped")

    for target, name, real in ((flow, "_marked", marked), (segments, "changed", changed)):
        monkeypatch.setattr(target, name, stop)
        with pytest.raises(OSError):
            flow.applied(spark.createDataFrame(BATCHES[1], flow.FILES), 1, path, EXTRACTORS)
        monkeypatch.setattr(target, name, real)
    before = state(spark, path)
    assert before[0] == [(1, "done", 1), (2, "retry", 1), (3, "done", 1), (4, "done", 1)]
    assert run(spark, path, BATCHES) == whole
