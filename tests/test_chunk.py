"""Packing by cuts against a plain fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunk


def fold(parts, target, glue):
    out = []
    for part in parts:
        if out and len(out[-1]) + len(part) + 2 <= target:
            out[-1] += glue + part
        else:
            out.append(part)
    return out


@pytest.mark.parametrize("glue", ["\n", "\n\n", ""])
def test_packing_is_the_fold(spark, glue):
    rng = random.Random(5)
    texts = [["x" * rng.choice([1, 3, 9, 10, 11, 19, 20, 21, 60]) for _ in range(rng.randrange(0, 60))] for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, []), (902, ["y" * 500])]
    got = chunk.packed(spark.createDataFrame(rows, "id int, parts array<string>"), "parts", 22, glue, "n", "text").collect()
    assert {(r.id, r.n): r.text for r in got} == {(i, n): t for i, p in rows for n, t in enumerate(fold(p or [], 22, glue))}


def test_long_pages_and_their_numbers(spark):
    rng = random.Random(6)
    pages = [["p" * rng.randrange(1, 900) for _ in range(rng.choice([1, 2, 9, 30]))] for _ in range(40)]
    text = "\n\n".join(f"[Page {i + 1}]\n" + "\n\n".join(p) for i, p in enumerate(pages))
    got = chunk.by_pages(spark.createDataFrame([(1, "f", text), (2, "g", None), (3, "h", " ")], "file_id long, filename string, text string")).orderBy("chunk_index").collect()
    want = [(i + 1, c) for i, p in enumerate(pages) for c in (["\n\n".join(p)] if len("\n\n".join(p)) <= 2400 else fold(p, 1800, "\n\n"))]
    assert [(r.page_number, r.text.split("\n", 1)[1]) for r in got] == want
    assert [r.chunk_index for r in got] == list(range(len(want))) and {r.file_id for r in got} == {1}


def test_work_is_linear(spark):
    """Eight times the text takes nowhere near the 64 times the work of a fold that copies its list."""
    def seconds(mb):
        line = F.lit("a line of some forty characters, as it is")
        rows = spark.range(1).select(F.lit(1).alias("file_id"), F.lit("f").alias("filename"), F.repeat(F.concat(line, F.lit("\n\n")), F.lit(mb * 1_000_000 // 43)).alias("text"))
        began = time.time()
        n = chunk.by_blocks(rows).agg(F.sum(F.length("text"))).head()[0]
        assert n > mb * 900_000
        return time.time() - began

    seconds(1)
    few, many = seconds(2), seconds(16)
    assert many < 24 * max(few, 0.5)
