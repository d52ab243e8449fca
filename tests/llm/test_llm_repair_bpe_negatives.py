"""Conversation repair, the BPE automaton and hard negatives against plain versions, with odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, hard_negatives, toxicity, turn_repair
from tidemark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]")
#: The roles' language as a plain automaton: 0 start, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows, texts=True):
    """Least (cost, audit) by Dijkstra over (place, state), with the rows that it leaves; rows: (role, text, fault)."""
    done, heap = {}, [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done[i, s] = cost, audit, out
        new = [(3, "I", 0, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, out))
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                new += [(late, "K", 1, role[:1], (role, text))] + [(3 + late, "R", 1, r[0], (r, text)) for r in ("user", "assistant")]
        for price, letter, used, initial, line in new:
            if (s, initial) in STEP:
                heapq.heappush(heap, (cost + price, audit + letter, i + used, STEP[s, initial], (*out, line) if texts else ()))
    cost, audit, out = min(done[len(rows), s] for s in (0, 3) if (len(rows), s) in done)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain_report(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        counts = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counts, illegal, *cheapest(faulty)))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair_of_odd_conversations(spark, tmp_path):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünknown"]
    texts = ["Yes.", "No!", "really?", "cut off", " \t", "", None, "é." * 30_000, "two\nlines.", "Hm. \n"]
    table = [(rng.choice([*range(60), None]), rng.choice([*range(7), None, 10**12]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    table += table[:40] + [(999, t, r, "Same." if t % 3 else f"{t}.") for t in range(400) for r in ("user", "assistant")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Gone."))
    spark.createDataFrame(table, CONVERSATIONS).withColumn("_conv", F.lit(1)).withColumn("fault", F.lit("x")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = Q.op11_conversation_repair(spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    expected = plain_report(table[:-1]) | {(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert len(rows) == len(set(rows)) and set(rows) == expected
    none = spark.createDataFrame([], CONVERSATIONS)
    assert turn_repair.report(none, turn_repair.faults(turn_repair.damaged(none))).count() == 0


@pytest.mark.parametrize("roles", [["user", "assistant", "assistant", "system"], ["tool"], ["system"], ["user"]])
def test_long_conversations(roles):
    """Audits of many pieces, with branches that differ from the first row on."""
    repair, rows = turn_repair.Repair(), []
    rng = random.Random(2)
    for i in range(3000):
        rows.append((rng.choice(roles), f"t{i}.", rng.choice(["", "", "", "blank", "truncated"])))
        repair.row(rows[-1][0], rows[-1][1], {"": 0, "blank": turn_repair.BLANK, "truncated": turn_repair.CUT}[rows[-1][2]])
    assert repair.result()[:2] == cheapest(rows, texts=False)[:2]


def test_short_conversations():
    rng = random.Random(4)
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), f"t{k}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(rng.randrange(14))]
        repair = turn_repair.Repair()
        for role, text, fault in rows:
            repair.row(role, text, {"": 0, "blank": turn_repair.BLANK, "duplicate": turn_repair.DUPLICATE, "truncated": turn_repair.CUT}[fault])
        assert repair.result() == cheapest(rows)


def test_equal_tops_accept_the_same_rest():
    """What may follow hangs on the top alone, so that the least of equal tops is enough."""
    tables, tops = turn_repair.TABLES, defaultdict(set)
    level = [((0, None), 0)]
    for _ in range(7):
        level = [(new, STEP[s, c]) for stack, s in level for c in "sua" if (s, c) in STEP for new in [tables.shifted(stack, c)]]
        for stack, s in level:
            assert all((tables.shifted(stack, c) is not None) == ((s, c) in STEP) for c in "suax")
            assert tables.ends(stack[0]) == (s == 3)
            tops[stack[0]].add(s)
    assert all(len(states) == 1 for states in tops.values())


def merged(word, merges):
    """Plain BPE: the earliest merge that applies, at its leftmost place, again and again."""
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(merges)}
    while found := min(((rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank), default=None):
        (_, c), i = found
        word = [*word[:i], c, *word[i + 2 :]]
    return word


def test_automaton_equals_plain_merging():
    rng = random.Random(6)
    for _ in range(60):
        labels, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randrange(1, 25)):
            a, b = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                merges.append((a, b, len(labels)))
                labels.append(labels[a] + labels[b])
        machine = bpe_automaton.compiled(labels, merges)
        words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 14))) for _ in range(80)] + [b"a" * 40]
        ids, counts = machine.encode(words)
        at = np.concatenate(([0], np.cumsum(counts)))
        for k, word in enumerate(words):
            assert ids[at[k] : at[k + 1]].tolist() == merged([labels.index(bytes([x])) for x in word], merges), (labels, merges, word)
    with pytest.raises(ValueError):
        bpe_automaton.compiled([b"a", b"b", b"ab"], [(0, 1, 2), (1, 0, 2)])


def bpe_texts():
    rng = random.Random(9)
    signs = ["a", "b", " ", "  ", "\n", "\t", ".", ",", "'s", "'ll", "é", "ß", "×", "÷", "中", " ", "　", "\x85", "\x1c", "\r", "12", "٣", "😀", "ꟑ", "<|endoftext|>", "<|endof", "text|>", "-", "İ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1500)]
    return [*texts, "a" * 3000, " " * 2000 + "x", "the river. " * 30_000, None, "", "\n", " ", texts[0], texts[0]]


def test_bpe_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = list(enumerate(bpe_texts())) + [(None, "no id"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op12_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected, ids = [], {}
    for doc, text in rows:
        found = tokenizer.encode(text or "", add_special_tokens=False).ids
        ids.setdefault(doc, found)
        told = tokenizer.decode(found, skip_special_tokens=False)
        expected.append((doc, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)
    few = spark.createDataFrame(rows[:300], "doc_id long, text string")
    encoded = bpe_automaton.encode(few, path)
    assert all(r.ids == ids[r.doc_id] for r in encoded.collect())
    assert {(r.doc_id, r.text) for r in bpe_automaton.decode(encoded, path).collect()} == {(d, t or "") for d, t in rows[:300]}
    part = spark.createDataFrame([(1, [447]), (2, None), (3, []), (4, [447, 50256])], "doc_id long, ids array<int>")
    assert dict(bpe_automaton.decode(part, path).collect()) == {1: tokenizer.decode([447]), 2: "", 3: "", 4: tokenizer.decode([447, 50256], skip_special_tokens=False)}
    assert bpe_automaton.digests(few.limit(0), path).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    labels = rng.choice(4, size=n, p=[0.55, 0.25, 0.15, 0.05])
    x = centres[labels] + 0.7 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in np.float32(x[i])], int(labels[i])) for i in range(n)]


def odd_vectors():
    rows = vectors(600, 6, 1)
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(60)]  # ties, among them anchors and moved labels
    rows += [(2000, None, 1), (2100, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (2200, [float("nan")] + [0.1] * 5, 1), (2300, [float("inf")] + [0.1] * 5, 2), (2400, [0.1] * 6, None), (2500, [0.0] * 6, 2), (2600, [-0.3] * 6, 3)]
    return rows + [rows[0], rows[0], (300, [0.2] * 6, 1)]


def sql_pairs(path):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    return sorted(con.sql(Q.ORACLE_SQL["op13_hard_negatives"]).fetchall())


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_hard_negatives_of_odd_rows(spark, tmp_path, block, monkeypatch):
    """Against the SQL, with blocks and rounds of any size; a label with over half of the rows, ties at every window's end."""
    monkeypatch.setattr(hard_negatives, "DEPTHS", (1, 2, 5, 40))
    df = spark.createDataFrame(odd_vectors(), VECTORS).withColumn("shard", F.lit("x")).withColumn("score", F.lit(2)).withColumn("v", F.lit(2))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 100 == 0, label, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == sql_pairs(tmp_path) and len(found) > 100


def test_hard_negatives_query(spark, tmp_path):
    spark.createDataFrame(vectors(900, 16, 3), VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in Q.op13_hard_negatives(spark, str(tmp_path)).collect()) == sql_pairs(tmp_path)
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    short = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [1.0, 0.0, 0.0], 2), (3, [], 2)], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(short, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 65536)]


def test_search_stops_before_it_has_met_all_rows():
    """The stop is early where few dimensions matter, and results stay those of a full sort."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 4)) * [1, 0.05, 0.05, 0.05])
    rows = [pa.record_batch([pa.array(np.arange(3000)), pa.array(np.zeros(3000, np.int64)), pa.array(x.tolist())], names=["vec_id", "label", "v"])]

    class Context:
        partitionId = staticmethod(lambda: 0)

    hard_negatives.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context)}), hard_negatives.TaskContext
    try:
        packed = list(hard_negatives._packed(iter(rows), 8192, True))[0].to_pylist()[0]
    finally:
        hard_negatives.TaskContext = kept
    block, a = hard_negatives.Block(packed), x[17]
    read = []
    score, block.scores = block.scores, lambda new, a: read.append(len(new)) or score(new, a)
    (ids, scores), = block.search(a, block.thresholds(a[None])[0], 17, 5, None)
    full = sorted(((-int(x[i] @ a), i) for i in range(3000) if i != 17))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == full and sum(read) < 1500
    huge = hard_negatives.Block({"size": 2, "ids": np.array([1, 2]).tobytes(), "vectors": b"d" + np.array([[2.0**40], [2.0**40 + 1]]).tobytes(), "lists": np.array([[1, 0]], np.uint16).tobytes()})
    assert huge.scores(np.array([0, 1]), np.array([2.0**40])).tolist() == [2**80, 2**80 + 2**40] and hard_negatives._clipped(2**80) == 2**63 - 1


def test_toxicity_finds_held_out_rows(spark):
    """One offending word in a long text of plain ones, of which some are rare; held-out rows only count."""
    rng = random.Random(12)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    bad = ["zorx", "quavk", "wuzzy", "vexxit"]
    rows, marks = [], []
    for i in range(1500):
        words = rng.choices(stock, k=rng.randrange(30, 300))
        toxic = int(rng.random() < 0.15)
        for _ in range(toxic * rng.randrange(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, "".join(w + (". " if k % 14 == 13 else " ") for k, w in enumerate(words))))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, Q.fold(5) != 0)
    truth = dict(marks)
    got = [(truth[r.doc_id], r.predicted) for r in toxicity.score(docs.where(Q.fold(5) == 0), model).collect()]
    hits = sum(a and b for a, b in got)
    assert hits >= 0.9 * sum(a for a, _ in got) and hits >= 0.9 * sum(b for _, b in got)
