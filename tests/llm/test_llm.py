"""The training-data operators against brute force, round trips and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, media, mixing, ngram_join, pii, quality, sentencepiece_fst, token_files, toxicity
from tidemark.llm import queries as Q
from tidemark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, size long, n_lines long, row_key long, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "lantern", "river", "stone", "cloud", "amber", "quiet", "north", "field"]) + rng.choice(["", "s", "ing", "ed", "er"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 80, 40, 120, 30, 70)]
    near = base[1].split()
    near[40] = "changed"
    texts = [*base, base[0], base[0], " ".join(near), None, "", " \n\t ", "???", "one", prose(rng, 5000), "\n".join(["a repeated line of text"] * 4 + ["short", "Another shared line here"]), "  A REPEATED LINE of text\t\nshort\nown line of this text"]
    texts += ["mail a.b@c.org_x@y.de now +1 (626) 555-5759, card 4539 1488 0343 6467 or 1.2.3.4 and 1.2.3.999", "Hallo é日本 über ▁ <|endoftext|> Å  x y  z", "one"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or ""), "e", 0.5, 7, 1, 3, "w") for i, t in enumerate(texts)]
    return out + [(None, "text without id", None, None, 1, None, None, None, None, None, None), out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    if not w:
        return {"\0" + text.strip()} if (text or "").strip() else set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_join_equals_brute_force(docs):
    given = [(r[0], grams(r[1])) for r in rows() if r[0] is not None]
    links = [sum(i != j and bool(a | b) and len(a & b) >= 0.8 * len(a | b) for j, (_, b) in enumerate(given)) for i, (_, a) in enumerate(given)]
    got = Counter((r.doc_id, r.n_links) for r in ngram_join.jaccard_join(docs, block=2).collect() if r.doc_id is not None)
    assert got == Counter((d, n) for (d, _), n in zip(given, links))
    classes = {r.doc_id: r.class_id for r in ngram_join.jaccard_join(docs).collect()}
    assert classes[6] == classes[7] == 0 and classes[8] == 1 and classes[9] == 9 and classes[19] == 13 and classes[None] is None


def test_join_cells_of_a_large_group(spark):
    rng = random.Random(2)
    base = prose(rng, 200).split()
    texts = []
    for i in range(60):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 29) % 200] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    sets = [grams(t) for t in texts]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == want


def test_join_cells_of_texts_of_many_lengths(spark):
    """Texts grow by a few words each, so size steps are crossed by pairs just above and just below the threshold."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[: 30 + 5 * i] + ([f"x{rng.randrange(99)}"] if i % 3 == 0 else [])) for i in range(70)] + [" ".join(base[:104]), " ".join(base[:129])]
    sets = [grams(t) for t in texts]
    assert any(5 * len(a & b) == 4 * len(a | b) for a in sets for b in sets)
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    for block in (6, 20, 1000):
        got = ngram_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).orderBy("doc_id").collect()
        assert [r.n_links for r in got] == want


def test_plan_reaches_recall():
    bands, rows_ = ngram_join.plan(0.8)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9999 and bands * rows_ <= 128


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_mixing(docs, empty):
    got = mixing.expected(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["copies"] <= 3 for r in got)
    total = sum(r["size"] for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in sources.values()) - total) < 1e-6 * total and all(t <= 3 * s + 1e-9 for s, t in sources.values())
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.expected(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 0}
    left, target, total = dict(zip(sizes, (1.0, 2.0, 3.0, 1.0, 2.0))), {}, float(sum(sizes.values()))
    while True:
        share = {k: (total - sum(target.values())) * w / sum(left.values()) for k, w in left.items()}
        over = [k for k, v in share.items() if v > 3 * sizes[k]]
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            del left[k]
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: round(r.target, 6) for r in got} == {k: round(v, 6) for k, v in target.items()}


def test_line_dedup(docs, empty):
    given = [(r[0], r[1] or "") for r in rows()]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for d, t in given:
        for x in t.split("\n"):
            if d is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    want = Counter()
    for d, t in given:
        stay = [x for x in t.split("\n") if d is None or len(held.get(key(x), ())) < 2 or d == min(held[key(x)])]
        want[d, len(t.split("\n")), len(t.split("\n")) - len(stay), "\n".join(stay)] += 1
    got = line_dedup.dedup_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality(docs, empty):
    def brute(t):
        w = WORD.findall(t or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *brute(r[1])) for r in rows())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(empty).count() == 0


def base_spans(t):
    t, out = t or "", []
    luhn = lambda x: sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(x))) % 10 == 0
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    rng = random.Random(9)
    alphabet = list("ab.@_-+ ()1234567890") + ["1.2.3.4", "@x.y", "4539148803436467", "+1 (626) 555-5759", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "9" * 5000, "a" * 5000, ".a" * 3000, "x@" + "a." * 3000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pii.find(df).where("base").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(s) for i, t in enumerate(texts) if (s := base_spans(t))}


def test_pii_query_handles_odd_rows(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    hit = next(r for r in got if r.doc_id == 17)
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (2, 1, 1, 1)
    assert pii.find(empty).count() == 0 and "a.b@c.org" not in pii.redact(docs).where("doc_id = 17").first().text


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 300_000):
        values = (rng.integers(0, 50_000, n) * (rng.random(n) > 0.02) + (rng.random(n) > 0.999) * (2**32 - 60_000)).astype(np.uint32)
        data = token_files.pack(values)
        assert (token_files.unpack(data) == values).all()
        assert (token_files.unpack(data, n // 3, n // 2) == values[n // 3 : n // 2]).all()
    assert (token_files.unpack(token_files.pack(np.full(5, 2**32 - 1, np.uint32))) == 2**32 - 1).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    name = Q.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(name)
    ids = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows()]
    got = token_files.read_tokens(spark, token_files.write_tokens(docs, name, target=500)).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in rows() if r[0] is not None)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, name)).count() == 0


def test_pieces_equal_the_library(docs, empty, tmp_path):
    """The given model, and the same pieces with other rules of the normaliser."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    name = Q.tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde thing  \n\t▁éß日本x<0>.,💥") for _ in range(rng.randrange(30))) for _ in range(3000)] + [" " * k + w + " " * j for k in range(90) for j in (0, 3) for w in ("", "the", "亜x", "zzqq" * 20)]
    model = pb.ModelProto()
    model.ParseFromString(open(name, "rb").read())
    for prefix, single in ((True, False), (False, False), (True, True), (False, True)):
        model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = prefix, single
        (tmp_path / "m").write_bytes(model.SerializeToString())
        ids, counts = sentencepiece_fst.Transducer(str(tmp_path / "m")).encode_batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m")).encode(texts)
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, name), name)
    assert out.columns == [*docs.columns, "piece_ids", "decoded"]
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in out.collect())
    assert sentencepiece_fst.encode(empty, name).count() == 0


def test_whole_machine_has_the_same_path():
    """All states (position, last piece) and all arcs, relaxed in the tropical semiring, against the one state kept a position."""
    own = sentencepiece_fst.machine(Q.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(7)
    for _ in range(300):
        unit = rng.choice(["▁", ""]) + "".join(rng.choice("thingerasolé日.x") for _ in range(rng.randrange(1, 14)))
        best = {(0, ""): (0.0, [])}
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - own.longest), end):
                piece = unit[start:end]
                for (at, last), (d, pieces) in list(best.items()):
                    if at == start and (piece in own.whole or end - start == 1):
                        w = own.weight(last, piece) if last and last in own.whole and piece in own.whole else 0.0
                        w += 0.0 if piece in own.whole else len(piece.encode())
                        if d + w < best.get((end, piece), (np.inf,))[0]:
                            best[end, piece] = (d + w, [*pieces, piece])
        ends = [v for (at, _), v in best.items() if at == len(unit)]
        assert min(ends)[1] == own.path(unit) and sum(v[0] < np.inf for v in ends) == 1


def test_digests_equal_encode(spark, docs):
    name = Q.tokenizer_file("piece_bpe_32k.model")
    own = sentencepiece_fst.machine(name)
    want = Counter()
    for r in rows():
        ids, _ = own.encode_batch(pa.array([r[1] or ""]))
        back = (r[1] or "").replace("▁", " ").encode()
        want[r[0], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sum(i in own.bytes.values() for i in ids.tolist()), hashlib.sha256(back).hexdigest(), back == (r[1] or "").encode()] += 1
    assert Counter(tuple(r) for r in sentencepiece_fst.digests(docs, name).collect()) == want


def test_media(docs, empty):
    got = media.features(media.stored(docs)).collect()
    want = Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[r[0], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes == r.payload_bytes + 44 and r.pairs for r in got)
    told = Counter((r.doc_id, r.feature) for r in media.features(media.stored(docs), as_text=True).collect())
    assert told == Counter((r.doc_id, ",".join(":".join(map(str, p)) for p in r.pairs)) for r in got)
    long_ = next(r for r in got if r.doc_id == 14)
    assert [p.t for p in long_.pairs] == sorted(p.t for p in long_.pairs)
    tone = (128 + 100 * np.sin(2 * np.pi * 32 * np.arange(256 * 16) / 256)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[:, 1].tolist()) == {32}
    assert media.features(media.stored(empty)).count() == 0


def test_language(spark, empty):
    rng = random.Random(6)
    kinds = {"aa": ["the", "thing", "hath", "with"], "bb": ["ñoño", "ción", "para", "que"], "cc": ["über", "schön", "nicht", "zwei"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in ((i, rng.choice(list(kinds))) for i in range(400))] + [(900, None, "aa"), (901, "12 34", "bb"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df, Q.fold(3) != 1, train_rows=150)).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id < 400) and all((r.lang_pred, r.lang_score) == ("und", 0.0) for r in got if r.doc_id >= 900)
    assert langid.train(empty, F.lit(True)) is None and langid.predict(empty, None).count() == 0


def test_toxicity_finds_sentences(spark, empty):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(600):
        parts = [prose(rng, 8).replace(".", "") for _ in range(rng.randrange(1, 9))]
        bad = i % 4 == 0
        if bad:
            parts[k := rng.randrange(len(parts))] += " " + rng.choice(["grumfle", "zotwick"]) + rng.choice(["", "en", "er"])
        data.append((i, ". ".join(parts), k if bad else -1))
        labels.append((i, 1, int(bad)))
    df = spark.createDataFrame([*data, (900, None, -1), (901, "", -1)], "doc_id long, text string, at int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks, Q.fold(5) != 0)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert sum([x.sentence for x in got[i].offending] == [data[i][2]] for i in held if i % 4 == 0) >= 0.9 * sum(i % 4 == 0 for i in held)
    assert got[900].score == got[901].score == 0.0
    assert toxicity.score(empty, model).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql_twins(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    out, ref = Q.QUERIES[name](spark, data), con.sql(Q.ORACLE_SQL[name])
    cols = sorted(out.columns)
    order = [ref.columns.index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in out.collect()) == Counter(tuple(r[i] for i in order) for r in ref.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.near(spark, corpus_pipeline.lines(spark, corpus_pipeline.language(spark, docs, data), data), data)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    left = [grams(r.text) for r in kept.collect()]
    assert not any(a and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    out = corpus_pipeline.run(spark, data)
    assert out.where("not lossless").count() == 0 and out.count() > 0
