"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and every stage."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, line_dedup, media, mixing, ngram_join, pii, quality, sentencepiece_fst, token_files, toxicity
from tidemark.llm import queries as Q

OWN = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = (
    "row row_key node code head unit i j side times codes grams component class_id stays _id _key id key drop lines h1 h2 pos first_id in0 in1 doc_text words coded windows placed found "
    "n_words kept base_failed k0 k1 k2 copies rows like before target size source_size part rate rank digest spans kind start end match base idx toxic score h lang_score lang_pred piece_ids lossless decoded "
    "media n_bytes pairs gram_key n_grams bands n_lines n_dropped _spans _row _copies _row0 _rows _nth"
).split()


def base_rows():
    rng = random.Random(3)
    stock = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choices(stock, k=n)) + "."
    a, b = prose(60), prose(50)
    texts = [a, a, b, b + " tail", None, "", "  \n\t ", "42 17", "one", prose(20_000), "a shared line of text\n" + prose(30), "A SHARED line of text \n" + prose(30), "mail x.y@z.org or 1.2.3.4", "w1 " * 40]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, a, None, None, None), (None, None, None, None, None), (3, "another text of document three, unlike any", "en", "s1", 5), rows[0], rows[0], rows[9]]


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(base_rows(), OWN).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"x{i}").alias(c) if i % 2 else F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def models(plain):
    rng = random.Random(1)
    words = {"en": ["the", "with"], "de": ["und", "nicht"]}
    texts = [" ".join(rng.choices(words[k], k=9)) for k in ("en", "de") * 20]
    return langid.fit(texts, ["en", "de"] * 20, landmarks=16), toxicity.fit(["bad vile words", "calm river"] * 20, [1, 0] * 20, steps=40)


def piece_file():
    return Q.tokenizer_file("piece_bpe_32k.model")


APPLIED = {
    "mix": lambda df, m: mixing.mix(df),
    "expected": lambda df, m: mixing.expected(df).select("doc_id", "size", "target", "copies"),
    "encode": lambda df, m: sentencepiece_fst.decode(sentencepiece_fst.encode(df, piece_file(), check=True), piece_file()),
    "digests": lambda df, m: sentencepiece_fst.digests(df, piece_file()),
    "toxicity": lambda df, m: toxicity.score(df, m[1]),
    "join": lambda df, m: ngram_join.jaccard_join(df),
    "near": lambda df, m: ngram_join.dedup(df),
    "tokens": lambda df, m: token_files.read_tokens(df.sparkSession, token_files.write_tokens(df, Q.tokenizer_file("word_bpe_49k.json"))),
    "quality": lambda df, m: quality.judge(df, sample_rows=5),
    "media": lambda df, m: media.features(media.stored(df)),
    "pii": lambda df, m: pii.find(df),
    "redact": lambda df, m: pii.redact(df),
    "line_dedup": lambda df, m: line_dedup.dedup_lines(df),
    "language": lambda df, m: langid.predict(df, m[0]),
}
#: What an operator adds under a name of its own stands there in place of a column that came with the rows.
ADDED = {"encode": ["piece_ids", "lossless", "decoded"], "quality": [*quality.MEASURES, "kept"], "line_dedup": ["n_lines", "n_dropped"], "language": ["lang_pred", "lang_score"]}


def counted(df, columns):
    return Counter(repr([r[c] for c in columns]) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_clashing_columns_change_nothing(plain, clashing, models, name):
    apply = APPLIED[name]
    out, other = apply(plain, models), apply(clashing, models)
    keeps = set(plain.columns) <= set(out.columns)
    if keeps:  # the operator returns the rows it got
        assert set(other.columns) == set(clashing.columns) | set(ADDED.get(name, []))
        untouched = [c for c in CLASH if c not in ADDED.get(name, [])]
        assert len({repr([r[c] for c in untouched]) for r in other.select(*untouched).collect()}) == 1
    got = counted(out, out.columns)
    assert got == counted(other, out.columns)
    if name not in ("mix", "near", "pii"):
        assert sum(got.values()) == len(base_rows())


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_empty_table(clashing, models, name):
    assert APPLIED[name](clashing.limit(0), models).count() == 0


def test_training_on_nothing(spark, clashing):
    empty = clashing.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.train(empty, F.lit(True)) is None
    assert toxicity.score(clashing, toxicity.train(empty, labels, F.lit(True))).agg(F.max("score")).first()[0] < 0.05


def test_near_keeps_one_row_of_a_class(spark):
    """Rows go by doc_id and text: a text that shares its doc_id with a copy stays, and so does one row of equal ones."""
    rng = random.Random(4)
    text = lambda: " ".join(f"v{rng.randrange(9999)}" for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (None, near, "x"), (None, a, "x"), (9, d, "x"), (9, d, "x"), (9, d, "y"), (None, d, "z"), (11, None, "x"), (12, "", "x")]
    got = Counter((r.doc_id, r.text) for r in ngram_join.dedup(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect())
    assert got == Counter([(3, a), (5, b), (7, c), (9, d), (11, None), (12, "")])


def test_equal_rows_share_their_copies(spark):
    """Many equal rows are mixed like as many documents, and together they have as many copies as they were given."""
    rows = [(1, "one two three", None, "s", 1)] * 40 + [(1, "one two three", None, "s", 2)] * 7 + [(i, "four five", None, "t", 3) for i in range(2, 12)]
    docs = spark.createDataFrame(rows, OWN)
    assert mixing.mix(docs).count() == mixing.expected(docs).agg(F.sum("copies")).first()[0]


def test_recall_is_reached_at_any_threshold():
    for threshold in (0.02, 0.05, 0.3, 0.5, 0.8, 0.95):
        bands, rows = ngram_join.plan(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 - 1e-12


def test_chained_texts_are_verified_by_bucket(spark):
    """A long chain of texts that each share passages with the next: few links, one component, and every link is found."""
    rng = random.Random(6)
    words = [f"u{rng.randrange(99999)}" for _ in range(600)]
    texts = [" ".join(words[12 * i : 12 * i + 130]) for i in range(36)]
    grams = [{tuple(t.split()[k : k + 5]) for k in range(126)} for t in texts]
    for threshold in (0.3, 0.8):
        want = [sum(i != j and len(a & b) >= threshold * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)]
        got = ngram_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold, block=6).orderBy("doc_id").collect()
        assert [r.n_links for r in got] == want


def test_stages(spark, plain, tmp_path):
    """Each stage on odd rows and on no rows; all but the last return the columns of documents."""
    docs = plain.select("*", F.lit("kept").alias("more"), F.lit(1).alias("n_lines"), F.lit(2).alias("row"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert name == "pieces" or out.columns == docs.columns
        assert out.count() > 0


def test_scores_by_plain_sums(models):
    """Kernel ridge regression over sets of n-grams, and the noisy-or of sentences, computed plainly."""
    import numpy as np

    rng = random.Random(2)
    stock = {k: ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(30)] for k in "xyz"}
    texts = [" ".join(rng.choices(stock[k] + stock["x"], k=12)) for k in "xyz" * 12]
    langs = list("xyz" * 12)
    model = langid.fit(texts, langs, landmarks=36, ridge=1e-2)
    grams = [{t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)} for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = (np.array(langs)[:, None] == np.array(model.languages)[None, :]).astype(float)
    values, vectors = np.linalg.eigh(kernel)
    phi = kernel @ vectors / np.sqrt(values)
    solved = np.linalg.solve(phi.T @ phi + 1e-2 * len(y) * np.eye(len(y)), phi.T @ y)
    assert np.abs(model.scores(texts) - phi @ solved).max() < 5e-3
    weights = models[1]
    for text in ("Bad words. calm river! vile", "", "...", "river"):
        miss = 1.0
        for sentence in __import__("re").split(r"[.!?\n]+", text.lower()):
            words = [w for w in __import__("re").split(r"[\W_]+", sentence) if w]
            if words:
                z = weights.bias + sum(float(weights.weights[b]) for w in words for b in toxicity.word_bins(w))
                miss *= 1 - 1 / (1 + math.exp(-z))
        assert abs(weights.score(pa.array([text]))[0][0] - weights.placed(1 - miss)) < 1e-6


def test_added_spans_of_planted_texts(spark):
    """Numbers and secrets planted among prose are added, look-alikes are not, and base spans stay."""
    rng = random.Random(8)
    words = ["river", "stone", "amber", "north", "quiet", "field", "cloud"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        kind = i % 4
        if kind == 0:
            planted, name = rng.choice(["call {}", "phone {}", "fax: {}"]).format(f"{rng.randrange(2, 10)}{digits(2)}-{rng.randrange(2, 10)}{digits(2)}-{digits(4)}"), "local_phone"
        elif kind == 1:
            planted, name = f"social {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "ssn"
        elif kind == 2:
            planted, name = rng.choice(["token=", "password:", "api_key="]) + "".join(rng.choice("abcdefghkmXYZ23456789") for _ in range(20)), "secret"
        else:
            planted, name = rng.choice([f"part {digits(3)}-{digits(1)}-{digits(4)}", f"in {digits(4)}", f"v{digits(2)}.{digits(2)}", f"000-{digits(2)}-0000"]), None
        rows.append((i, f"{prose(rng.randrange(3, 9))} {planted} {prose(rng.randrange(3, 9))}"))
        if name:
            want[i] = name
    found = [(r.doc_id, pii.KINDS[r.kind]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.base]
    right = sum(want.get(i) == k for i, k in found)
    print("precision", right / len(found), "recall", right / len(want))
    assert right / len(found) >= 0.95 and right / len(want) >= 0.95


def test_features_by_plain_loops():
    """Peaks and pairs of a short payload, by a plain Fourier sum."""
    import cmath

    payload = media.from_wav(media.to_wav(b"The quiet river, 42 stones; amber? north & field. " * 9))
    n = len(payload) // media.HOP
    ring = payload + payload[: media.FRAME - media.HOP]
    found = []
    for t in range(n):
        frame = ring[t * media.HOP : t * media.HOP + media.FRAME]
        window = [0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME) for k in range(media.FRAME)]
        mean = sum(x * w for x, w in zip(frame, window)) / sum(window)
        spectrum = [abs(sum((x - mean) * w * cmath.exp(-2j * math.pi * f * k / media.FRAME) for k, (x, w) in enumerate(zip(frame, window)))) for f in range(media.FRAME // 2 + 1)]
        tops = [f for f in range(1, media.FRAME // 2) if spectrum[f] > spectrum[f - 1] and spectrum[f] >= spectrum[f + 1] and spectrum[f] >= media.FLOOR * max(spectrum[1:-1])]
        found += [(t, f) for f in sorted(sorted(tops, key=lambda f: -spectrum[f])[: media.PEAKS])]
    peaks = list(map(tuple, media.peaks(payload).tolist()))
    assert len(set(peaks) ^ set(found)) <= 0.02 * len(found)  # float rounding may swap near ties
    pairs = []
    for k, (t, f) in enumerate(peaks):
        later = [p for p in peaks if p[0] > t][: media.FAN]
        pairs += [(t, f, g, u - t) for u, g in later if u - t <= media.ZONE]
    assert list(map(tuple, media.fingerprint(payload).tolist())) == pairs
