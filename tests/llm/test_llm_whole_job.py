"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter

import numpy as np

from tidemark.llm import langid, media, pii


def test_pii_candidates_do_not_hang_on_other_text(spark):
    """Local numbers without a hyphen or at the end of a sentence, and unbroken secrets of any length."""
    numbers = ["555.123.4567", "(555) 123.4567", "555-123-4567"]
    cases = [(f"call {n}{end}", "local_phone", n) for n in numbers for end in ("", ".", "...", ". Then well-known", ", or")]
    cases += [(f"x token={'k9' * n} y", "secret", f"token={'k9' * n}") for n in (4, 64, 65, 100, 50_000)]
    cases += [("call 555.123.4567.8", None, None), ("call 555-123-4567.com", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {(r.doc_id, pii.KINDS[r.kind], r.match, r.start) for r in pii.matches(df).collect() if pii.KINDS[r.kind] in ("local_phone", "secret")}
    assert got == {(i, kind, match, text.index(match)) for i, (text, kind, match) in enumerate(cases) if kind}


def test_distinct_texts_have_distinct_features():
    rng = random.Random(3)
    words = ["the", "river", "lantern", "quiet", "stone", "of", "amber", "north", "+1 (626) 555-5759", "token"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) for _ in range(400)})
    prints = [media.fingerprint(media.from_wav(media.to_wav(x.encode()))) for x in texts]
    assert len({p.tobytes() for p in prints}) == len(texts)
    assert all((p[:, 3] > 0).all() and (p[:, 3] <= media.ZONE).all() for p in prints)
    tones = sum(60 * np.sin(2 * np.pi * b * np.arange(media.FRAME * 9) / media.FRAME) for b in (20, 50))
    found = media.peaks((128 + tones).astype(np.uint8).tobytes())
    assert Counter(map(tuple, found.tolist())) == Counter((t, b) for t in range(36) for b in (20, 50))
    long_ = texts[0].encode() * 3000
    assert (media.peaks(long_[: 192 * 1000], chunk=7) == media.peaks(long_[: 192 * 1000])).all()


def test_language_of_very_long_texts():
    """Several million characters, with many more grams than a few thousand; two languages share letters and most words."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stock = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)] for k, n in (("shared", 6000), ("aa", 3000), ("bb", 3000), ("cc", 3000))}
    text = lambda k, n: " ".join(rng.choices(stock["shared"] + stock[k], k=n))
    langs = ["aa", "bb", "cc"] * 80
    model = langid.fit([text(k, 150) for k in langs], langs)
    long_ = [text(k, 400_000) for k in ("aa", "bb", "cc")]
    assert min(map(len, long_)) > 2_000_000
    scores = model.scores(long_)
    assert [model.languages[i] for i in scores.argmax(axis=1)] == ["aa", "bb", "cc"]
    top = np.sort(scores, axis=1)
    assert ((top[:, -1] - top[:, -2]) > 0.2 * np.abs(top[:, -1])).all()
    parts = list(langid.blocks(long_[0]))
    assert len(parts) > 1 and sum(len(p) - 3 for p in parts) + 3 == len(long_[0])


def test_batched_products_are_those_of_single_texts():
    """Rows of one sparse matrix against dense vectors, however many blocks are multiplied at once; empty and long texts among them."""
    rng = random.Random(3)
    texts = ["", "a", "ab cd", *("".join(rng.choices("abcdef \n", k=rng.choice([5, 80, 900]))) for _ in range(30)), "xyz " * 70_000]
    matrix = np.random.default_rng(1).normal(size=(1 << 12, 3)).astype(np.float32)
    want = []
    for text in texts:
        own = [langid.presence(block, 1 << 12) for block in langid.blocks(text)]
        want.append(sum(matrix[codes].astype(float).sum(axis=0) / np.sqrt(max(1, len(codes))) for codes in own) / len(own))
    rows = langid.Rows.of_texts(texts, 1 << 12)
    for many in (1, 7, 100):
        assert np.allclose(rows.product(matrix, many), want, atol=1e-4)
    assert np.allclose(rows.dense(np.arange(len(texts)), 1 << 12).T.astype(float) @ matrix, want, atol=1e-4)
    assert langid.Rows.of_texts([], 1 << 12).product(matrix).shape == (0, 3)


def test_weights_stay_bounded(monkeypatch):
    monkeypatch.setattr(langid, "WEIGHTS", 1 << 16)
    model = langid.fit(["aaa bbb"] * 4 + ["ccc ddd"] * 4 + ["eee fff"] * 4, ["a"] * 4 + ["b"] * 4 + ["c"] * 4, landmarks=6)
    assert model.weights.size <= 1 << 16 and model.scores(["aaa", "ccc", "eee"]).argmax(axis=1).tolist() == [0, 1, 2]
