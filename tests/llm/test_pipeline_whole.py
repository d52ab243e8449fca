"""The five stages from end to end against a plain version of each."""

import hashlib
import math
import random
import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from tidemark.llm import queries as Q

BLANKS = " \t\n\x0b\f\r"


def made():
    rng = random.Random(12)
    stock = {"en": [f"th{i}e" for i in range(150)], "de": [f"s{i}ch" for i in range(150)]}
    prose = lambda lang, n: " ".join(rng.choices(stock[lang], k=n))
    rows, base = [], ""
    for i in range(120):
        lang = ["en", "de"][i % 2]
        kind = i % 8
        text = "\n".join(prose(lang, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5)))
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            text = base = prose(lang, 60)
        elif kind == 6:
            text = " ".join([*base.split(" ")[:-1], f"altered{i}"])
        elif kind == 3:
            text = "This line is in many documents\n" + text
        elif kind == 5 and i % 16 == 5:
            text = rng.choice(["", "12 34 -", None])
        rows.append((i, text, lang, ["a", "b", "c", None][i % 4] if i % 5 else "a", len(text or "")))
    return rows


def lined(docs):
    key = lambda x: x.strip(BLANKS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for d, t, *_ in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 2 or d == min(held[key(x)])), s) for d, t, s in docs]


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def nearest(docs):
    sets = [grams(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [doc for i, doc in enumerate(docs) if find(i) == i]


def mixed(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    left, target = {s: [1.0, 2.0, 3.0][i % 3] for i, s in enumerate(sources)}, {}
    while True:
        share = {s: (sum(total.values()) - sum(target.values())) * w / sum(left.values()) for s, w in left.items()}
        over = [s for s, v in share.items() if v > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            del left[s]
    out = Counter()
    for s in sources:
        own = sorted((size(t), hashlib.md5(str(d).encode()).hexdigest(), d, t) for d, t, x in docs if x == s)
        rate, u = target[s] / total[s] if total[s] else 0.0, int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        for k, (_, _, d, t) in enumerate(own, 1):
            out[d, t] += math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
    return +out


def test_all_stages(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, tuple(r.piece_ids), r.lossless) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    lib = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))
    docs = [(d, t, s) for d, t, _, s, _ in rows if t is not None and any(map(str.isalpha, t))]
    assert len(docs) < len(rows)
    after = nearest(lined(docs))
    assert len(after) < len(docs)
    want = Counter()
    for (d, t), n in mixed(after).items():
        want[d, tuple(lib.encode(t)), True] += n
    assert got == want
