"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the weights of its
words, where a word's weight is the sum over its hashed whole form and its hashed prefixes of 4, 5 and 6
letters; the document's probability is the noisy-or 1 - prod(1 - p). Training needs document labels only:
the gradient of the noisy-or likelihood flows to the sentences. Weights are never below 0, and bins that few documents hold have none.
The noisy-or that parts the labels best in cross-validation within the training rows becomes the score 0.5. Sentences at 0.5 or
more locate the offence.

Training rows are a sample of bounded expected size, chosen by a hash of doc_id among the usable labelled
rows, as many of each label as ``train_rows`` allows; whole texts. Scoring covers every row: words are
coded by Arrow, each distinct word of a batch is weighed once, and sums run over code arrays.

Defined results: a null or empty text has score 0 and no offending sentence; the score of a very long text
is the noisy-or of all its sentences. With no usable label of one kind the weights stay at their start, and all
scores are near 0. Rows are independent, so ties and repeats have equal scores; of rows that repeat a doc_id, the
one with the least hash of its text may enter the sample; rows of labels that repeat a doc_id are joined by their
greatest label. With no rows the result is empty; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, lists, text_slices

BINS, PREFIXES = 1 << 18, (4, 5, 6)
SENTENCE_END = r"[.!?\n]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_bins(word: str) -> list[int]:
    """Bins of a lower-cased word: whole form and prefixes."""
    forms = ["=" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]
    return [xxhash.xxh32_intdigest(x) & (BINS - 1) for x in forms]


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Sentence offsets of each text, word codes, distinct words, and each word's sentence."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    of_text, parts = lists(pc.split_pattern_regex(lowered, SENTENCE_END))
    of_sentence, words = lists(pc.split_pattern_regex(parts, NOT_WORD))
    codes, distinct = coded(words)
    return of_text, codes, distinct, np.repeat(np.arange(len(parts)), np.diff(of_sentence))


@dataclass(frozen=True)
class Model:
    """weights of bins (never below 0), the bias of a sentence, and the noisy-or that becomes the score 0.5."""

    weights: np.ndarray
    bias: float
    cut: float = 0.5

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, sentence offsets, probability of each sentence."""
        of_text, codes, distinct, sentence = sentences(texts)
        weight = np.array([self.weights[word_bins(w)].sum() if w else 0.0 for w in distinct], dtype=np.float64)
        z = self.bias + np.bincount(sentence, weights=weight[codes], minlength=of_text[-1])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        filled = np.bincount(sentence, weights=np.array([bool(w) for w in distinct], dtype=np.float64)[codes], minlength=of_text[-1]) > 0
        p = np.where(filled, p, 0.0)
        log = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))))
        return self.placed(1 - np.exp(log[of_text[1:]] - log[of_text[:-1]])), of_text, self.placed(p)

    def placed(self, p: np.ndarray) -> np.ndarray:
        """Probabilities with their odds divided by those of the cut, so that 0 and 1 stay and the cut is 0.5."""
        return p * (1 - self.cut) / (p * (1 - self.cut) + self.cut * (1 - p))


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: the bins of its words, the sentence of each, and the number of sentences."""
    bags = []
    for i in range(0, len(texts), 200):
        of_text, codes, distinct, sentence = sentences(pa.array(texts[i : i + 200]))
        bins = [np.array(word_bins(w), dtype=np.int32) if w else np.zeros(0, np.int32) for w in distinct]
        text_of = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))[sentence]
        bounds = np.searchsorted(text_of, np.arange(len(of_text)))
        for k in range(len(of_text) - 1):
            own = codes[bounds[k] : bounds[k + 1]]
            sizes = np.array([len(bins[c]) for c in own], dtype=np.int64)
            bags.append((np.concatenate([bins[c] for c in own]) if len(own) else np.zeros(0, np.int32), np.repeat(sentence[bounds[k] : bounds[k + 1]] - of_text[k], sizes), int(of_text[k + 1] - of_text[k])))
    return bags


def _solved(bags: list, y: np.ndarray, steps: int, rate: float, batch: int, least: int) -> Model:
    """Adagrad on the noisy-or likelihood with weights of at least 0, over bins found in ``least`` bags or more.

    Evidence only adds: with weights below 0, a long sentence's plain words would outweigh its one offending word. Rare
    bins would be learned by heart.
    """
    counts = np.bincount(np.concatenate([np.unique(b[0]) for b in bags]), minlength=BINS)
    kept = np.flatnonzero(counts >= least)
    place = np.full(BINS, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    own = [(place[b[0]], b[1], b[2]) for b in bags]
    own = [(f[f >= 0], s[f >= 0], n) for f, s, n in own]
    w, bias = np.zeros(len(kept)), -6.0
    seen, seen_bias = np.full(len(kept), 1e-3), 1e-3
    rng = np.random.default_rng(3)
    for _ in range(max(1, -(-steps * batch // len(own)))):
        order = rng.permutation(len(own))
        for i in range(0, len(order), batch):
            part = [own[k] for k in order[i : i + batch]]
            label = y[order[i : i + batch]]
            sizes = np.array([b[2] for b in part])
            shift = np.cumsum(sizes) - sizes
            feature = np.concatenate([b[0] for b in part])
            sentence = np.concatenate([b[1] + s for b, s in zip(part, shift)])
            z = bias + np.bincount(sentence, weights=w[feature], minlength=sizes.sum())
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            bag = np.repeat(np.arange(len(part)), sizes)
            miss = np.exp(np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(part)))
            pull = np.where(label == 1, -miss / np.maximum(1 - miss, 1e-4), 1.0)
            g = p * pull[bag]
            grad = np.bincount(feature, weights=g[sentence], minlength=len(kept))
            hit = np.flatnonzero(grad)
            step = grad[hit] / len(part)
            seen[hit] += step**2
            w[hit] = np.maximum(w[hit] - rate * step / np.sqrt(seen[hit]), 0.0)
            step = g.sum() / len(part)
            seen_bias += step**2
            bias -= 0.05 * step / np.sqrt(seen_bias)
    weights = np.zeros(BINS, dtype=np.float32)
    weights[kept] = w
    return Model(weights, float(bias))


def fit(texts: list[str], labels: list[int], steps: int = 1200, rate: float = 1.0, batch: int = 64, least: int = 5) -> Model:
    """Trains on all texts; the cut is the one of the best F1 of two halves, each scored by a model of the other."""
    y, bags = np.array(labels, dtype=np.float64), _bags(texts)
    if len(set(labels)) < 2:
        return Model(np.zeros(BINS, dtype=np.float32), -6.0)
    half, told = np.arange(len(bags)) % 2, np.zeros(len(bags))
    # halves are taken within each label, so that both hold both
    half[np.argsort(y, kind="stable")] = np.arange(len(bags)) % 2
    cut = 0.5
    if min((y == 1).sum(), (y == 0).sum()) >= 10:
        for k in (0, 1):
            model = _solved([b for b, h in zip(bags, half) if h != k], y[half != k], steps // 2, rate, batch, least)
            rows = np.flatnonzero(half == k)
            for i in range(0, len(rows), 200):
                told[rows[i : i + 200]] = model.score(pa.array([texts[r] for r in rows[i : i + 200]]))[0]
        order = np.argsort(-told, kind="stable")
        found = np.cumsum(y[order])
        f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
        best = int(np.argmax(f1))
        after = told[order[best + 1]] if best + 1 < len(order) else 0.0
        cut = float(np.clip((told[order[best]] + after) / 2, 0.02, 0.98))
    whole = _solved(bags, y, steps, rate, batch, least)
    return Model(whole.weights, whole.bias, cut)


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = 4000) -> Model:
    """Fits on about ``train_rows`` usable labelled rows, half of each label where there are enough."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("toxic") == label, min(1.0, train_rows / 2 / n)).otherwise(chance)
    hashed = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(hashed < chance)
    # the picked ids are bounded by train_rows, so the documents side is not shuffled; one text an id
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("row"))
    sample = sorted((r["text"] or "", int(r["toxic"])) for r in rows.select("row.*").toLocalIterator())
    return fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, n_sentences, offending: array of (sentence number, probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                scores, of_text, p = model.score(batch.column(1)[i:j])
                bad = np.flatnonzero(p >= offending)
                row = np.searchsorted(of_text, bad, side="right") - 1
                where = pa.StructArray.from_arrays([pa.array((bad - of_text[row]).astype(np.int32)), pa.array(p[bad])], names=["sentence", "probability"])
                offsets = pa.array(np.searchsorted(bad, of_text).astype(np.int32))
                yield pa.record_batch(
                    [batch.column(0)[i:j], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(np.diff(of_text).astype(np.int32)), pa.ListArray.from_arrays(offsets, where)],
                    names=["doc_id", "score", "predicted", "n_sentences", "offending"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_sentences int, offending array<struct<sentence:int,probability:double>>")
