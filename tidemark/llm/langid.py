"""Operator 10: language identification by a string kernel.

The blended-spectrum kernel of two texts is the number of character 1- to 4-grams that both contain,
over the root of the product of their counts. Gram presence is kept over a fixed number of hashed bins, as
the list of the bins that hold a gram. A text of more than BLOCK characters is the mean of its blocks, each
with a norm of its own, so the bins never fill up, however long a text is; all of its blocks count.
Landmarks are taken from the training rows (Nyström); one-versus-rest kernel ridge regression is solved in
the landmark space, and since the kernel is a dot product, landmarks and weights fold into one matrix of
bins by languages: the texts of a batch are the rows of one sparse matrix, and are scored by its product with that one.

Training rows are a sample of bounded expected size, stratified by language and chosen by a hash of
doc_id and text, equal rows once; ``train_rows`` is the bound. Everything else covers all rows.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; languages are those seen
in training, and with none every text is ``und``; ties go to the first language by code point; a very long text
is the mean of all its blocks. Rows are independent, so repeats have equal results; with no rows the result is
empty; other columns stay, whatever their names, but for lang_pred and lang_score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

BINS, ORDERS = 1 << 18, (1, 2, 3, 4)
BLOCK = 1 << 17
WEIGHTS = 1 << 25
_STEP = np.uint32(2654435761)


def presence(points: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bins that hold a gram of the code points, each once."""
    shift = np.uint32(32 - bins.bit_length() + 1)
    code, found = np.zeros(len(points), dtype=np.uint32), []
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        code = (code[:m] + points[n - 1 : n - 1 + m]) * _STEP
        code ^= code >> np.uint32(15)
        found.append(code >> shift)
    codes = np.concatenate(found)
    last, at = np.empty(bins, dtype=np.int32), np.arange(len(codes), dtype=np.int32)
    last[codes] = at
    return codes[last[codes] == at]


def blocks(text: str, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, in blocks of equal length that share the grams across their ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    n = max(1, -(-len(points) // size))
    for k in range(n):
        yield points[k * len(points) // n : (k + 1) * len(points) // n + (ORDERS[-1] - 1 if k < n - 1 else 0)]


@dataclass(frozen=True)
class Rows:
    """The vectors of some texts, the mean over a text's blocks of presence over norm, as one sparse matrix by blocks."""

    n: int
    codes: np.ndarray  # the bins of all blocks, one behind the other
    ends: np.ndarray  # where each block's bins end
    of: np.ndarray  # each block's text
    share: np.ndarray  # what a bin of the block counts

    @classmethod
    def of_texts(cls, texts: Sequence[str], bins: int = BINS) -> Rows:
        codes, of, share = [], [], []
        for i, text in enumerate(texts):
            own = [presence(block, bins) for block in blocks(text)]
            for found in own:
                if len(found):
                    codes.append(found)
                    of.append(i)
                    share.append(1 / np.sqrt(len(found)) / len(own))
        ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
        return cls(len(texts), np.concatenate([*codes, np.empty(0, dtype=np.uint32)]), ends, np.array(of, dtype=np.int64), np.array(share))

    def product(self, matrix: np.ndarray, many: int = 32) -> np.ndarray:
        """Texts by columns: ``many`` blocks at once, dense over the bins that they hold, times these rows of the matrix."""
        out, place = np.zeros((self.n, matrix.shape[1])), np.empty(len(matrix), dtype=np.int32)
        for first in range(0, len(self.ends), many):
            last = min(first + many, len(self.ends))
            begin = int(self.ends[first - 1]) if first else 0
            codes = self.codes[begin : self.ends[last - 1]]
            row = np.repeat(np.arange(last - first), np.diff(self.ends[first:last], prepend=begin))
            held = np.flatnonzero(np.bincount(codes, minlength=len(matrix)))
            place[held] = np.arange(len(held), dtype=np.int32)
            batch = np.zeros((last - first, len(held)), dtype=np.float32)
            batch[row, place[codes]] = self.share[first:last][row]
            np.add.at(out, self.of[first:last], batch @ matrix[held])
        return out

    def dense(self, picked: np.ndarray, bins: int) -> np.ndarray:
        """The vectors of a few of the texts as columns: bins by texts."""
        out = np.zeros((bins, len(picked)), dtype=np.float32)
        for j, i in enumerate(picked):
            for k in np.flatnonzero(self.of == i):
                out[self.codes[self.ends[k - 1] if k else 0 : self.ends[k]], j] += self.share[k]
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # bins x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        return Rows.of_texts(texts, len(self.weights)).product(self.weights)


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-2, group: int = 64) -> Model:
    """Nyström features on every k-th text as landmark, and ridge regression on them; ``group`` landmarks are dense at once.

    The weights, which every task gets, have at most WEIGHTS entries: with over 128 languages the bins halve until they do.
    """
    names = tuple(sorted(set(langs)))
    bins = min(BINS, 1 << (max(1, WEIGHTS // len(names)).bit_length() - 1))
    rows = Rows.of_texts(texts, bins)
    order = np.argsort(np.array([names.index(x) for x in langs]), kind="stable")
    pick = order[np.unique(np.linspace(0, len(texts) - 1, min(landmarks, len(texts))).astype(int))]
    groups = [pick[i : i + group] for i in range(0, len(pick), group)]
    kernel = np.zeros((len(texts), len(pick)))
    for i, own in enumerate(groups):
        kernel[:, i * group : i * group + len(own)] = rows.product(rows.dense(own, bins))
    values, vectors = np.linalg.eigh((kernel[pick] + kernel[pick].T) / 2)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    y = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    share = y.sum(axis=0)
    weight = (1 / share)[y.argmax(axis=1)] * len(y) / len(names)  # languages count alike
    solved = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * len(y) * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
    folded = (root @ solved).astype(np.float32)
    weights = np.zeros((bins, len(names)), dtype=np.float32)
    for i, own in enumerate(groups):
        weights += rows.dense(own, bins) @ folded[i * group : i * group + len(own)]
    return Model(names, weights)


def train(docs: DataFrame, usable: Column, train_rows: int = 1600) -> Model | None:
    """Fits on about ``train_rows`` usable rows with a language and a letter, as many of each language."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = train_rows / len(counts)
    chance = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, share / n))])[F.col("lang")]
    hashed = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(hashed < chance).select("doc_id", "text", "lang").distinct()
    sample = sorted((r["text"], r["lang"]) for r in picked.toLocalIterator())
    if not sample:
        return None
    texts, langs = zip(*sample)
    return fit(list(texts), list(langs))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and lang_score to the documents; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(at), 1_000_000):
                texts = batch.column(at)[i:j].to_pylist()
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                good = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
                for g in range(0, len(good), 512):
                    part = good[g : g + 512]
                    found = model.scores([texts[k] for k in part])
                    for k, best, s in zip(part, found.argmax(axis=1).tolist(), found.max(axis=1).tolist()):
                        langs[k], scores[k] = model.languages[best], min(1.0, max(0.0, s))
                yield pa.record_batch([*[c[i:j] for c in batch.columns], pa.array(langs), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{schema}, lang_pred string, lang_score double")
