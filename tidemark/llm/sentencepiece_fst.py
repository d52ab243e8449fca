"""Operator 2: SentencePiece encoding and decoding as a shortest path in a weighted transducer.

Three machines are compiled from the model file and composed with each input:

normaliser  reads characters and writes marked text: a blank becomes U+2581, one stands in front if the model asks for it,
            and where the model removes extra blanks, further ones, and those at the ends, are read and not written (to
            that rule, U+2581 itself is a blank at the end only)
pieces      reads the characters of a piece and writes its id; arcs are found by a piece's last three characters
fallback    reads one character that no piece covers and writes its bytes, at a weight of 1 a byte

States of the composed machine are (position, last piece). A token sequence is what the merge procedure of a byte-pair
model gives exactly when every two neighbours keep their boundary if merged on their own, so the arc from a last
piece to the next weighs 0 where the pair keeps its boundary and infinity elsewhere. In the tropical semiring (least sum), a
state's distance is the least over its arcs of a predecessor's distance plus the arc's weight. Each prefix has one
sequence of finite weight, so of the states of a position one has a finite distance, and it alone is kept.

No piece holds U+2581 after another character, and none holds a line feed, so a text falls into units at these
places, exactly. Units repeat: each task encodes a distinct unit once, in a bounded memo. The blanks of a run tie in
weight; the merge procedure joins them from the left, so their arcs take the longest piece first, and the last blank goes
with the word behind if the two merge.

Defined results: a null or empty text has no ids; U+2581 in a text reads as a blank, as in the library, so such a
text does not come back unchanged; decoding drops the blank in front. Rows are independent, so ties and repeats have
equal results; batches are cut by bytes, and a very long text costs its own length; with no rows the result is
empty; other columns stay, whatever their names, but for those that are added, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, laid_out, lists, slices, text_slices

SPACE = "▁"


class Normaliser:
    """The machine from characters to marked text, without a table of replacements."""

    def __init__(self, spec):
        if spec.precompiled_charsmap:
            raise ValueError("a normaliser without a table of replacements is needed")
        self.prefix, self.single = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def texts(self, texts: pa.Array) -> pa.Array:
        """What the machine writes for each text, with blanks for U+2581 and without the mark in front."""
        plain = pc.fill_null(texts, "")
        if self.single:
            plain = pc.utf8_ltrim(pc.replace_substring_regex(plain, " +", " "), characters=" ")
        plain = pc.replace_substring(plain, SPACE, " ")
        return pc.utf8_rtrim(plain, characters=" ") if self.single else plain


class Transducer:
    """Pieces, byte fallback and the weights of piece pairs of a byte-pair model."""

    def __init__(self, path: str, memo: int = 100_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("a byte-pair model is needed")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.prefix = self.normaliser.prefix
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a unit's boundary")
        self.longest = max(map(len, self.ids))
        self.whole = {p: p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        lengths: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: sorted(n, reverse=True) for t, n in lengths.items()}  # lengths of pieces by their last three characters
        self.pairs: dict[tuple[str, str], float] = {}
        self.memo = Memo(self.units, memo)
        # a unit may also end between an ASCII letter and a stop or comma, if no piece holds such a pair
        self.cut = not any(re.search("[A-Za-z][.,]", p) for p in self.ids)
        self.output = [b""] * len(model.pieces)
        for p, i in self.ids.items():
            self.output[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.output[i] = bytes([b])
        self.table = pa.array(self.output, pa.large_binary())

    def merged(self, text: str) -> list[str]:
        """The merge procedure: join the best-scored neighbours, leftmost first, while any pair is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, left: str, right: str) -> float:
        """The weight of the arc from a last piece to the next: 0, or infinity where the two would not keep their boundary."""
        found = self.pairs.get((left, right))
        if found is None:
            found = 0.0 if left not in self.whole or self.merged(left + right) == [left, right] else math.inf
            if len(self.pairs) < 200_000:
                self.pairs[left, right] = found
        return found

    def path(self, unit: str, last: list[str] | None = None) -> list[str]:
        """The pieces of the shortest path; characters outside the pieces stand for themselves.

        last: the live states of a prefix of the unit, one a position; it is extended to the whole unit.
        """
        last = [""] if last is None else last
        whole, tails, pairs, none = self.whole.get, self.tails.get, self.pairs.get, ()
        for end in range(len(last), len(unit) + 1):
            for size in (*tails(unit[end - 3 : end], none), 2, 1) if end > 2 else (2, 1):
                if size > end:
                    continue
                piece = whole(unit[end - size : end])
                if piece is None:
                    continue
                before = last[end - size]
                weight = pairs((before, piece))
                if weight is None:
                    weight = self.weight(before, piece)
                if weight == 0.0:  # the one arc of finite weight into this position
                    last.append(piece)
                    break
            else:
                last.append(unit[end - 1])  # the fallback's arc
        out, end = [], len(unit)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def unit_ids(self, unit: str, last: list[str] | None = None) -> list[int]:
        pieces = self.path(unit, last) if unit.count(SPACE) <= 1 else self._run(unit)
        ids: list[int] = []
        for p in pieces:
            if p in self.ids:
                ids.append(self.ids[p])
            else:
                ids += [self.bytes[b] for b in p.encode()]
        return ids

    def units(self, units: list[str]) -> list[list[int]]:
        """Ids of many units. In sorted order, a unit starts from the states of the prefix it shares."""
        out: list[list[int]] = [[]] * len(units)
        last, before = [""], ""
        for k in sorted(range(len(units)), key=units.__getitem__):
            unit = units[k]
            if unit.count(SPACE) > 1:
                out[k] = self.unit_ids(unit)
                continue
            n, most = 0, min(len(unit), len(before))
            while n < most and unit[n] == before[n]:
                n += 1
            del last[n + 1 :]
            out[k] = self.unit_ids(unit, last)
            before = unit
        return out

    def _run(self, unit: str) -> list[str]:
        """A unit after a run of blanks: the last blank goes with the word if they merge."""
        word = unit.lstrip(SPACE)
        blanks = len(unit) - len(word)
        if not word:
            return self._blanks(blanks)
        tail = self.path(SPACE + word)
        return self._blanks(blanks - 1) + tail if tail[0] != SPACE else self._blanks(blanks) + tail[1:]

    def _blanks(self, n: int) -> list[str]:
        """A run of n blanks: the longest pieces first, as the tied merges leave it."""
        out = []
        while n:
            size = next(k for k in range(min(n, self.longest), 0, -1) if SPACE * k in self.ids)
            out.append(SPACE * size)
            n -= size
        return out

    _UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text's ids; equal units are looked up once."""
        blank = self.normaliser.texts(texts)
        plain = pc.replace_substring(blank, "\n", " \n")
        if self.cut:  # the mark of a cut is a line feed after the blank, twice
            plain = pc.replace_substring_regex(plain, "([A-Za-z])([.,])", "\\1 \n\n\\2")
        offsets, words = lists(pc.split_pattern(plain, " "))
        codes, distinct = coded(words)
        units = [w[2:] if w[:2] == "\n\n" else w if w[:1] == "\n" else SPACE + w for w in distinct]
        empty = np.array([not w for w in distinct], dtype=bool)[codes]
        ids, ends = laid_out(self.memo.lookup(units), codes, offsets)
        counts = np.diff(ends)
        odd = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(empty)))[offsets]))  # texts with runs of blanks
        first = np.flatnonzero(np.asarray(pc.starts_with(plain, " ")))  # or that begin with one
        odd = np.union1d(odd, first)
        if not self.prefix:
            odd = np.arange(len(counts))
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, own in zip(odd.tolist(), self._runs([blank[k].as_py() for k in odd.tolist()])):
                parts[k] = own
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, counts

    def _runs(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with runs of blanks, by their units, which the memo knows as well."""
        found = [self._UNITS.findall((SPACE if self.prefix and t else "") + t.replace(" ", SPACE)) for t in texts]
        codes, distinct = coded(pa.array([u for units in found for u in units], pa.string()))
        offsets = np.concatenate(([0], np.cumsum([len(units) for units in found])))
        ids, ends = laid_out(self.memo.lookup(distinct), codes, offsets)
        return np.split(ids, ends[1:-1])

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids write, less the blank in front."""
        if not len(ids):
            return [b""] * len(counts)
        written = self.table.take(pa.array(ids))
        ends = np.frombuffer(written.buffers()[1], dtype="<i8")[np.concatenate(([0], np.cumsum(counts)))].tolist()
        raw = memoryview(written.buffers()[2])
        skip = 1 if self.prefix else 0
        return [bytes(raw[a + skip if raw[a : a + 1] == b" " else a : b]) for a, b in zip(ends, ends[1:])]


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def encode(docs: DataFrame, model: str, check: bool = False) -> DataFrame:
    """The documents with piece_ids; rows are independent and keep their other columns.

    check: adds lossless, whether the ids decode to the text (null: empty), in the same pass.
    """
    docs = docs.drop("piece_ids", "lossless") if check else docs.drop("piece_ids")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in batches:
            for i, j in text_slices(batch.column(at), 2_000_000):
                ids, counts = own.encode_batch(batch.column(at)[i:j])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                added = {"piece_ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))}
                if check:
                    plain = pc.fill_null(batch.column(at)[i:j], "").cast(pa.binary()).to_numpy(zero_copy_only=False)
                    added["lossless"] = pa.array([x == y for x, y in zip(own.decode_batch(ids, counts), plain)], pa.bool_())
                yield pa.record_batch([*[c[i:j] for c in batch.columns], *added.values()], names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, piece_ids array<int>" + ", lossless boolean" * check)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with decoded, the text of their piece_ids."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in batches:
            sizes = np.diff(lists(batch.column(at))[0])
            for i, j in slices(sizes, 500_000):
                part = batch.slice(i, j - i)
                offsets, flat = lists(part.column(at))
                texts = [x.decode("utf-8", "replace") for x in own.decode_batch(np.asarray(flat), np.diff(offsets))]
                yield pa.record_batch([*part.columns, pa.array(texts)], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit), n_byte_pieces, decoded_sha256, lossless.

    Encodes and decodes a batch in one pass, so ids do not leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        low, high = min(own.bytes.values()), max(own.bytes.values())
        for batch in batches:
            for i, j in text_slices(batch.column(1), 2_000_000):
                ids, counts = own.encode_batch(batch.column(1)[i:j])
                ends = np.concatenate(([0], np.cumsum(counts)))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                in_bytes = np.concatenate(([0], np.cumsum((ids >= low) & (ids <= high))))[ends]
                back = own.decode_batch(ids, counts)
                plain = batch.column(1)[i:j].cast(pa.binary()).to_numpy(zero_copy_only=False)
                same = [x == y for x, y in zip(back, plain)]
                sha = [hashlib.sha256(x).hexdigest() for x in back]
                yield pa.record_batch([batch.column(0)[i:j], pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(in_bytes), pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "n_byte_pieces", "decoded_sha256", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, decoded_sha256 string, lossless boolean")
