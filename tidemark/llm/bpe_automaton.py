"""Operator 12: byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that BPE yields. It starts with one state and a loop for
each byte, and takes the merges in order, one gadget each: for the merge a b -> ab, the state after ab is the state
after b, ab is an arc wherever a is one, and the arc b goes from the state after a. A gadget changes the state after a
alone, so tokens share a state until one of them is the left side of a merge, and share an arc class until one of them is the right
side; the transition table is (states x arc classes) bits, about 20 MB for 50,000 merges. A merge whose arc b is gone already
can never apply; its token is dead.

A pre-split word is encoded by running the trie of the arcs' labels over its bytes: at each place one token ends whose arc
leaves the state reached where it starts, as the accepted sequence is unique, and the path back from the end is the encoding.
Decoding emits the labels of the arcs. Texts are pre-split as the tokenizer does it; before that they are cut at places that it
splits whatever stands around, so that each distinct cut is encoded once; the memo is bounded and only saves work.

Defined results: a null text is empty, and an empty text has no ids; the string of an added token in a text is that token, as in the
library; a very long text is cut like any other, and a long run without a cut takes memory in proportion to its length. Rows
are independent: ties and repeated rows have equal results, and with no rows the result is empty. Other columns are not read,
whatever their names. Files with a normaliser, another splitter, doubled merge results or added tokens that strip or match whole
words are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, laid_out, ragged, slices, text_slices

#: Bytes of texts in a run, and of words encoded together.
RUN, WORDS = 3_000_000, 400_000


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level files: itself where it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Automaton:
    """State after each token, arc class of each token, transition bits, and the trie of the labels of live tokens."""

    state: np.ndarray
    arc: np.ndarray
    bits: np.ndarray
    trie_keys: np.ndarray
    trie_token: np.ndarray

    def allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        arc = self.arc[token]
        return (self.bits[state, arc >> 3] >> (arc & 7).astype(np.uint8)) & 1 == 1

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's node below, or 0 (the root is node 0; node k + 1 is entered by trie_keys[k])."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
        return np.where(self.trie_keys[at] == key, at + 1, 0).astype(np.int32)

    def __post_init__(self):
        byte = np.arange(256, dtype=np.int32)
        self.first = self.child(np.zeros(256, np.int32), byte)
        self.second = np.where(np.repeat(self.first, 256) > 0, self.child(np.repeat(self.first, 256), np.tile(byte, 256)), 0)

    def matches(self, flat: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and token of every token found in the bytes; end: of the word that holds each byte."""
        at, node = np.arange(len(flat), dtype=np.int32), self.first[flat]
        found = [(at, np.ones(len(flat), np.int32), self.trie_token[node])]
        at = at[:-1][end[:-1] > at[1:]]
        node, depth = self.second[flat[at].astype(np.int32) << 8 | flat[at + 1]], 2
        while True:
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                return tuple(np.concatenate(x) for x in zip(*found))
            token = self.trie_token[node]
            hit = token >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth, np.int32), token[hit]))
            more = at + depth < end[at]
            at = at[more]
            node, depth = self.child(node[more], flat[at + depth]), depth + 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-empty words, and the number of each word's ids."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        ends = np.cumsum(sizes, dtype=np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        start, length, token = self.matches(flat, ends[word])
        longest = int(sizes.max(initial=0))
        local = (start - (ends - sizes)[word[start]]).astype(np.uint16 if longest < 1 << 16 else np.int32)
        order = np.argsort(local, kind="stable")
        # a word of n bytes has n + 1 boundaries, of which the first has the start state
        source, token, length = (start + word[start])[order], token[order], length[order]
        reached, last, back = (np.zeros(len(flat) + len(words), dtype=np.int32) for _ in range(3))
        waves = np.concatenate(([0], np.cumsum(np.bincount(local, minlength=longest))))
        for i, j in zip(waves[:-1].tolist(), waves[1:].tolist()):
            ok = self.allowed(reached[source[i:j]], token[i:j])
            t, n = token[i:j][ok], length[i:j][ok]
            to = source[i:j][ok] + n
            reached[to], last[to], back[to] = self.state[t], t, n
        on_path = np.zeros(len(reached), dtype=bool)
        number = np.arange(len(words), dtype=np.int32)
        here, first = ends + number, ends - sizes + number
        while len(here):
            on_path[here] = True
            here = here - back[here]
            here, first = here[here > first], first[here > first]
        return last[on_path], np.bincount(np.repeat(number, sizes + 1)[on_path], minlength=len(words))


def compiled(labels: list[bytes], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of tokens with these labels; merges are (left, right, result) in order, all other tokens single bytes."""
    made = {c for _, _, c in merges}
    if len(made) < len(merges):
        raise ValueError("two merges have the same result")
    state, arc = np.full(len(labels), -1, np.int32), np.full(len(labels), -1, np.int32)
    base = [t for t in range(len(labels)) if t not in made and len(labels[t]) == 1]
    state[base] = arc[base] = 0
    table = np.zeros((256, 256), dtype=bool)
    table[0, 0] = True
    in_state, in_arc = [len(base) + 1], [len(base)]  # the start state is state 0 as well, so it is never changed

    def room() -> None:
        nonlocal table
        for axis, n in ((0, len(in_state)), (1, len(in_arc))):
            if n >= table.shape[axis]:
                table = np.concatenate((table, np.zeros_like(table)), axis=axis)

    for a, b, c in merges:
        if state[a] < 0 or state[b] < 0 or not table[state[a], arc[b]]:
            continue
        state[c] = state[b]
        in_state[state[b]] += 1
        room()
        if in_state[state[a]] > 1:
            table[len(in_state)] = table[state[a]]
            in_state[state[a]] -= 1
            state[a] = len(in_state)
            in_state.append(1)
        if in_arc[arc[b]] > 1:
            table[: len(in_state), len(in_arc)] = table[: len(in_state), arc[b]]
            in_arc[arc[b]] -= 1
            arc[b] = len(in_arc)
            in_arc.append(1)
        table[state[a], arc[b]] = False
        arc[c] = arc[a]
        in_arc[arc[a]] += 1
    children: dict[tuple[int, int], int] = {}
    named = {0: -1}
    for t in np.flatnonzero(state >= 0).tolist():
        node = 0
        for byte in labels[t]:
            node = children.setdefault((node, byte), len(children) + 1)
        named[node] = t
    return Automaton(state, arc, np.packbits(table[: len(in_state), : len(in_arc)], axis=1, bitorder="little"), *_renumbered(children, named))


def _renumbered(children: dict[tuple[int, int], int], named: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (node, byte) in ascending order, and each node's token; node k + 1 is entered by the k-th key.

    Nodes are numbered as they were made, each after its parent, so numbering them level by level in the order of
    their keys keeps the keys sorted.
    """
    below: dict[int, list[tuple[int, int]]] = {}
    for (node, byte), child in children.items():
        below.setdefault(node, []).append((byte, child))
    keys, tokens, queue = [], [named.get(0, -1)], [(0, 0)]
    for node, number in queue:
        for byte, child in sorted(below.get(node, ())):
            keys.append(number << 8 | byte)
            tokens.append(named.get(child, -1))
            queue.append((child, len(keys)))
    return np.array(keys, dtype=np.int32), np.array(tokens, dtype=np.int32)


class Codec:
    """Texts to ids and back, by a byte-level file of the tokenizers library."""

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, model = spec["pre_tokenizer"] or {}, spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges") or odd:
            raise ValueError("only byte-level BPE without a normaliser")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words")
        chars, vocab = byte_chars(), model["vocab"]
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for word, t in vocab.items():
            labels[t] = bytes(map(chars.__getitem__, word))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = compiled(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        if {labels[t] for t in self.automaton.trie_token if t >= 0 and len(labels[t]) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError("a byte has no token")
        for word, t in self.added.items():
            labels[t] = word
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.labels = np.frombuffer(b"".join(labels), dtype=np.uint8)
        self.label_sizes = np.fromiter(map(len, labels), dtype=np.int64, count=len(labels))
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.memo = Memo(self.ids, memo)

    def pieces(self, units: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words of the units, and how many each has; a unit of letters that may follow a blank is one."""
        flat = np.frombuffer(b"".join(units), dtype=np.uint8)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        ends = np.cumsum(sizes)
        letter = ((flat | 0x20) >= 0x61) & ((flat | 0x20) <= 0x7A)
        pair = (flat[:-1] == 0xC3) & (flat[1:] & 0xC0 == 0x80) & (flat[1:] & 0x5F != 0x17)
        letter[:-1] |= pair
        letter[1:] |= pair
        letter[(ends - sizes)[sizes > 1]] |= flat[(ends - sizes)[sizes > 1]] == 0x20
        plain = (np.add.reduceat(~letter, ends - sizes) == 0) | (sizes == 1)
        words, counts = list(units), np.ones(len(units), dtype=np.int64)
        split = {}
        for k in np.flatnonzero(~plain).tolist():
            if units[k] not in self.added:
                text = units[k].decode()
                split[k] = [text[i:j].encode() for _, (i, j) in self.split(text)]
                counts[k] = len(split[k])
        if split:
            words = [w for k, u in enumerate(units) for w in split.get(k, (u,))]
        return words, counts

    def ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after another, and how many each has; a unit lies between two cuts of a text."""
        words, counts = self.pieces(units)
        parts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in slices(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), WORDS):
            part, n = self.automaton.encode(words[i:j])
            for k in [k for k in range(i, j) if words[k] in self.added] if any(x in self.added for x in words[i:j]) else ():
                at = int(n[: k - i].sum())
                part = np.concatenate((part[:at], [self.added[words[k]]], part[at + n[k - i] :]))
                n[k - i] = 1
            parts.append(part)
            sizes.append(n)
        upto = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[np.concatenate(([0], np.cumsum(counts)))]
        return np.concatenate(parts), np.diff(upto)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places at which the splitter splits, and the ends of texts and added tokens.

        Such a place lies before a single blank or at either side of a line feed, if a visible ASCII character or a
        two-byte letter stands on both sides of it, and between an ASCII letter and a full stop or comma.
        """
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if len(data) > 2:
            before, here, after = data[:-2], data[1:-1], data[2:]
            lead = lambda x: (x >= 0xC3) & (x <= 0xD4)
            visible = lambda x: (x > 0x20) & (x < 0x7F)
            wide = np.zeros(len(here), dtype=bool)
            wide[1:] = lead(data[:-3])
            solid = (visible(before) | ((before & 0xC0 == 0x80) & wide)) & (visible(after) | lead(after))
            cut[1:-2] |= solid & ((here == 0x20) | (here == 0x0A))
            cut[2:-1] |= solid & (here == 0x0A)
            letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A)
            cut[1:-2] |= letter & ((here == 0x2E) | (here == 0x2C))
        if self.added:
            raw, inside = data.tobytes(), re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
            at = 0
            while hit := inside.search(raw, at):
                i, j = hit.span()
                k = np.searchsorted(offsets, i, side="right")
                whole = offsets[k] >= j
                cut[i + 1 : j] &= not whole
                cut[[i, j]] |= whole
                at = j if whole else i + 1
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids end (with a leading 0)."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        places = self.cuts(data, offsets)
        units = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
        codes, distinct = coded(units)
        return laid_out(self.memo.lookup(distinct), codes, np.searchsorted(places, offsets)) if len(data) else (np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The labels of each text's ids, joined; bytes that are no UTF-8 become replacement characters."""
        sizes = self.label_sizes[ids]
        joined = self.labels[ragged(self.label_starts[ids], sizes)].tobytes()
        places = np.concatenate(([0], np.cumsum(sizes)))[ends].tolist()
        for i, j in zip(places, places[1:]):
            yield joined[i:j].decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker compiles each file once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1), RUN):
                ids, ends = codec(tokenizer).encode(batch.column(1)[i:j])
                yield pa.record_batch([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            for i, j in slices(np.asarray(pc.list_value_length(lists)), RUN // 4):
                part = lists[i:j]
                offsets = np.asarray(part.offsets, dtype=np.int64)
                texts = [x.decode() for x in codec(tokenizer).decode(np.asarray(part.flatten(), dtype=np.int64), offsets - offsets[0])]
                yield pa.record_batch([batch.column(0)[i:j], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1), RUN):
                ids, ends = codec(tokenizer).encode(batch.column(1)[i:j])
                raw = memoryview(ids.astype("<u4").tobytes())
                of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                of_text = [hashlib.sha256(x).hexdigest() for x in codec(tokenizer).decode(ids, ends)]
                yield pa.record_batch([batch.column(0)[i:j], pa.array(np.diff(ends).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
