"""Operator 4: n-gram Jaccard self-join by MinHash banding.

Words are runs of letters and digits, lower-cased; a text's grams are its 5-word shingles (one gram of
all words when there are fewer; the trimmed text itself when there is no word). Documents with equal gram
sets form one class and are represented once. Band and row counts follow from the wanted recall at the
threshold. Band hashes are shuffled, and classes that share one are candidates.

Candidates are verified in units. A unit is a bucket (the classes of one band hash) or a connected
component of buckets. Of each component the cheaper form is taken: the whole of it, if its number of
pairs is no larger than that of its buckets together (a cluster of copies, which meets in many bands), or
else its buckets (texts chained by a passage here and there), where a pair that shares several buckets
is verified in the first. So no more pairs are verified than share a band, counted by band.

The gram sets of the classes concerned are made once, and the units meet them in cells: a unit of over
``block`` classes, or ``volume`` grams, is split by set size in steps of the threshold, of which only equal
and neighbouring ones can hold a pair, and then dealt over a grid, so that no task holds more than two
blocks. Within a cell, shared grams are counted by matrix products; no pair ever becomes a row.

Result: one row per row of docs with row_key, class_id (least doc_id of the class's component of links), n_links
(documents at the threshold or above, equal ones included) and gram_key (equal for equal gram sets). A
pair above the threshold is missed with the probability the recall leaves.

Defined results: null and blank texts have no grams, stand alone and have no link; rows with a null
doc_id count as documents, and class_id is null where a component has no other; rows that repeat a doc_id,
and equal rows, count as documents each; with no rows the result is empty. Ties do not arise: what is
exactly at the threshold is linked. Very long texts are hashed in one pass over their grams, and lie in
blocks of their own. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, components, lists, partitions, text_key, text_slices, written

NOT_WORD = r"[^\p{L}\p{N}]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plan(threshold: float, recall: float = 0.9999, wanted: int = 128) -> tuple[int, int]:
    """(bands, rows) that reach the recall at the threshold: the most rows within ``wanted`` hashes, or one row of as many bands as it takes."""
    best = None
    rows = 1
    while True:
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12)))
        if best and bands * rows > wanted:
            return best
        best, rows = (bands, rows), rows + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted 64-bit gram hashes of each text."""
    filled = pc.fill_null(texts, "")
    offsets, words = lists(pc.split_pattern_regex(pc.utf8_lower(filled), NOT_WORD))
    codes, distinct = coded(words)
    real = np.array([bool(w) for w in distinct], dtype=bool)[codes] if len(codes) else np.zeros(0, bool)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)
    ends = np.concatenate(([0], np.cumsum(real)))[offsets]
    flat = _mixed(hashes[codes[real]]) if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(flat) - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled = rolled * _MIX + flat[k : k + len(rolled)]
    rolled = _mixed(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(ends[i]), int(ends[i + 1])
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes())], dtype=np.uint64))
        else:
            bare = filled[i].as_py().strip()
            out.append(np.array([xxhash.xxh3_64_intdigest("\0" + bare)] if bare else [], dtype=np.uint64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(11)
    # the grams are hashes already, so a product and a sum modulo 2^32 deal them anew; 32 bits fit the vector units
    mul = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    for batch in batches:
        texts = batch.column(2)
        for i, j in text_slices(texts):
            sets = gram_sets(texts[i:j], n)
            keys, links, sizes = [], [], [len(g) for g in sets]
            for grams in sets:
                keys.append(None if not len(grams) else int(np.frombuffer(xxhash.xxh3_64_digest(grams.tobytes()), "<i8")[0]))
                least = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
                high = (grams >> np.uint64(32)).astype(np.uint32)
                for k in range(0, len(high), 512):
                    found = high[k : k + 512, None] * mul
                    found += add
                    least = np.minimum(least, found.min(axis=0))
                code = np.arange(bands, dtype=np.uint64) * _MIX
                for r in range(rows):
                    code = _mixed(code + least.reshape(bands, rows)[:, r].astype(np.uint64) * _MIX)
                links.append(code.view(np.int64).tolist() if len(grams) else [])
            yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(links, pa.list_(pa.int64()))], names=["doc_id", "row_key", "gram_key", "n_grams", "bands"])


def _gram_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in text_slices(batch.column(1)):
            sets = gram_sets(batch.column(1)[i:j], n)
            offsets = pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32))
            yield pa.record_batch([batch.column(0)[i:j], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "grams"])


def _shared(flat: np.ndarray, owner: np.ndarray, m: int, width: int = 4096) -> np.ndarray:
    """The number of grams that each pair of the m sets shares: by matrix products for grams of many sets, by pairs for the rest."""
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    counts = np.diff(np.concatenate((first, [len(flat)])))
    shared = np.zeros((m, m), dtype=np.float32)
    few = max(1, m // 12)
    for k in np.unique(counts[(counts > 1) & (counts <= few)]).tolist():
        own = owner[first[counts == k][:, None] + np.arange(k)].astype(np.int64)
        for part in np.array_split(own, -(-len(own) * k * k // 1_000_000)):
            shared += np.bincount((part[:, :, None] * m + part[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    many = np.flatnonzero(counts > few)
    many = many[counts[many] > 1]
    for c in range(0, len(many), width):
        at = many[c : c + width]
        part = np.zeros((m, len(at)), dtype=np.float32)
        rows = np.concatenate([owner[a : a + n] for a, n in zip(first[at].tolist(), counts[at].tolist())])
        part[rows, np.repeat(np.arange(len(at)), counts[at])] = 1
        shared += part @ part.T
    return shared


def _links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, times: np.ndarray, codes: list[list[int]], unit: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of linked documents of each set, and the least node reachable through links.

    side: 0 and 1 in a cell of two blocks, where only pairs across count; None in a cell of one block. codes: the
    buckets of each class, in a unit that is a bucket; pairs that share an earlier one have been verified there.
    """
    if side is not None and (side == side[0]).all():
        return np.zeros(len(nodes), dtype=np.int64), nodes
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    shared = _shared(np.concatenate(sets), np.repeat(np.arange(m), sizes.astype(np.int64)), m)
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    earlier: dict[int, list[int]] = {}
    for k, own in enumerate(codes):
        for c in own:
            if c < unit:
                earlier.setdefault(c, []).append(k)
    for rows in earlier.values():
        if len(rows) > 1:
            linked[np.ix_(rows, rows)] = False
    label = nodes.copy()
    while True:
        least = np.where(linked, label[None, :], label[:, None]).min(axis=1)
        least = np.minimum(label, least)
        if (least == label).all():
            return linked @ times, label
        label = least


CELL = ["unit", "i", "j", "side", "node", "times", "codes", "grams"]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Cells arrive sorted; each is verified when it is complete."""
    held: list[tuple] = []
    sets: list[np.ndarray] = []
    cell = None

    def done() -> pa.RecordBatch:
        side, nodes, times, codes = zip(*held)
        nodes = np.array(nodes)
        links, root = _links(nodes, sets, np.array(side) if cell[1] != cell[2] else None, np.array(times), codes, cell[0], threshold)
        return pa.record_batch([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(root)], names=["node", "links", "root"])

    for batch in batches:
        offsets, flat = lists(batch.column(7))
        grams = np.asarray(flat).view(np.uint64)
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(3, 7)]))
        for k, key in enumerate(keys):
            if key != cell:
                if held:
                    yield done()
                held, sets, cell = [], [], key
            held.append(rows[k])
            sets.append(grams[offsets[k] : offsets[k + 1]].copy())
    if held:
        yield done()


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins on (doc_id, row_key), null doc_ids included; right has them as _id and _key."""
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), how)


def _units(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(unit, node, codes): components, or their buckets where those have fewer pairs; codes are then a class's buckets."""
    buckets = shared.groupBy("code", "head").agg(F.count("*").cast("double").alias("m"))
    of_bucket = buckets.join(groups.withColumnRenamed("node", "head"), "head")
    split = of_bucket.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    size = groups.groupBy("component").agg(F.count("*").cast("double").alias("n"))
    form = written(size.join(split, "component").select("component", (F.col("n") * F.col("n") <= F.col("pairs")).alias("whole")))
    placed = written(groups.join(form, "component"))
    none = F.array().cast("array<bigint>")
    whole = placed.where("whole").select(F.col("component").alias("unit"), "node", none.alias("codes"))
    loose = shared.join(placed.where("not whole").select("node"), "node")
    codes = loose.groupBy("node").agg(F.sort_array(F.collect_set("code")).alias("codes"))  # at most one a band
    return whole.unionByName(loose.select(F.col("code").alias("unit"), "node").join(codes, "node").select("unit", "node", "codes"))


def _cells(units: DataFrame, heads: DataFrame, grams: DataFrame, threshold: float, block: int, volume: int) -> DataFrame:
    """The rows of CELL: each class of a unit once for every block that its own meets."""
    whole = units.join(heads, "node").groupBy("unit").agg(F.count("*").alias("classes"), F.sum("n_grams").alias("unit_grams"))
    large = (F.col("classes") > block) | (F.col("unit_grams") > volume)
    step = F.when(large, F.floor(F.log("n_grams") / F.lit(-math.log(threshold) * (1 + 1e-9))).cast("int")).otherwise(0)
    members = written(units.join(heads, "node").join(written(whole), "unit").withColumn("step", step))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_grams") / volume)).cast("int")
    sized = members.where(large).groupBy("unit", "step").agg(blocks.alias("blocks"))
    sized = written(sized.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("blocks")))
    place = lambda s, k: s.cast("long") * (1 << 32) + k
    none = F.array().cast("array<bigint>")
    listed = lambda s: F.coalesce(F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", s) - 1), lambda k: place(s, k)), none)
    members = members.join(sized, "unit", "left")
    own = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(place(F.col("step"), F.pmod(F.xxhash64("node"), F.try_element_at("blocks", F.col("step")))))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(*[listed(F.col("step") + k) for k in (-1, 0, 1)]))
    dealt = members.select("unit", "node", "times", "codes", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "times", "codes")
    cells = dealt.join(grams, "node").select(*CELL)
    return cells.repartition(partitions(units.sparkSession), "unit", "i", "j").sortWithinPartitions("unit", "i", "j")


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, block: int, volume: int) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, row_key, gram_key; one row per class that has links or several documents:
    node, component, links, class_id, and _id and _key of the component's first row)."""
    bands, rows = plan(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("row_key"), "text")
    sigs = written(texts.mapInArrow(lambda b: _signatures(b, n, bands, rows), "doc_id long, row_key long, gram_key long, n_grams long, bands array<long>"))
    real = sigs.where("gram_key is not null").withColumnRenamed("gram_key", "node")

    # band hashes that several classes share, and the candidate groups that they make
    banded = real.select("node", F.explode("bands").alias("code"))
    buckets = written(banded.groupBy("code").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("code", "head"))
    shared = written(banded.join(buckets, "code").select("code", "head", "node").distinct())
    units = written(_units(shared, components(shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))))

    # classes of equal gram sets; any row of a class has its grams
    heads = real.groupBy("node").agg(F.count("*").alias("times"), F.min("doc_id").alias("rep"), F.min_by("row_key", "doc_id").alias("rep_key"), F.min("row_key").alias("any_key"), F.first("n_grams").alias("n_grams"))
    heads = written(heads.select("node", "times", "n_grams", "rep", F.coalesce("rep_key", "any_key").alias("rep_key")))
    wanted = heads.join(units.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("_id"), F.col("rep_key").alias("_key"), "node")
    grams = _same_row(texts, wanted, "inner").select("node", "text").dropDuplicates(["node"])
    grams = written(grams.mapInArrow(lambda b: _gram_rows(b, n), "node long, grams array<long>"))
    cells = _cells(units, heads.select("node", "times", "n_grams"), grams, threshold, block, volume)
    checked = written(cells.mapInArrow(lambda b: _verified(b, threshold), "node long, links long, root long"))

    final = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    classes = heads.join(links, "node", "left").where("links > 0 or times > 1").join(final, "node", "left")
    classes = written(classes.select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "rep", "rep_key"))
    first = classes.groupBy("component").agg(F.min("rep").alias("class_id"), F.min_by("rep_key", "rep").alias("_key"), F.min("rep_key").alias("any_key"))
    first = written(first.select("component", "class_id", F.col("class_id").alias("_id"), F.coalesce("_key", "any_key").alias("_key")))
    return sigs.select("doc_id", "row_key", "gram_key"), written(classes.select("node", "component", "links").join(first, "component"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 256, volume: int = 500_000) -> DataFrame:
    """doc_id, row_key, class_id, n_links, gram_key for every row; see the module's description."""
    rows, classes = _classes(docs, threshold, n, recall, block, volume)
    out = rows.join(classes, F.col("gram_key") == F.col("node"), "left")
    alone: Column = F.col("node").isNull()
    return out.select("doc_id", "row_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "gram_key")


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents less near duplicates: of each class one row stays, the first by (doc_id, hash of the text), null doc_ids last.

    Rows go by doc_id and text, so a row that shares its doc_id with another stays if its own text has no
    like. Of equal (doc_id, text) rows that would stay, the one with the least hash of all columns does.
    """
    rows, classes = _classes(docs, threshold, 5, 0.9999, 256, 500_000)
    held = rows.join(classes, F.col("gram_key") == F.col("node"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
    marked = written(held.groupBy("doc_id", "row_key").agg(F.max(same).alias("stays"), F.count("*").alias("times")).where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "stays"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("row_key"))
    single = _same_row(keyed, marked.select("_id", "_key"), "left_anti").select("row")
    repeated = _same_row(keyed, marked.where("stays"), "inner").groupBy("doc_id", "row_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
