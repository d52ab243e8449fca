"""A lexical index that stays: immutable segments under a path, opened by any later session.

    manifest/<version>.json   the segments of a version; a version is committed by a rename, and the greatest one counts
    <segment>/docs            (ord, conversation_id, chunk_id, dl, terms): a chunk's terms with their counts
    <segment>/blocks          (ord, conversation_id, term, no, size, max_tf, min_dl, entries): up to ``BLOCK`` postings of a term, best first
    <segment>/counts, sizes   signed sums: (conversation_id, term, df) and (conversation_id, n, dl)
    <segment>/gone            (ord, chunk_id): chunks of earlier segments that went

A change writes one segment with the new chunks, the ids that went and the differences of the sums, so it writes bytes in proportion
to itself; statistics are sums over segments. Runs of ``FANOUT`` neighbours of one size tier are merged into one.

:func:`topk` finds the best chunks without scoring all postings. A block's greatest count and least length bound its contribution. The best
block of each term gives a lower bound of the k-th score; terms whose bounds together stay below it can bring no chunk into the top alone, so only the other
terms' blocks are read, and of these only those that can; the chunks found there then ask their own terms for the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import cut, written

from . import index, retrieve

#: Postings of a block; chunks of a conversation whose postings of a term are sorted together; neighbours of a tier that are merged.
BLOCK, GROUP, FANOUT = 16, 4096, 4
#: Postings of a conversation that are sorted together, in memory; texts counted together, in bytes; query terms sent to all tasks at once.
POSTINGS, PIECE, ASKED = 1 << 20, 8 << 20, 200_000
#: Part of the paths of indexes that are found by name; it changes with the tables' form.
FORMAT = "f2"
#: What rounding and the order of sums may change of a score.
MARGIN = 1e-5


@dataclass(frozen=True)
class Segment:
    """A folder of the index: its place in the order of changes, its chunks, and how many ids went with it."""

    name: str
    ord: int
    chunks: int
    gone: int

    @property
    def tier(self) -> int:
        """Sizes that differ less than ``FANOUT`` times share a tier."""
        tier, n = 0, max(self.chunks, self.gone)
        while n >= FANOUT:
            tier, n = tier + 1, n // FANOUT
        return tier


@dataclass(frozen=True)
class Lexicon:
    """An opened version of the index."""

    spark: SparkSession
    path: str
    version: int
    key: str
    segments: tuple[Segment, ...]

    def table(self, name: str, of: tuple[Segment, ...] | None = None) -> DataFrame:
        own = f"ord int, conversation_id string, {SCHEMAS[name]}".replace("KEY", self.key) if name != "gone" else f"ord int, chunk_id {self.key}"
        of = self.segments if of is None else of
        if not of:
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).parquet(*[f"{self.path}/{s.name}/{name}" for s in of])

    def live(self, rows: DataFrame, of: tuple[Segment, ...] | None = None) -> DataFrame:
        """The rows (ord, chunk_id, ...) whose chunk did not go in a later segment."""
        of = self.segments if of is None else of
        if not any(s.gone for s in of):
            return rows
        gone = self.table("gone", of).groupBy("chunk_id").agg(F.max("ord").alias("_ord")).withColumnRenamed("chunk_id", "_chunk")
        return rows.join(gone, (F.col("chunk_id") == F.col("_chunk")) & (F.col("ord") < F.col("_ord")), "left_anti")

    def docs(self) -> DataFrame:
        return self.live(self.table("docs"))

    def corpus(self) -> DataFrame:
        """(conversation_id, n, avgdl)."""
        sums = self.table("sizes").groupBy("conversation_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
        return sums.where("n > 0").select("conversation_id", "n", (F.col("dl") / F.col("n")).alias("avgdl"))

    def idf(self, of: DataFrame | None = None) -> DataFrame:
        """(conversation_id, term, df, idf), or those of the terms asked (conversation_id, term)."""
        sums = self.table("counts") if of is None else self.table("counts").join(of.select("conversation_id", "term").distinct(), ["conversation_id", "term"], "left_semi")
        sums = sums.groupBy("conversation_id", "term").agg(F.sum("df").alias("df")).where("df > 0")
        return sums.join(self.corpus(), "conversation_id").select("conversation_id", "term", "df", F.log((F.col("n") + 1) / F.col("df")).alias("idf"))

    def near(self, ids: DataFrame) -> DataFrame:
        """The docs, less those without an id (chunk_id) where the ids are few enough to be sent to all tasks."""
        once = ids.select("chunk_id").distinct()
        return self.docs().join(F.broadcast(once), "chunk_id", "left_semi") if once.count() <= ASKED else self.docs()

    def opened(self) -> index.Index:
        """The tables that the searches of :mod:`retrieve` read."""
        entries = lambda docs: docs.select("conversation_id", "chunk_id", F.explode("terms").alias("t")).select("conversation_id", "chunk_id", "t.term", "t.tf", "t.content")
        return index.Index(entries(self.docs()), self.docs().select("conversation_id", "chunk_id", "dl"), self.corpus(), self.idf(), lambda ids: entries(self.near(ids)), self.idf)


SCHEMAS = {
    "docs": "chunk_id KEY, dl long, terms array<struct<term:string,tf:long,content:boolean>>",
    "blocks": "term string, no long, size int, max_tf long, min_dl long, entries array<struct<chunk_id:KEY,tf:long,dl:long>>",
    "counts": "term string, df long",
    "sizes": "n long, dl long",
    "gone": "",
}


# ---- files

def shared_files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = shared_files(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))


def opened(spark: SparkSession, path: str, version: int | None = None) -> Lexicon:
    """The index under the path, in its last version or an earlier one that was not swept."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no index under {path}")
    version = known[-1] if version is None else version
    told = json.loads(spark.read.text(f"{path}/manifest/{version:08d}.json", wholetext=True).first()[0])
    return Lexicon(spark, path, version, told["key"], tuple(Segment(**s) for s in told["segments"]))


def _committed(now: Lexicon, segments: list[Segment]) -> Lexicon:
    """The next version. It appears whole or not at all; if another writer was first, this change is refused."""
    version = now.version + 1
    told = json.dumps({"key": now.key, "segments": [asdict(s) for s in segments]})
    fs, draft = shared_files(now.spark, f"{now.path}/manifest/_{uuid.uuid4().hex}")
    final = shared_files(now.spark, f"{now.path}/manifest/{version:08d}.json")[1]
    out = fs.create(draft)
    out.write(bytearray(told.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {now.path} was written meanwhile")
    return Lexicon(now.spark, now.path, version, now.key, tuple(segments))


def rolled_back(spark: SparkSession, path: str, version: int) -> None:
    """Drops the versions after this one, which a writer left that was stopped before its own commit; for the only writer."""
    for later in versions(spark, path):
        if later > version:
            fs, where = shared_files(spark, f"{path}/manifest/{later:08d}.json")
            fs.delete(where, False)


def swept(now: Lexicon) -> list[str]:
    """Deletes the folders and versions that this version does not need; returns their names. No one may be reading them."""
    fs, where = shared_files(now.spark, now.path)
    kept = {s.name for s in now.segments} | {"manifest"}
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in kept]
    gone += [s.getPath() for s in fs.listStatus(shared_files(now.spark, f"{now.path}/manifest")[1]) if s.getPath().getName() != f"{now.version:08d}.json"]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


# ---- segments

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conversation_id, chunk_id, dl, terms) of chunks whose text is split into words by blanks, a piece of bounded size at a time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, PIECE), "left")) if len(ends) else []
        for k, at in enumerate(cuts):
            rows = batch.slice(at, (cuts[k + 1] if k + 1 < len(cuts) else batch.num_rows) - at)
            lists = pc.split_pattern(rows["text"], " ")
            words = lists.flatten().dictionary_encode()
            terms: dict[str, int] = {}
            emitted = np.full((len(words.dictionary), 3), -1, np.int64)
            content = np.zeros(len(words.dictionary), np.int64)
            for i, word in enumerate(words.dictionary.to_pylist()):
                tokens = T.tokens_of(word)
                emitted[i, : len(tokens)] = [terms.setdefault(t, len(terms)) for t in tokens]
                content[i] = bool(tokens) and tokens[0] not in T.STOPWORD_SET
            word, doc = words.indices.to_numpy(), np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            held = [(own >= 0, own) for own in emitted[word].T]
            # sorted by (chunk, term, content), so that a run's last row tells whether any word of it is content
            keys = np.sort(np.concatenate([(doc[m] * len(terms) + own[m]) * 2 + content[word][m] for m, own in held]))
            first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
            tf = np.diff(first, append=len(keys))
            doc, term = np.divmod(keys[first] >> 1, max(len(terms), 1))
            found = pa.StructArray.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(term)), pa.array(tf), pa.array(keys[first + tf - 1] % 2 == 1)], ["term", "tf", "content"])
            offsets = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
            dl = np.bincount(doc, tf, rows.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows["conversation_id"], rows["chunk_id"], pa.array(dl), pa.ListArray.from_arrays(offsets, found)], ["conversation_id", "chunk_id", "dl", "terms"])


def docs_of(chunks: DataFrame) -> DataFrame:
    """(conversation_id, chunk_id, dl, terms) of (conversation_id, chunk_id, text).

    Texts are dealt by chunk once; their words are counted where they land, as arrays of a piece's word numbers.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("conversation_id", "chunk_id", "text").repartition(n, "chunk_id")
    whole = dealt.groupBy("conversation_id", "chunk_id").agg(F.coalesce(F.listagg("text", F.lit(" ")), F.lit("")).alias("text"))
    key = chunks.schema["chunk_id"].dataType.simpleString()
    return whole.withColumn("text", T.separated(F.col("text"))).mapInArrow(_counted, f"conversation_id string, {SCHEMAS['docs'].replace('KEY', key)}")


def term_counts(chunks: DataFrame) -> DataFrame:
    """(conversation_id, term, df, idf) of the chunks, as an index of them tells it, by counting alone: no lists are sorted or written.

    Texts are dealt by chunk once; where they land, each term of a chunk becomes one row, and rows are summed before they go on.
    """
    sizes = chunks.select("conversation_id", "chunk_id").distinct().groupBy("conversation_id").agg(F.count("*").alias("n"))
    df = counts_of(docs_of(chunks))
    return df.join(sizes, "conversation_id").select("conversation_id", "term", "df", F.log((F.col("n") + 1) / F.col("df")).alias("idf"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of groups that come one after another, each by chunk_id; some groups at a time."""
    def blocks(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        group, counts, dl = _places(rows), _one(rows, "tf"), _one(rows, "dl").to_numpy()
        row = np.repeat(np.arange(len(counts)), np.diff(counts.offsets.to_numpy()))
        term, tf = pc.split_pattern(_one(rows, "terms"), " ").flatten().dictionary_encode(), counts.flatten().to_numpy()
        key = group[row] * max(len(term.dictionary), 1) + term.indices.to_numpy()
        order = np.lexsort((((1 << 31) - tf << 32) + dl[row], key))  # stable, so equal ones stay by chunk_id
        key, row, tf = key[order], row[order], tf[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
        at = np.flatnonzero(place % BLOCK == 0)
        entries = pa.StructArray.from_arrays([_one(rows, "chunk_id").take(pa.array(row)), pa.array(tf), pa.array(dl[row])], ["chunk_id", "tf", "dl"])
        least = np.minimum.reduceat(dl[row], at) if len(at) else dl[:0]
        no = _one(rows, "g").to_numpy()[row[at]] * 1_000_000 + place[at] // BLOCK
        size = np.diff(at, append=len(key)).astype(np.int32)
        columns = [_one(rows, "conversation_id").take(pa.array(row[at])), term.dictionary.take(pa.array(term.indices.to_numpy()[order][at])), pa.array(no), pa.array(size), pa.array(tf[at]), pa.array(least), pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), entries)]
        return pa.RecordBatch.from_arrays(columns, ["conversation_id", "term", "no", "size", "max_tf", "min_dl", "entries"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch["tf"].flatten())
        if n >= POSTINGS:
            rows = pa.Table.from_batches(held)
            place = _places(rows)
            whole = int(np.searchsorted(place, place[-1]))  # the last group may go on
            if whole:
                yield blocks(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                n = sum(len(b["tf"].flatten()) for b in held)
    if held:
        yield blocks(pa.Table.from_batches(held))


def _one(rows: pa.Table, name: str) -> pa.Array:
    parts = rows[name].chunks
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], rows.schema.field(name).type)


def _places(rows: pa.Table) -> np.ndarray:
    """The number of each row's group (conversation_id, g), in order."""
    own = _one(rows, "conversation_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum((np.diff(own, prepend=own[:1]) != 0) | (np.diff(g := _one(rows, "g").to_numpy(), prepend=g[:1]) != 0))


def blocks_of(docs: DataFrame) -> DataFrame:
    """(conversation_id, term, no, size, max_tf, min_dl, entries): postings in groups of bounded size, each sorted by contribution.

    Chunks are dealt by group, not postings by term: all lists of a group are made in its task, and what a search finds of a chunk lies together.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.greatest(F.count("*") / GROUP, F.sum(F.size("terms")) / POSTINGS)
    # only conversations of several groups: at most one for so many chunks or postings
    large = docs.groupBy(F.col("conversation_id").alias("_conversation")).agg(F.ceil(most).alias("groups")).where("groups > 1")
    rows = docs.where(F.size("terms") > 0).join(F.broadcast(large), F.col("conversation_id").eqNullSafe(F.col("_conversation")), "left")
    group = F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("groups")), F.lit(0).cast("long"))
    # terms hold no blanks; as one text they are fewer bytes than an array
    rows = rows.select("conversation_id", group.alias("g"), "chunk_id", "dl", F.array_join("terms.term", " ").alias("terms"), F.col("terms.tf").alias("tf"))
    dealt = rows.repartition(n, "conversation_id", "g").sortWithinPartitions("conversation_id", "g", "chunk_id")
    key = docs.schema["chunk_id"].dataType.simpleString()
    return dealt.mapInArrow(_listed, f"conversation_id string, {SCHEMAS['blocks'].replace('KEY', key)}")


def counts_of(docs: DataFrame, sign: int = 1) -> DataFrame:
    return docs.select("conversation_id", F.explode("terms.term").alias("term")).groupBy("conversation_id", "term").agg((sign * F.count("*")).alias("df"))


def counts_in(blocks: DataFrame) -> DataFrame:
    """The counts of the chunks from their lists."""
    return blocks.groupBy("conversation_id", "term").agg(F.sum("size").alias("df"))


def sizes_of(docs: DataFrame, sign: int = 1) -> DataFrame:
    return docs.groupBy("conversation_id").agg((sign * F.count("*")).alias("n"), (sign * F.sum("dl")).alias("dl"))


def _saved(now: Lexicon, ord_: int, docs: DataFrame, gone: DataFrame | None, counts=None, sizes=None) -> Segment:
    """Writes a segment. counts, sizes: what makes its sums of its stored blocks and docs, by default their own."""
    name = f"s{ord_:08d}-{uuid.uuid4().hex[:8]}"

    def put(df: DataFrame, table: str, order: list[str]) -> DataFrame:
        where = f"{now.path}/{name}/{table}"
        df = df.withColumn("ord", F.lit(ord_))
        (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").parquet(where)
        return now.spark.read.schema(df.schema).parquet(where)

    kept = put(docs, "docs", [])
    lists = put(blocks_of(kept), "blocks", [])
    put((counts or counts_in)(lists), "counts", ["conversation_id", "term"])
    put((sizes or sizes_of)(kept), "sizes", [])
    went = put(gone if gone is not None else now.spark.createDataFrame([], f"chunk_id {now.key}"), "gone", [])
    return Segment(name, ord_, kept.count(), went.count())


def created(chunks: DataFrame, path: str) -> Lexicon:
    """A new index of the chunks (conversation_id, chunk_id, text) under the path."""
    none = Lexicon(chunks.sparkSession, path, 0, chunks.schema["chunk_id"].dataType.simpleString(), ())
    return _committed(none, [_saved(none, 1, docs_of(chunks), None)])


def changed(now: Lexicon, new: DataFrame, gone: DataFrame | None = None) -> Lexicon:
    """The index after chunks came, in place of those with their ids, and the chunks (chunk_id) of ``gone`` went."""
    out = new.select("chunk_id") if gone is None else new.select("chunk_id").union(gone.select("chunk_id"))
    out = written(out.distinct())
    edge = out.agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).first()
    # lets the reader skip what lies outside; with no id at all, nothing is removed
    near = now.table("docs").where(F.col("chunk_id").between(F.lit(edge["a"]), F.lit(edge["b"])) if edge["a"] is not None else F.lit(False))
    removed = written(now.live(near).join(out, "chunk_id", "left_semi").select("conversation_id", "chunk_id", "dl", "terms"))
    summed = lambda parts, *keys: parts.groupBy("conversation_id", *keys)
    counts = lambda lists: summed(counts_in(lists).union(counts_of(removed, -1)), "term").agg(F.sum("df").alias("df")).where("df <> 0")
    sizes = lambda kept: summed(sizes_of(kept).union(sizes_of(removed, -1))).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n <> 0 or dl <> 0")
    added = _saved(now, 1 + max((s.ord for s in now.segments), default=0), docs_of(new), removed.select("chunk_id"), counts, sizes)
    return tidied(_committed(now, [*now.segments, added]))


def recast(now: Lexicon, chunks: DataFrame) -> Lexicon:
    """The index after the conversations of ``chunks`` were cleared and their chunks indexed anew; others stay as they are."""
    own = chunks.select("conversation_id").distinct()
    return changed(now, chunks, now.docs().join(own, "conversation_id", "left_semi").select("chunk_id"))


def tidied(now: Lexicon) -> Lexicon:
    """Merges runs of ``FANOUT`` neighbours of one tier, the latest first, until there is none."""
    while True:
        s = now.segments
        run = next((k for k in range(len(s) - FANOUT, -1, -1) if len({x.tier for x in s[k : k + FANOUT]}) == 1), None)
        if run is None:
            return now
        part = s[run : run + FANOUT]
        docs = now.live(now.table("docs", part), part).select("conversation_id", "chunk_id", "dl", "terms")
        # ids that went stay only for segments before the run
        gone = now.table("gone", part).select("chunk_id").distinct() if run else None
        sums = lambda name, *keys: now.table(name, part).groupBy("conversation_id", *keys)
        counts = lambda _: sums("counts", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        sizes = lambda _: sums("sizes").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n <> 0 or dl <> 0")
        merged = _saved(now, part[-1].ord, docs, gone, counts, sizes)
        now = _committed(now, [*s[:run], merged, *s[run + FANOUT :]])


# ---- search

def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What an occurrence count brings, without the term's idf; it grows with tf and falls with dl."""
    return tf * (retrieve.K1 + 1) / (tf + retrieve.K1 * (1 - retrieve.B + retrieve.B * dl / avgdl))


@dataclass(frozen=True)
class Found:
    """terms: of the queries, with idf; hits: (query_id, conversation_id, chunk_id, extra) of every chunk that can be among the best, whole scores.

    read: (query_id, postings, scored, looked_up): the postings of the query's terms, those in blocks that were read, and chunks
    whose own terms were asked for those of the other blocks.
    """

    terms: DataFrame
    hits: DataFrame
    read: DataFrame


def _asked(terms: DataFrame, own: Lexicon) -> DataFrame:
    """The query terms (query_id, conversation_id, term, mult) that the index knows, with idf and avgdl, written."""
    counts = own.table("counts").join(terms.select("conversation_id", "term").distinct(), ["conversation_id", "term"], "left_semi")
    known = counts.groupBy("conversation_id", "term").agg(F.sum("df").alias("df")).where("df > 0")
    rows = terms.join(known, ["conversation_id", "term"]).join(own.corpus(), "conversation_id")
    return cut(rows.select("query_id", "conversation_id", "term", "mult", F.log((F.col("n") + 1) / F.col("df")).alias("idf"), "avgdl"))


def _parts(queries: DataFrame) -> list[DataFrame]:
    """The terms of the queries, in as many parts as let each be sent to all tasks."""
    terms = cut(retrieve.query_terms(queries))
    n = -(-terms.count() // ASKED)
    return [terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [terms]


def _scores(own: Lexicon, terms: DataFrame, kept: Column | None = None, *more: str) -> DataFrame:
    """(query_id, conversation_id, chunk_id, score) from the blocks of the terms (query_id, conversation_id, term, w, avgdl), or those kept of them.

    The terms go to the blocks. A chunk's postings lie in one file, so they are summed before any row moves.
    """
    key = ["conversation_id", "term", *more]
    rows = own.table("blocks").select("ord", "conversation_id", "term", "no", "max_tf", "min_dl", "entries").join(F.broadcast(terms), key)
    rows = rows if kept is None else rows.where(kept)
    rows = own.live(rows.select("ord", "query_id", "conversation_id", "w", "avgdl", F.explode("entries").alias("e")).select("*", "e.*"))
    return rows.groupBy("query_id", "conversation_id", "chunk_id").agg(F.sum(F.col("w") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def found(queries: DataFrame, own: Lexicon, limit: int = 30) -> Found:
    """The chunks that can be among the ``limit`` best of each query (query_id, conversation_id, query) by their matches."""
    return _found(retrieve.query_terms(queries), own, limit)


def _found(asked: DataFrame, own: Lexicon, limit: int) -> Found:
    terms = _asked(asked, own).withColumn("w", F.col("mult") * F.col("idf"))
    bound = F.col("w") * weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
    sizes = own.table("blocks").select("ord", "conversation_id", "term", "no", "size", "max_tf", "min_dl").join(F.broadcast(terms), ["conversation_id", "term"])
    sizes = sizes.select("query_id", "conversation_id", "term", "ord", "no", "size", "w", "avgdl", bound.alias("bound"))
    # the best block of each term, and the postings of all its blocks
    best = F.max_by(F.struct("ord", "no", "size"), F.struct("bound", -F.col("ord"), -F.col("no"))).alias("b")
    best = cut(sizes.groupBy("query_id", "conversation_id", "term", "w", "avgdl").agg(best, F.max("bound").alias("most"), F.sum("size").alias("all_sizes")).select("*", "b.*").drop("b"))

    # the k-th score can't be below the k-th of what the best blocks alone give
    first = _scores(own, best.select("query_id", "conversation_id", "term", "w", "avgdl", "ord", "no"), None, "ord", "no")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    floor = first.where(F.col("n") == limit).select("query_id", (F.col("score") - MARGIN).alias("floor"))
    most = best.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    whole = Window.partitionBy("query_id")
    most = most.withColumn("needed", F.sum("most").over(whole.orderBy("most", "term")) >= F.col("floor"))
    most = cut(most.withColumns({"all": F.sum("most").over(whole), "rest": F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).over(whole)}))
    wanted = F.col("bound") + F.col("all") - F.col("most") >= F.col("floor")
    needed = most.where("needed").select("query_id", "conversation_id", "term", "w", "avgdl", "all", "most", "floor")
    rest = most.groupBy("query_id", "floor", "rest").agg(F.count_if(~F.col("needed")).alias("others"))
    hits = _scores(own, needed, bound + F.col("all") - F.col("most") >= F.col("floor")).join(F.broadcast(rest), "query_id").where(F.col("score") + F.col("rest") >= F.col("floor"))
    good = cut(hits.select("query_id", "conversation_id", "chunk_id", "score", "others"))

    # the chunks found ask their own terms for the rest; these are summed in the chunk's task as well
    asks = good.where("others > 0")
    others = most.where("not needed").select("query_id", F.col("conversation_id").alias("_conversation"), F.col("term").alias("_term"), "w", "avgdl")
    held = own.near(asks)
    rows = held.select("conversation_id", "chunk_id", "dl", F.explode("terms").alias("t")).select("*", "t.term", "t.tf")
    rows = rows.join(F.broadcast(others), (F.col("conversation_id") == F.col("_conversation")) & (F.col("term") == F.col("_term")))
    more = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("more"))
    out = good.join(more, ["query_id", "chunk_id"], "left").select("query_id", "conversation_id", "chunk_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("extra"))

    every = best.groupBy("query_id").agg(F.sum("all_sizes").alias("postings"), F.sum("size").alias("first"))
    others_read = sizes.drop("w", "avgdl").join(F.broadcast(most.select("query_id", "conversation_id", "term", "needed", "all", "most", "floor", F.col("ord").alias("_ord"), F.col("no").alias("_no"))), ["query_id", "conversation_id", "term"])
    others_read = others_read.where(F.col("needed") & wanted & ((F.col("ord") != F.col("_ord")) | (F.col("no") != F.col("_no")))).groupBy("query_id").agg(F.sum("size").alias("later"))
    looked = asks.groupBy("query_id").agg(F.count("*").alias("looked_up"))
    read = every.join(others_read, "query_id", "left").join(looked, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return Found(terms, out, read.select("query_id", "postings", (F.col("first") + zero("later")).alias("scored"), zero("looked_up").alias("looked_up")))


def matched(asked: DataFrame, own: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(terms, hits) as of :func:`found`, with every chunk that holds one of the terms asked: blocks carry all that a score needs."""
    terms = _asked(asked, own)
    hits = _scores(own, terms.select("query_id", "conversation_id", "term", (F.col("mult") * F.col("idf")).alias("w"), "avgdl"))
    return terms, hits.withColumnRenamed("score", "extra")


def every(queries: DataFrame, own: Lexicon, limit: int = 30, of_type: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`retrieve.bm25_topk`, from the blocks of the queries' terms alone; the better way where lists are short."""
    stats = own.docs().select("conversation_id", "chunk_id")
    return reduce(DataFrame.union, [retrieve.ranked(*matched(part, own), stats, limit, of_type) for part in _parts(queries)])


def topk(queries: DataFrame, own: Lexicon, limit: int = 30) -> DataFrame:
    """The same rows by :func:`found`."""
    stats = own.docs().select("conversation_id", "chunk_id")
    got = [_found(part, own, limit) for part in _parts(queries)]
    return reduce(DataFrame.union, [retrieve.ranked(g.terms, g.hits, stats, limit) for g in got])
