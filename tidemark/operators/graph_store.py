"""The graphs of all conversations, kept up by changes: signed rows by (edge, file) and counts by node, in numbered folders.

    <path>/d00000001/edges   (bucket, conversation_id, file_id, source, relation, target, seq, n, sign): an edge as a file tells it, with the seq of
                             its first sighting there and the number of sightings; sign -1 takes such a row back
    <path>/d00000001/nodes   (conversation_id, node, n): by how much the rows that touch a node became more or fewer
    <path>/d00000001/files   (conversation_id, file_id, n): the same for the rows of a file
    <path>/b00000009/...     a merged state, before which no folder counts

A change reads the buckets of its own files and writes its own rows; a node that no row touches any more is gone without a look at the edges. A folder
is made beside its place and appears by one rename; if another writer took its number, the change is refused. Edges: (conversation_id, seq, source, relation, target,
file_id). Empty ends and loops are dropped, a null file_id is the empty one (no file), a null conversation_id is a conversation of its own, equal rows are as
many sightings, and other columns are ignored. An empty store has no rows.
"""

from __future__ import annotations

import functools
import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

from .segments import shared_files

#: Folders that the rows of a change are dealt over by their file, so that a change reads a part of them.
BUCKETS = 64
#: About so many rows are a task's work, and a file, however large a file's graph is; keys of joins up to KEYS are sent to the rows.
PIECE, KEYS = 1 << 18, 200_000
EDGES = "conversation_id string, file_id string, source string, relation string, target string, seq long, n long, sign int, bucket int"
NODES, FILES = "conversation_id string, node string, n long", "conversation_id string, file_id string, n long"
_OWN = ["conversation_id", "file_id", "source", "relation", "target", "seq", "n", "bucket"]


def _bucket() -> Column:
    return F.pmod(F.hash("conversation_id", "file_id"), F.lit(BUCKETS)).cast("int")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys over as many tasks as they need. A task that reads files has as many rows as fit its bytes, too many to group."""
    n = -(-rows.count() // PIECE)
    return rows.repartition(n, *keys) if n > 1 else rows


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows with their bucket, in pieces of about PIECE rows, each a task; a bucket lies in as few as its rows fill. The rows are read twice, once to be counted."""
    sizes = sorted((r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect())  # at most BUCKETS numbers
    if not sizes:
        return rows.withColumn("piece", F.lit(0))
    before = dict(zip((b for b, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0)))
    of = lambda told: F.element_at(F.create_map(*[F.lit(x) for pair in told for x in pair]), F.col("bucket"))
    place = of(before.items()) + F.pmod(F.xxhash64("source", "relation", "target"), of(sizes))
    pieces = -(-sum(n for _, n in sizes) // PIECE)
    return rows.withColumn("piece", F.floor(place / PIECE).cast("int")).repartitionById(pieces, F.col("piece"))


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that count, oldest first."""
    fs, where = shared_files(spark, path)
    known = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    known = sorted((k for k in known if k[:1] in "bd" and k[1:].isdigit()), key=lambda k: k[1:])
    return known[max((i for i, k in enumerate(known) if k[0] == "b"), default=0) :]


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    # each on its own, as its buckets are folders below it
    parts = [spark.read.schema(schema).parquet(f"{path}/{f}/{name}") for f in folders(spark, path)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _living(rows: DataFrame, *dealt_by: str) -> DataFrame:
    return rows.groupBy(*_OWN, *dealt_by).agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, node, n): the nodes that some row touches, from the counts alone."""
    return _dealt(_table(spark, path, "nodes", NODES), "conversation_id", "node").groupBy("conversation_id", "node").agg(F.sum("n").alias("n")).where("n > 0")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, file_id, n): the files whose rows the graphs hold."""
    return _table(spark, path, "files", FILES).groupBy("conversation_id", "file_id").agg(F.sum("n").alias("n")).where("n > 0")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, source, relation, target, seq, file_id, sightings): each edge once, by its first sighting in a file that is still there."""
    edge = ["conversation_id", "source", "relation", "target"]
    rows = _living(_dealt(_table(spark, path, "edges", EDGES), *edge))
    return rows.groupBy(*edge).agg(F.min(F.struct("seq", "file_id")).alias("e"), F.sum(F.col("n") * F.col("sign")).alias("sightings")).select("conversation_id", "source", "relation", "target", "e.seq", "e.file_id", "sightings")


def changed(spark: SparkSession, path: str, gone: DataFrame | None = None, new: DataFrame | None = None) -> str:
    """Takes back the rows of the files ``gone`` (conversation_id, file_id), then adds the edges ``new``, in one folder; returns its name."""
    parts = []
    if new is not None:
        kept = new.where("source <> '' and target <> '' and source <> target").withColumn("file_id", F.coalesce("file_id", F.lit("")))
        kept = _pieces(kept.select("conversation_id", "file_id", "source", "relation", "target", "seq", _bucket().alias("bucket")))
        parts.append(kept.groupBy("conversation_id", "file_id", "source", "relation", "target", "bucket", "piece").agg(F.min("seq").cast("long").alias("seq"), F.count("*").alias("n")).withColumn("sign", F.lit(1)))
    if gone is not None:
        gone = cut(gone.select("conversation_id", F.coalesce("file_id", F.lit("")).alias("file_id")).distinct().withColumn("bucket", _bucket()))
        read = [r[0] for r in gone.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if read:
            held = _met(_table(spark, path, "edges", EDGES).where(F.col("bucket").isin(read)), gone, "left_semi", "conversation_id", "file_id")
            parts.append(_living(_pieces(held), "piece").withColumn("sign", -F.col("sign")))
    rows = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EDGES)
    return _added(spark, path, "d", rows)


def merged(spark: SparkSession, path: str) -> str:
    """One folder with the living rows in place of all before it; those stay until they are deleted, as a reader may use them."""
    return _added(spark, path, "b", _living(_pieces(_table(spark, path, "edges", EDGES)), "piece"))


def _added(spark: SparkSession, path: str, kind: str, rows: DataFrame) -> str:
    known = folders(spark, path)
    number = int(known[-1][1:]) + 1 if known else 1
    draft = f"{path}/_{uuid.uuid4().hex}"
    rows.drop("piece").write.partitionBy("bucket").parquet(f"{draft}/edges")
    own = spark.read.schema(EDGES).parquet(f"{draft}/edges")
    own.groupBy("conversation_id", "file_id").agg(F.sum("sign").alias("n")).write.parquet(f"{draft}/files")
    ends = _dealt(own.select("conversation_id", "source", "target", "sign"), "conversation_id", "source", "target").select("conversation_id", F.explode(F.array("source", "target")).alias("node"), "sign")
    ends.groupBy("conversation_id", "node").agg(F.sum("sign").alias("n")).where("n <> 0").write.parquet(f"{draft}/nodes")
    fs, made = shared_files(spark, draft)
    taken = any(fs.exists(shared_files(spark, f"{path}/{k}{number:08d}")[1]) for k in "bd")
    if taken or not fs.rename(made, shared_files(spark, f"{path}/{kind}{number:08d}")[1]):
        fs.delete(made, True)
        raise RuntimeError(f"change {number} of {path} was written meanwhile")
    return f"{kind}{number:08d}"


def _met(rows: DataFrame, other: DataFrame, how: str, *keys: str) -> DataFrame:
    """Rows that meet a row of the other frame (left_semi) or none (left_anti); null equals null."""
    told = cut(other.select(*[F.col(k).alias(f"other_{k}") for k in keys]).distinct())
    told = F.broadcast(told) if told.count() <= KEYS else told  # few keys would deal all rows to as few tasks
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return rows.join(told, on, how)


def _in(rows: DataFrame, other: DataFrame) -> DataFrame:
    return _met(rows, other, "left_semi", "conversation_id")


def inactive(spark: SparkSession, path: str, conversations: DataFrame, active: DataFrame) -> DataFrame:
    """(conversation_id, file_id) of the stored files that are not active; rows without a file go only where no file of the conversation is active."""
    held = _in(files(spark, path), conversations)
    bare = _met(held.where("file_id = ''"), active, "left_anti", "conversation_id")
    return _met(held.where("file_id <> ''"), active, "left_anti", "conversation_id", "file_id").unionByName(bare).select("conversation_id", "file_id")


def pruned(spark: SparkSession, path: str, conversations: DataFrame, active: DataFrame) -> str:
    """The graphs of the conversations without the files that are not active (conversation_id, file_id); with no active file, a graph is cleared."""
    return changed(spark, path, inactive(spark, path, conversations, active))


def cleared(spark: SparkSession, path: str, conversations: DataFrame) -> str:
    return changed(spark, path, _in(files(spark, path), conversations))


def rebuilt(spark: SparkSession, path: str, conversations: DataFrame, rows: DataFrame) -> str:
    """The graphs of the conversations made anew of their edges in ``rows``, in one change."""
    return changed(spark, path, _in(files(spark, path), conversations), _in(rows, conversations))


def ready(spark: SparkSession, path: str, conversations: DataFrame, active: DataFrame, rows: DataFrame) -> str:
    """What a reader asks for: a graph that is not there is built of its active files' edges (and those without a file), one that is there is pruned; in one change."""
    missing = _met(conversations, files(spark, path), "left_anti", "conversation_id")
    live = _in(rows, active).withColumn("file_id", F.coalesce("file_id", F.lit("")))
    live = live.where("file_id = ''").unionByName(_met(live.where("file_id <> ''"), active, "left_semi", "conversation_id", "file_id"))
    return changed(spark, path, inactive(spark, path, conversations, active), _in(live, missing))
