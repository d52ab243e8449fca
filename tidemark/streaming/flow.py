"""Upload to searchable as one stream: status, chunks, vectors and lexical index of each batch, committed together.

    commits/<batch>.json   what a batch left: its folders and the version of the index; written last, by a rename
    status/<folder>        (file_id, batch, status, attempts, error): one row for each file of a batch
    chunks/<folder>        (batch, file_id, conversation_id, chunk_id, text, ...)
    vectors/<folder>       (batch, chunk_id, vector)
    lexicon                segments of :mod:`tidemark.operators.segments`

A batch that was stopped before its commit left folders that no commit names and index versions that the last commit doesn't know; run
again, it starts from the last commit. A batch that was committed and comes again changes nothing. A file's state is its last
row: done, or retry until its attempts are used up, then failed; a file that comes again and is done replaces its chunks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import chunk, index, ingest, segments
from tidemark.plans.lineage import written

FILES = "file_id long, conversation_id string, filename string, file_type string, content binary"
STATUS = "file_id long, batch long, status string, attempts int, error string"
CHUNKS = "batch long, file_id long, conversation_id string, filename string, file_type string, chunk_index long, chunk_id string, text string, timestamp string, page_number int"
VECTORS = "batch long, chunk_id string, vector array<double>"


@dataclass(frozen=True)
class Store:
    """What the commits so far hold."""

    spark: SparkSession
    path: str
    commits: tuple[dict, ...]

    def table(self, name: str, schema: str) -> DataFrame:
        own = [f"{self.path}/{name}/{c['folder']}" for c in self.commits]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def status(self) -> DataFrame:
        """(file_id, batch, status, attempts, error): the last state of each file."""
        last = self.table("status", STATUS).groupBy("file_id").agg(F.max_by(F.struct("batch", "status", "attempts", "error"), "batch").alias("s"))
        return last.select("file_id", "s.*")

    def _current(self, rows: DataFrame) -> DataFrame:
        """The rows (batch, file_id, ...) of the last batch in which their file was done."""
        done = self.table("status", STATUS).where("status = 'done'").groupBy("file_id").agg(F.max("batch").alias("batch"))
        return rows.join(done, ["file_id", "batch"], "left_semi")

    def chunks(self) -> DataFrame:
        return self._current(self.table("chunks", CHUNKS))

    def vectors(self) -> DataFrame:
        """(conversation_id, chunk_id, vector) of the current chunks."""
        own = self.chunks().select("batch", "conversation_id", "chunk_id")
        return self.table("vectors", VECTORS).join(own, ["batch", "chunk_id"]).select("conversation_id", "chunk_id", "vector")

    def lexicon(self) -> segments.Lexicon | None:
        version = self.commits[-1]["lexicon"] if self.commits else 0
        return segments.opened(self.spark, f"{self.path}/lexicon", version) if version else None


def opened(spark: SparkSession, path: str) -> Store:
    """The store under the path, as of its last commit."""
    fs, where = segments.shared_files(spark, f"{path}/commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
    told = [json.loads(spark.read.text(f"{path}/commits/{n}", wholetext=True).first()[0]) for n in names if n.endswith(".json")]
    return Store(spark, path, tuple(sorted(told, key=lambda c: c["batch"])))


def _marked(spark: SparkSession, path: str, commit: dict) -> None:
    fs, draft = segments.shared_files(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    fs.rename(draft, segments.shared_files(spark, f"{path}/commits/{commit['batch']:012d}.json")[1])


def applied(batch: DataFrame, number: int, path: str, extractors: dict[str, Callable[[DataFrame], DataFrame]], attempts: int = 2) -> Store:
    """The store after a batch of files; the same as before if the batch was committed already."""
    spark = batch.sparkSession
    now = opened(spark, path)
    if any(c["batch"] == number for c in now.commits):
        return now
    folder = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    known = now.status().select("file_id", F.col("attempts").alias("before"), F.col("status").alias("was"))
    # one row a file: of files told twice in a batch, the last by name
    once = batch.groupBy("file_id").agg(F.max_by(F.struct("conversation_id", "filename", "file_type", "content"), "filename").alias("f")).select("file_id", "f.*")
    got = written(ingest.extracted(once, extractors).join(known, "file_id", "left"))
    tries = F.when(F.col("was") == "retry", F.col("before")).otherwise(0) + 1
    state = F.when(F.col("status") == "done", "done").when(tries < attempts, "retry").otherwise("failed")
    status = got.select("file_id", F.lit(number).cast("long").alias("batch"), state.alias("status"), tries.cast("int").alias("attempts"), F.col("extraction_error").alias("error"))
    status.write.parquet(f"{path}/status/{folder}")

    done = got.where("status = 'done'")
    parts = chunk.chunked(done.select("file_id", "filename", F.col("extracted_text").alias("text")))
    owner = done.select("file_id", "conversation_id", "filename", "file_type")
    parts.join(owner, "file_id").withColumn("batch", F.lit(number).cast("long")).write.parquet(f"{path}/chunks/{folder}")
    new = spark.read.schema(CHUNKS).parquet(f"{path}/chunks/{folder}")
    dense = index.dense_vectors(index.stub_vectors(new), new).withColumn("batch", F.lit(number).cast("long"))
    dense.write.parquet(f"{path}/vectors/{folder}")
    gone = now.chunks().join(done.select("file_id"), "file_id", "left_semi").select("chunk_id")
    lexicon, rows = now.lexicon(), new.select("conversation_id", "chunk_id", "text")
    segments.rolled_back(spark, f"{path}/lexicon", lexicon.version if lexicon else 0)
    lexicon = segments.changed(lexicon, rows, gone) if lexicon else segments.created(rows, f"{path}/lexicon")
    _marked(spark, path, {"batch": number, "folder": folder, "lexicon": lexicon.version})
    return opened(spark, path)


def ingest_files(spark: SparkSession, source: str, path: str, checkpoint: str, extractors: dict[str, Callable[[DataFrame], DataFrame]], attempts: int = 2) -> StreamingQuery:
    """Reads new Parquet files of FILES under ``source`` into the store, until none is left (availableNow)."""
    files = spark.readStream.schema(FILES).parquet(source)
    return files.writeStream.foreachBatch(lambda batch, number: applied(batch, number, path, extractors, attempts) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
