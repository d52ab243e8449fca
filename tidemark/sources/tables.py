"""The given tables bound to the model: files, chunks, messages, vectors, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("document", "image", "audio", "video")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame) -> str:
    """A name of the files behind a table as they are: it changes with any path, size or time of change."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    told = df.select(file.alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
    return f"{told['n']}-{(told['x'] or 0) & (1 << 64) - 1:016x}"


def file_type(key):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(key, F.lit(4)) + 1).cast("int"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, conversation_id, filename, file_type, file_size_bytes, text): a document is a file."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".txt", ".png", ".mp3", ".mkv", ".exe")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")))
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("conversation_id"), name.alias("filename"), file_type(F.col("doc_id")).alias("file_type"), F.col("n_chars").alias("file_size_bytes"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of :func:`texts` with their status, which a join brings."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"))
    return texts(spark, sf_dir).join(labels, "file_id", "left")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, conversation_id, file_type, text): one chunk a document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("conversation_id"), file_type(F.col("doc_id")).alias("file_type"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, conversation_id, query): each benchmark text asked in one conversation."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("conversation_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, conversation_id, vector): stored vectors of the documents with the same id."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return chunks(spark, sf_dir).select("chunk_id", "conversation_id").join(own, "chunk_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, conversation_id, query_vector): the vector with the query's id."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return queries(spark, sf_dir).select("query_id", "conversation_id").join(own, "query_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, source, relation, target, file_id): the star schema as triples; line items repeat supplier-part pairs."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("nation").select(F.lit(0).alias("s"), F.col("n_nationkey").cast("long").alias("k"), key("N:", "n_nationkey").alias("source"), F.lit("PART_OF").alias("relation"), key("R:", "n_regionkey").alias("target"), F.lit("nation").alias("file_id")),
        t("customer").select(F.lit(1), F.col("c_custkey"), key("C:", "c_custkey"), F.lit("BASED_IN"), key("N:", "c_nationkey"), F.lit("customer")),
        t("supplier").select(F.lit(1), F.col("s_suppkey"), key("S:", "s_suppkey"), F.lit("BASED_IN"), key("N:", "s_nationkey"), F.lit("supplier")),
        t("orders").select(F.lit(2), F.col("o_orderkey"), key("O:", "o_orderkey"), F.lit("PLACED_BY"), key("C:", "o_custkey"), F.lit("")),
        t("lineitem").select(F.lit(3), F.col("l_orderkey") * 8 + F.col("l_linenumber"), key("S:", "l_suppkey"), F.lit("SUPPLIES"), key("P:", "l_partkey"), F.lit("lineitem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select((F.col("s").cast("long") * 1_000_000_000_000 + F.col("k")).alias("seq"), "source", "relation", "target", "file_id")


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id) of the files that are done: by their status, or by their text where they have none."""
    # told before the join, so that it moves no text
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.length("text") > 0).alias("has_text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("done"))
    return rows.join(labels, "chunk_id", "left").where(F.coalesce("done", "has_text")).select("chunk_id")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, conversation_id, route): what a routing model would say of each query, here by its number."""
    kinds = [*TYPES, "multimodal", "conversational", "off", "failed"]
    route = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("query_id", F.lit(len(kinds))) + 1).cast("int"))
    return queries(spark, sf_dir).select("query_id", "conversation_id", route.alias("route"))
