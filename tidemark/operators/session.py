"""Files, conversations and messages: lists, counts, upserts, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import written

# Extensions of each modality.
EXTENSIONS = {"document": ["pdf", "doc", "docx", "txt", "md"], "image": ["png", "jpg", "jpeg", "webp"], "audio": ["mp3", "wav", "m4a", "ogg"], "video": ["mp4", "mov", "mkv", "webm"]}
SIZE_LIMIT, FILE_LIMIT = 50 * 1024 * 1024, 20


def modality(filename: Column) -> Column:
    """The modality of a file name's extension, or null."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    out = F.when(ext.isin(EXTENSIONS["document"]), "document")
    for name in ("image", "audio", "video"):
        out = out.when(ext.isin(EXTENSIONS[name]), name)
    return out


def validated(files: DataFrame) -> DataFrame:
    """Adds file_type, valid and error."""
    kind = modality(F.col("filename"))
    error = F.when(kind.isNull(), "unsupported extension").when(F.col("file_size_bytes") > SIZE_LIMIT, "file too large")
    return files.withColumns({"file_type": kind, "valid": error.isNull(), "error": error})


def by_type(files: DataFrame) -> DataFrame:
    """Counts by modality of each conversation, 0 where there is none."""
    return files.groupBy("conversation_id").agg(*[F.count(F.when(F.col("file_type") == k, 1)).alias(f"n_{k}") for k in EXTENSIONS])


def with_status(files: DataFrame) -> DataFrame:
    """A missing status is done if there is text, else pending."""
    return files.withColumn("status", F.coalesce("status", F.when(F.length("text") > 0, "done").otherwise("pending")))


def within_quota(existing: DataFrame, new: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """The new files of conversations whose total stays within the limit."""
    held = existing.groupBy("conversation_id").agg(F.count("*").alias("held"))
    more = new.groupBy("conversation_id").agg(F.count("*").alias("more"))
    fits = more.join(held, "conversation_id", "left").where(F.coalesce("held", F.lit(0)) + F.col("more") <= limit)
    return new.join(fits.select("conversation_id"), "conversation_id", "left_semi")


def uploaded(new: DataFrame, existing: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """New files (file_id, conversation_id, filename, file_size_bytes, ...) with status and error: pending, or rejected for their
    suffix or size, or because their conversation would have more files than the limit. Write the pending ones with
    ``partitionBy("conversation_id")``, so that a conversation's files lie together."""
    checked = validated(new.drop("file_type"))
    fits = within_quota(existing, checked.where("valid"), limit).select("file_id").withColumn("_fits", F.lit(True))
    rows = checked.join(fits, "file_id", "left")
    error = F.coalesce("error", F.when(F.col("_fits").isNull(), "too many files"))
    return rows.withColumns({"error": error, "status": F.when(error.isNull(), "pending").otherwise("rejected")}).drop("valid", "_fits")


def with_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with the status, text and error of their results (file_id, status, extracted_text, extraction_error) where they have one;
    a result without a text leaves the old one."""
    new = results.select("file_id", *[F.col(c).alias(f"_{c}") for c in ("status", "extracted_text", "extraction_error")])
    rows = files.join(new, "file_id", "left")
    has = F.col("_status").isNotNull()
    values = {"status": F.coalesce("_status", "status"), "extracted_text": F.coalesce("_extracted_text", "extracted_text"), "extraction_error": F.when(has, F.col("_extraction_error")).otherwise(F.col("extraction_error"))}
    return rows.withColumns(values).select(*files.columns)


def summary(conversations: DataFrame, files: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with file and message counts; files of an unknown conversation create a row."""
    f = files.groupBy("conversation_id").agg(F.count("*").alias("n_files"))
    m = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"))
    joined = conversations.select("conversation_id", "title").join(f, "conversation_id", "full_outer").join(m, "conversation_id", "left")
    title = F.coalesce("title", F.concat(F.lit("Session "), F.substring("conversation_id", 1, 8)))
    return joined.select("conversation_id", title.alias("title"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def upserted(messages: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def listed_first(rows: DataFrame, key: str, newest: str, most: int, tie: str) -> DataFrame:
    """The first ``most`` rows of each key, newest first, rows without a time last, with their position."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(newest), tie)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def saved_messages(old: DataFrame, new: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (conversation_id, message_id, created_at, ...) with the new ones in the place of those of their id, and the
    conversations (conversation_id, updated_at, ...) with the time of their newest message where that is later."""
    both = old.join(new.select("message_id"), "message_id", "left_anti").unionByName(new)
    last = new.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    bumped = conversations.join(last, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")
    return both, bumped


def renamed(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Conversations (conversation_id, title) with new titles; a title for an unknown id makes its row."""
    joined = conversations.select("conversation_id", "title").join(changes.select("conversation_id", F.col("title").alias("new")), "conversation_id", "full_outer")
    return joined.select("conversation_id", F.coalesce("new", "title").alias("title"))


def progress(files: DataFrame) -> DataFrame:
    """(conversation_id, n_failed, any_active): failed files, and whether one is still pending or in work."""
    return files.groupBy("conversation_id").agg(F.count_if(F.col("status") == "failed").alias("n_failed"), F.bool_or(F.col("status").isin("pending", "processing")).alias("any_active"))


def remapped(rows: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Rows (file_id, filename, ...) with the copied files' ids: by (file_id, new_id), else by (filename, new_id), else their own."""
    first = rows.join(by_id.withColumnRenamed("new_id", "_by_id"), "file_id", "left").join(by_name.withColumnRenamed("new_id", "_by_name"), "filename", "left")
    return first.withColumn("file_id", F.coalesce("_by_id", "_by_name", "file_id")).drop("_by_id", "_by_name")


def auto_title(title: Column, query: Column) -> Column:
    """A default title becomes the first 40 characters of the query."""
    default = title.isNull() | title.isin("New Conversation", "New Session", "") | title.startswith("Session conv_")
    short = F.concat(F.btrim(F.substring(query, 1, 40)), F.when(F.length(query) > 40, "...").otherwise(""))
    return F.when(default, short).otherwise(title)


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without rows whose key is in ``gone``: one step of a cascade."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def cloned(files: DataFrame, user: str) -> DataFrame:
    """Copies with new ids that depend on the old id and the user alone."""
    new = lambda c: F.sha2(F.concat_ws(":", F.lit(user), F.col(c).cast("string")), 256)
    return files.withColumns({"new_file_id": new("file_id"), "new_conversation_id": new("conversation_id")})


def listed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows with their position within the key.

    Rows are dealt by ranges of (key, order) and numbered within a range; the rows of a key in earlier ranges are counted
    before. So a key with very many rows is the work of several tasks.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_of")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn("position", (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_key", "_of", "_before")


def deleted_conversations(conversations: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Conversations, and each table that hangs on them, without those in ``gone``."""
    return deleted(conversations, gone, "conversation_id"), {name: deleted(t, gone, "conversation_id") for name, t in dependents.items()}


def visible(rows: DataFrame, owned: DataFrame, user: str) -> DataFrame:
    """Rows of the conversations that belong to the user, by (conversation_id, user_id)."""
    return rows.join(owned.where(F.col("user_id") == user).select("conversation_id").distinct(), "conversation_id", "left_semi")
