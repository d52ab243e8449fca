"""Sources and timelines: text decoding, page tags, media stamps, key frames, file-source stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import written

from . import chunk, segments, session


def decoded(raw: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, text) of a folder of text files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), decoded(F.col("content")).alias("text"))


def new_files(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """(filename, content) of the files of a folder, by name, less those whose (filename) is done already."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return rows.join(done.select("filename").distinct(), "filename", "left_anti").orderBy("filename")


def clean_text(text: Column) -> Column:
    """Control and private-use characters to blanks, bullets to '- ', long runs of line feeds to two."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    x = F.regexp_replace(x, r"[\x{E000}-\x{F8FF}\x{10000}-\x{10FFFF}]", " ")
    x = F.regexp_replace(x, r"(?m)^[ \t]*[•▪●◦‣·*][ \t]+", "- ")
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def page_tagged(number: Column, text: Column, ocr: Column, least: int = 40) -> Column:
    """A page's text under its tag: own text with enough letters and digits, else recognised text, else own text."""
    enough = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]", "")) >= least
    tag = lambda extra: F.concat(F.lit("[Page "), number.cast("string"), F.lit(extra + "]\n"))
    return F.when(enough, F.concat(tag(""), text)).when(F.length(F.coalesce(ocr, F.lit(""))) > 0, F.concat(tag(" (OCR)"), ocr)).otherwise(F.concat(tag(""), F.coalesce(text, F.lit(""))))


# The letters and digits that make recognised text of an image worth keeping alone, and the most bytes of a text.
IMAGE_LETTERS, MOST_BYTES = 30, 1_000_000


def image_text(filename: Column, ocr: Column, caption: Column, width: Column, height: Column) -> Column:
    """An image's text: recognised text if there is enough, else the caption with what was recognised, else what is known of it."""
    ocr = F.btrim(F.coalesce(ocr, F.lit("")), F.lit(" \n\t\r\f"))
    own = F.concat(F.lit("[Image OCR Text - "), filename, F.lit("]:\n"), ocr)
    described = F.concat(F.lit("[Visual Description - "), filename, F.lit("]:\n"), caption)
    described = F.when(ocr != "", F.concat(F.lit("[Detected Text Fragments]:\n"), ocr, F.lit("\n\n"), described)).otherwise(described)
    bare = F.concat(F.lit("[Image File - "), filename, F.lit("]: "))
    plain = F.when(width.isNotNull() & height.isNotNull(), F.concat(bare, F.lit("Resolution "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("px."))).otherwise(F.concat(bare, F.lit("Image data recorded.")))
    enough = F.length(F.regexp_replace(ocr, "[^a-zA-Z0-9]", "")) >= IMAGE_LETTERS
    return F.when(enough, own).when(caption.isNotNull(), described).when(ocr != "", own).otherwise(plain)


def speech_line(start: Column, end: Column, text: Column, video: bool = False) -> Column:
    """A segment's line: its stamps and text; null for a segment without text."""
    stamps = F.concat(F.lit("["), T.media_time(start), F.lit(" - "), T.media_time(end), F.lit(" (Speech)]: " if video else "] "))
    return F.when(F.btrim(text) != "", F.concat(stamps, F.btrim(text)))


def transcripts(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_id, text): a header and the lines of the segments (file_id, start, end, text), for each of (file_id, filename, language, seconds)."""
    line = speech_line(F.col("start"), F.col("end"), F.col("text"))
    listed = segments.where(F.btrim("text") != "").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))).alias("all"))
    name = F.concat(F.lit("[Audio Transcript - "), "filename")
    head = F.concat(name, F.lit(" (Language: "), "language", F.lit(", Duration: "), F.col("seconds").cast("long").cast("string"), F.lit("s)]:\n"))
    said = F.concat(head, F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    return files.join(listed, "file_id", "left").select("file_id", F.when(F.col("all").isNull(), F.concat(name, F.lit("]:\n(No audible speech detected in audio file)"))).otherwise(said).alias("text"))


def capped(text: Column, most: int = MOST_BYTES) -> Column:
    """The text's first ``most`` bytes of UTF-8; a character that is cut becomes the replacement character."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(raw) > most, F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))).otherwise(text)


def extracted(files: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], most: int | None = MOST_BYTES) -> DataFrame:
    """Files (file_id, conversation_id, filename, file_type, content) with extracted_text, status, extraction_error and is_cut.

    A text of over ``most`` bytes is cut there, which is_cut tells; with None, texts stay whole.

    extractors: for each kind a function from (file_id, filename, content) to (file_id, text, error). The kinds are pdf, docx
    and text for documents, by their suffix, and image, audio and video; other types count as documents. A file ends as
    done, or as failed with what went wrong; a kind without an extractor fails.
    """
    low = F.lower("filename")
    paper = F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.docx?$"), "docx").otherwise("text")
    kind = F.when(F.col("file_type").isin("image", "audio", "video"), F.col("file_type")).otherwise(paper)
    rows = files.withColumn("_kind", kind)
    out = None
    for name, extract in extractors.items():
        part = extract(rows.where(F.col("_kind") == name).select("file_id", "filename", "content")).select("file_id", "text", "error")
        out = part if out is None else out.unionByName(part)
    got = rows.join(out.withColumn("_got", F.lit(True)), "file_id", "left")
    error = F.when(F.col("_got").isNull(), F.concat(F.lit("no extractor for "), "_kind")).otherwise(F.col("error"))
    got = got.withColumn("extraction_error", F.concat(F.lit("Extraction failed: "), error))
    failed = F.col("extraction_error").isNotNull()
    text = F.coalesce("text", F.lit(""))
    long_ = F.lit(False) if most is None else ~failed & (F.octet_length(text) > most)
    return got.select(*files.columns, F.when(~failed, text if most is None else capped(text, most)).alias("extracted_text"), F.when(failed, "failed").otherwise("done").alias("status"), "extraction_error", long_.alias("is_cut"))


def plain_texts(rows: DataFrame) -> DataFrame:
    """The extractor of text files."""
    return rows.select("file_id", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))


def ingested(files: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], path: str, most: int | None = MOST_BYTES) -> tuple[DataFrame, DataFrame, segments.Lexicon]:
    """(files with status and text, chunks, index): extraction, chunking and the lexical index of new files in one flow.

    The index under the path is made or changed; chunks of the same files in it are replaced.
    """
    done = written(extracted(session.validated(files).where("valid").drop("valid", "error"), extractors, most))
    parts = chunk.chunked(done.where("status = 'done'").select("file_id", "filename", F.col("extracted_text").alias("text")))
    owner = done.select("file_id", "conversation_id", "filename", "file_type")
    parts = written(parts.join(owner, "file_id"))
    rows = parts.select("conversation_id", "chunk_id", "text")
    spark = files.sparkSession
    return done, parts, segments.changed(segments.opened(spark, path), rows) if segments.versions(spark, path) else segments.created(rows, path)


def keyframes(duration: Column, step: int = 12, most: int = 6) -> Column:
    """Seconds of the sampled frames: 2, 14, ... below the duration (60 if unknown); 0.5 if there is none."""
    d = F.coalesce(duration, F.lit(60.0))
    times = F.slice(F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * step + 2).cast("double")), lambda t: t < d), 1, most)
    return F.when(F.size(times) == 0, F.array(F.lit(0.5))).otherwise(times)


def timeline(speech: DataFrame, frames: DataFrame) -> DataFrame:
    """(key, line_no, line): speech and frame lines of (key, second, text) by second, speech first on ties, then by text."""
    both = speech.select("key", "second", F.lit(0).alias("kind"), "text").unionAll(frames.select("key", "second", F.lit(1).alias("kind"), "text"))
    line = F.concat(F.lit("["), T.media_time(F.col("second")), F.lit("] "), "text")
    lines = session.listed(both.select("key", "second", "kind", line.alias("line")), "key", [F.col("second"), F.col("kind"), F.col("line")])
    return lines.select("key", F.col("position").alias("line_no"), "line")
