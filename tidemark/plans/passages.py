"""Queries over texts, pages, stamps, stand-in vectors, files and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunk, index, retrieve, session
from tidemark.sources import tables as S

from . import oracle as O
from .registry import query


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter({O.words('text')}, lambda w: NOT list_contains({O.STOP}, w))) AS w FROM conversations) GROUP BY w")
def stopword_filter(spark, d):
    words = F.filter(T.words(F.col("text")), lambda w: ~w.isin(T.STOPWORDS))
    return S.table(spark, d, "conversations").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 90 + 1 END AS INT) AS page_number FROM documents")
def page_number_extract(spark, d):
    key = F.col("doc_id")
    tag = F.when(key % 3 == 0, "no tag ").when(key % 3 == 1, F.concat(F.lit("x [Page "), (key % 90 + 1).cast("string"), F.lit("] "))).otherwise(F.concat(F.lit("[PAGE"), (key % 90 + 1).cast("string"), F.lit(" (OCR)] ")))
    return S.table(spark, d, "documents").select("doc_id", chunk.page_number(F.concat(tag, F.coalesce("text", F.lit("")))).alias("page_number"))


@query("""WITH k AS (SELECT doc_id, text, strpos(lower(text), 'the') AS at_ FROM documents WHERE text IS NOT NULL), b AS (SELECT *, greatest(1, at_ - 100) AS s, least(length(text), at_ + 239) AS e FROM k)
SELECT doc_id, sha256(CASE WHEN at_ > 0 THEN CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END
  WHEN length(text) > 320 THEN left(text, 300) || '...' ELSE text END) AS snippet FROM b""")
def snippet_window(spark, d):
    rows = S.table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(T.snippet(F.col("text"), F.lit("The")), 256).alias("snippet"))


@query("SELECT event_id, CAST(event_id * 7 % 9000 AS BIGINT) AS seconds FROM events")
def media_time_seconds(spark, d):
    stamp = T.media_time(F.col("event_id") * 7 % 9000)
    return S.table(spark, d, "events").select("event_id", T.seconds_of(F.concat(F.lit("["), stamp, F.lit(" - 23:59:59]"))).cast("long").alias("seconds"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
SELECT doc_id, sha256(trim(lines[2], ' ' || chr(10) || chr(9) || chr(13))) AS page FROM l""")
def page_isolate(spark, d):
    """The second page of each document, its lines taken as pages; null without one."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("--- page "), (i + 1).cast("string"), F.lit(" ---"))), x))
    return S.table(spark, d, "documents").select("doc_id", F.sha2(T.page_text(F.array_join(lines, "\n"), F.lit(2)), 256).alias("page"))


_STAMPED = """WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: '[' || lpad((i % 60)::VARCHAR, 2, '0') || ':' || lpad((i % 60)::VARCHAR, 2, '0') || '] ' || x), lambda x: true) AS parts FROM documents),
p AS (SELECT doc_id, i, trim(parts[i], ' ' || chr(9) || chr(10) || chr(13)) AS t FROM b, unnest(range(1, len(parts) + 1)) AS r(i)),
g AS (SELECT doc_id, i, 0 AS c, length(t) AS n FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN g.n + length(p.t) + 2 <= {size} THEN g.c ELSE g.c + 1 END, CASE WHEN g.n + length(p.t) + 2 <= {size} THEN g.n + {glue} + length(p.t) ELSE length(p.t) END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1)
"""


def _stamped(spark, d):
    two = lambda i: F.lpad((i % 60).cast("string"), 2, "0")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("["), two(i + 1), F.lit(":"), two(i + 1), F.lit("] "), x))
    return S.texts(spark, d).withColumn("text", F.array_join(lines, "\n"))


@query(_STAMPED.format(size=1800, glue=1) + "SELECT doc_id AS file_id, CAST(c AS BIGINT) AS chunk_index, lpad((min(i) % 60)::VARCHAR, 2, '0') || ':' || lpad((min(i) % 60)::VARCHAR, 2, '0') AS timestamp, CAST(sum(length(t)) + count(*) - 1 AS BIGINT) AS n_chars FROM g JOIN p USING (doc_id, i) GROUP BY doc_id, c")
def chunk_timestamps(spark, d):
    body = F.regexp_replace("text", r"^\[[^\n]*\]\n", "")
    return chunk.by_blocks(_stamped(spark, d)).select("file_id", "chunk_index", "timestamp", F.length(body).cast("long").alias("n_chars"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: trim('[Page ' || i || '] ' || x, ' ' || chr(9) || chr(10) || chr(13))) AS parts FROM documents),
k AS (SELECT doc_id, i AS page, parts[i] AS t FROM b, unnest(range(1, len(parts) + 1)) AS r(i) WHERE length(parts[i]) >= 20), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM k),
g AS (SELECT doc_id, i, 0 AS c, length(t) AS n FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN g.n + length(p.t) + 2 <= 4200 THEN g.c ELSE g.c + 1 END, CASE WHEN g.n + length(p.t) + 2 <= 4200 THEN g.n + 2 + length(p.t) ELSE length(p.t) END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1)
SELECT doc_id AS file_id, CAST(c AS INT) AS window_no, CAST(min(page) AS INT) AS page_number, CAST(sum(length(t)) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM g JOIN p USING (doc_id, i) GROUP BY doc_id, c""")
def graph_windows_pages(spark, d):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("] "), x))
    found = chunk.windows(S.texts(spark, d).withColumn("text", F.array_join(lines, "\n")), r"(?=\[Page\s*\d+)", 4200, 20)
    return found.select("file_id", "window_no", "page_number", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {O.CHUNKS}, s AS (SELECT chunk_id, ('0x' || left(md5(w), 8))::BIGINT % 384 AS slot, count(*) AS n FROM (SELECT chunk_id, unnest({O.tokens('text')}) AS w FROM chunks) GROUP BY ALL)
SELECT chunk_id, CAST(slot AS INT) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS value FROM s""")
def embed_stub(spark, d):
    return index.stub_vectors(S.chunks(spark, d)).select("chunk_id", "slot", F.round("value", 6).alias("value"))


@query("SELECT doc_id AS file_id, source AS conversation_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS position FROM documents")
def list_files(spark, d):
    return session.listed(S.files(spark, d).select("file_id", "conversation_id"), "conversation_id", [F.desc("file_id")])


@query("""WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') SELECT 'conversations' AS part, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id NOT IN (FROM gone)
UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id NOT IN (FROM gone)""")
def delete_conversation_cascade(spark, d):
    rows = S.messages(spark, d)
    gone = rows.where("role = 'system'").select("conversation_id").distinct()
    owners, messages = session.deleted_conversations(rows.select("conversation_id").distinct(), {"messages": rows}, gone)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count("conversations", owners).union(count("messages", messages["messages"]))


@query("SELECT doc_id AS file_id, source AS conversation_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 1)")
def rls_filter(spark, d):
    """A conversation belongs to the user named by the parity of its first file; one user sees its files."""
    files = S.files(spark, d)
    owned = files.where("conversation_id is not null").groupBy("conversation_id").agg((F.min("file_id") % 2).cast("string").alias("user_id"))
    return session.visible(files, owned, "1").select("file_id", "conversation_id")


@query("SELECT item_id AS query_id, modality, CASE WHEN modality = 'document' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM benchmark, (SELECT unnest(['document','image','audio','video']) AS modality) m")
def modality_weights(spark, d):
    return retrieve.default_weights(S.queries(spark, d)).withColumnRenamed("file_type", "modality")
