"""Queries of ingest, of graph upkeep, and of lists, names and texts around sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import answer, chunk, extract, graph, graph_store, ingest, resolve, segments, session, synthesis
from tidemark.sources import tables as S
from tidemark.streaming import flow

from . import catalogue as C, knowledge as K, oracle as O
from .lineage import shared_dir, written
from .registry import query


# ---- graph upkeep

def _edges(spark, d):
    """The given edges, each once, with what a stored edge has besides."""
    e = graph.dedup_edges(S.edges(spark, d)).drop("sightings")
    return e.withColumns({"evidence": F.concat_ws(" ", "source", "relation", "target"), "filename": F.col("file_id"), "chunk_id": F.concat(F.lit("c"), F.col("seq").cast("string")), "page_number": (F.col("seq") % 9 + 1).cast("int"), "timestamp": F.lit(None).cast("string"), "confidence": F.lit(0.9)})


def _nodes(spark, d):
    return S.edges(spark, d).select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.concat(F.lit("Name "), "node").alias("name"), F.left("node", F.lit(1)).alias("type"))


_NODES = "nodes AS (SELECT DISTINCT node, 'Name ' || node AS name, left(node, 1) AS type FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e))"


@query(f"WITH {O.EDGES}, k AS (SELECT * FROM e WHERE file_id = '' OR file_id IN ('nation', 'supplier')) SELECT source AS node FROM k UNION SELECT target FROM k")
def graph_pruned(spark, d):
    """The nodes that stay when only two files are active."""
    return graph.pruned(_nodes(spark, d), S.edges(spark, d), spark.createDataFrame([("nation",), ("supplier",)], "file_id string"))[0].select("node")


@query(f"WITH {O.EDGES}, k AS (SELECT * FROM e WHERE file_id <> 'nation') SELECT source AS node FROM k UNION SELECT target FROM k")
def graph_without_file(spark, d):
    """The nodes that stay when a file goes: the regions are left alone and go with it."""
    return graph.removed(_nodes(spark, d), S.edges(spark, d), "nation")[0].select("node")


@query(f"WITH {O.EDGES}, u AS (SELECT DISTINCT source, relation, target FROM e) SELECT (SELECT count(*) FROM (SELECT source FROM u UNION SELECT target FROM u)) AS node_count, (SELECT count(*) FROM u) AS edge_count")
def graph_counts(spark, d):
    return graph.exported(_nodes(spark, d), graph.dedup_edges(S.edges(spark, d)))[1]


@query(f"""WITH {O.EDGES}, r AS (SELECT seq, source, relation, target, CASE WHEN file_id = '' THEN '' ELSE file_id || '-' || (seq % 5) END AS file_id, 'g' || CASE WHEN seq % 7 = 0 THEN 2 ELSE seq % 2 END AS conversation_id FROM e),
k AS (SELECT * FROM r WHERE conversation_id = 'g0' AND (file_id NOT LIKE '%-1' OR file_id = 'supplier-1') OR conversation_id = 'g1' AND file_id NOT LIKE '%-1' AND file_id NOT LIKE 'lineitem%'),
n AS (SELECT conversation_id, node, count(*) AS n FROM (SELECT DISTINCT conversation_id, file_id, source, relation, target, unnest([source, target]) AS node FROM k WHERE source <> target) GROUP BY ALL)
SELECT 'edge' AS part, conversation_id, source || ' ' || relation || ' ' || target AS id, min(seq) AS seq, arg_min(file_id, seq) AS file_id, count(*) AS n FROM k WHERE source <> target GROUP BY conversation_id, source, relation, target
UNION ALL SELECT 'node', conversation_id, node, 0, '', n FROM n""")
def graph_upkeep(spark, d):
    """Graphs built on demand, files removed, one told again, two conversations pruned, a merge between: what is left."""
    path, seq = shared_dir(spark, "graphs"), F.col("seq")
    file = F.when(F.col("file_id") == "", "").otherwise(F.concat_ws("-", "file_id", (seq % 5).cast("string")))
    rows = written(S.edges(spark, d).withColumns({"file_id": file, "conversation_id": F.concat(F.lit("g"), F.when(seq % 7 == 0, 2).otherwise(seq % 2).cast("string"))}))
    told = written(rows.where("file_id <> ''").select("conversation_id", "file_id").distinct())
    every = written(rows.select("conversation_id").distinct())
    graph_store.ready(spark, path, every, told, rows)
    graph_store.changed(spark, path, gone=told.where("file_id like '%-1'"))
    graph_store.merged(spark, path)
    graph_store.changed(spark, path, new=rows.where("file_id = 'supplier-1' and conversation_id = 'g0'"))
    graph_store.ready(spark, path, every.where("conversation_id in ('g1', 'g2')"), told.where("conversation_id = 'g1' and file_id not like 'lineitem%'"), rows)
    e = graph_store.edges(spark, path).select(F.lit("edge").alias("part"), "conversation_id", F.concat_ws(" ", "source", "relation", "target").alias("id"), "seq", "file_id", F.col("sightings").alias("n"))
    none = {"seq": F.lit(0).cast("long"), "file_id": F.lit("")}
    return e.unionByName(graph_store.nodes(spark, path).withColumns({"part": F.lit("node"), **none}).select("part", "conversation_id", F.col("node").alias("id"), "seq", "file_id", "n"))


@query(f"WITH {O.EDGES}, {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_types(spark, d):
    return graph.exported(_nodes(spark, d), S.edges(spark, d))[0].groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {O.EDGES}, u AS (SELECT DISTINCT source, relation, target FROM e), g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM u UNION ALL SELECT target FROM u) GROUP BY node) SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 50")
def nodes_by_degree(spark, d):
    """The fifty nodes of the highest degree."""
    return graph.degrees(graph.dedup_edges(S.edges(spark, d))).orderBy(F.desc("degree"), "node").limit(50)


@query(f"WITH {O.EDGES}, {_NODES} SELECT 'edge' AS part, source || '>' || target AS id, relation AS kind, source || ' ' || relation || ' ' || target AS said, 0.9::DOUBLE AS confidence, min(seq) AS seq FROM e WHERE source <> target GROUP BY source, relation, target UNION ALL SELECT 'node', node, type, name, NULL, NULL FROM nodes")
def graph_round_trip(spark, d):
    """The graph written as JSON and read back, where missing values get their defaults."""
    path = shared_dir(spark, "graph")
    edges = _edges(spark, d).drop("confidence")
    graph.saved(_nodes(spark, d).withColumnRenamed("node", "id"), edges, path)
    nodes, edges = graph.loaded(spark, path)
    rows = edges.select(F.lit("edge").alias("part"), F.concat_ws(">", "source", "target").alias("id"), F.col("relation").alias("kind"), F.col("evidence").alias("said"), "confidence", "seq")
    return rows.unionByName(nodes.select(F.lit("node").alias("part"), F.col("node").alias("id"), F.col("type").alias("kind"), F.col("name").alias("said"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("seq")))


_ONCE = "u AS (SELECT min(seq) AS seq, source, relation, target, arg_min(file_id, seq) AS file_id FROM e WHERE source <> target GROUP BY source, relation, target)"


@query(f"""WITH {O.EDGES}, {_ONCE}, {O.visits('u', ['S:1'], 1, 15, "CASE WHEN file_id = 'supplier' THEN 0 ELSE 1 END")}
SELECT hop_no, seq, 'Name ' || source AS from_name, left(source, 1) AS from_type, relation, 'Name ' || target AS to_name, left(target, 1) AS to_type, source || ' ' || relation || ' ' || target AS evidence, file_id AS filename, CAST(seq % 9 + 1 AS INT) AS page_number FROM walked""")
def entity_neighborhood(spark, d):
    """The first fifteen hops around a supplier, those of a target file first; its own edges are more, so the twin walks one level."""
    found = graph.around(_edges(spark, d), _nodes(spark, d), ["S:1"], 2, 15, "Supplier")
    return found.select("hop_no", "seq", "from_name", "from_type", "relation", "to_name", "to_type", "evidence", "filename", "page_number")


@query(f"""WITH {O.EDGES}, {_ONCE}, {O.visits('u', ['R:1', 'N:3'], 3, 400)} SELECT hop_no, level, seq, source, relation, target FROM walked""")
def visiting_order(spark, d):
    """The first four hundred hops from a region and a nation, in the order of a queue."""
    return graph.searched(graph.dedup_edges(S.edges(spark, d)), ["R:1", "N:3"], 3, 400)


@query(f"""WITH {O.BOTH}, p1 AS (SELECT other AS node, ['S:1', other] AS path FROM b WHERE node = 'S:1'),
p2 AS (SELECT b.other AS node, list_append(path, b.other) AS path FROM p1 JOIN b USING (node) WHERE b.other <> 'S:1'),
a AS (SELECT path FROM p1 WHERE node = 'S:2' UNION ALL SELECT path FROM p2 WHERE node = 'S:2'), p AS (SELECT path FROM a ORDER BY len(path), path LIMIT 1),
h AS (SELECT i AS hop_no, path[i] AS source, path[i + 1] AS target FROM p, unnest(range(1, len(path))) AS t(i)),
f AS (SELECT hop_no, h.source, h.target, min(e.seq) FILTER (e.source = h.source) AS fore, min(e.seq) FILTER (e.source = h.target) AS back FROM h JOIN e ON (e.source = h.source AND e.target = h.target) OR (e.source = h.target AND e.target = h.source) GROUP BY ALL)
SELECT CAST(hop_no AS INT) AS hop_no, 'Name ' || f.source AS from_name, left(f.source, 1) AS from_type, e.relation, 'Name ' || f.target AS to_name, left(f.target, 1) AS to_type, fore IS NULL AS is_reverse, e.source || ' ' || e.relation || ' ' || e.target AS evidence, e.file_id AS filename, CAST(e.seq % 9 + 1 AS INT) AS page_number
FROM f JOIN (SELECT DISTINCT * FROM e) e ON e.seq = coalesce(fore, back) AND ((e.source = f.source AND e.target = f.target) OR (e.source = f.target AND e.target = f.source))""")
def path_hops_metadata(spark, d):
    """The hops of the shortest path between two suppliers, with names, types, evidence, file and page."""
    edges = written(_edges(spark, d))
    hops = resolve.path_hops(graph.shortest_paths(edges, "S:1", "S:2").withColumn("chain_id", F.lit(1)), edges)
    return resolve.hops_told(hops, edges, _nodes(spark, d)).select("hop_no", "from_name", "from_type", "relation", "to_name", "to_type", "is_reverse", "evidence", "filename", "page_number")


@query(f"""WITH {O.EDGES}, {_NODES}, m AS (SELECT node, CASE WHEN node LIKE '%1' THEN node WHEN node LIKE '%2' THEN name WHEN node LIKE '%3' THEN upper(name) ELSE 'nobody ' || node END AS "end" FROM nodes WHERE type IN ('S', 'N'))
SELECT "end", node FROM m WHERE node SIMILAR TO '.*[123]'""")
def edge_ends(spark, d):
    """Ends of edges written as ids, names, and names in capitals, and the nodes they mean."""
    n = _nodes(spark, d)
    end = F.when(F.col("node").rlike("1$"), F.col("node")).when(F.col("node").rlike("2$"), F.col("name")).when(F.col("node").rlike("3$"), F.upper("name")).otherwise(F.concat(F.lit("nobody "), "node"))
    return graph.matching_nodes(n.where("type in ('S', 'N')").select(end.alias("end")), n.withColumn("aliases", F.lit(None).cast("array<string>")))


# ---- names and edges

@query(f"""WITH k AS (SELECT p_name AS name, 'ENTITY_' || upper(replace(p_name, ' ', '_')) AS node, min(p_partkey) AS pos FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
m AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' WHEN 3 THEN split_part(p_name, ' ', 2) || ' the ' || split_part(p_name, ' ', 1) ELSE 'Unseen ' || p_partkey END AS mention FROM part),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(lower(mention), ' '), lambda x: x <> 'the'))) AS ws FROM m), kw AS (SELECT *, list_sort(list_distinct(string_split(lower(name), ' '))) AS ws FROM k),
c AS (SELECT mention, node, name, -1 AS pos FROM w JOIN kw ON node = 'ENTITY_' || upper(replace(mention, ' ', '_'))
  UNION ALL SELECT mention, node, name, pos FROM w JOIN kw ON lower(mention) = lower(name) OR {K._SIM.format(a='mention', b='name')} >= 0.88 OR w.ws = kw.ws),
b AS (SELECT mention, arg_min(node, pos) AS node, arg_min(name, pos) AS name FROM c GROUP BY mention)
SELECT mention, coalesce(node, 'ENTITY_' || upper(replace(mention, ' ', '_'))) AS node, coalesce(name, mention) AS name FROM m LEFT JOIN b USING (mention)""")
def entity_tiers(spark, d):
    """Mentions of parts against the nodes of every second one: by id, by name, by likeness, by the same words, or new."""
    part, name, key = S.table(spark, d, "part"), F.col("p_name"), F.col("p_partkey")
    known = part.where("p_partkey % 2 = 0").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("at")).withColumns({"node": T.canonical_id(F.col("name")), "aliases": F.array("name")})
    word = lambda n: F.split_part(name, F.lit(" "), F.lit(n))
    forms = [name, F.upper(name), F.concat(name, F.lit("s")), F.concat(word(2), F.lit(" the "), word(1)), F.concat(F.lit("Unseen "), key.cast("string"))]
    return resolve.entity_of(part.select(F.element_at(F.array(*forms), (key % 5 + 1).cast("int")).alias("mention")), known)


@query("""WITH n AS (SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT AS v, o_orderkey % 4 AS k FROM orders),
x AS (SELECT *, lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS s FROM n)
SELECT 'c' || o_orderkey AS chunk_id, CASE WHEN k = 1 THEN 'ENTITY_KEYFRAME_' || o_orderkey ELSE 'ENTITY_O_' || o_orderkey END AS source, CASE k WHEN 0 THEN 'HAS_BUDGET' WHEN 2 THEN 'OPEN_TO_STUDENTS_OF' WHEN 3 THEN 'OFFERED_BY' ELSE 'SHOWS' END AS relation,
CASE k WHEN 0 THEN s || ':10 - ' || s || ':20' WHEN 1 THEN s || ':30' ELSE '09:09' END AS timestamp, CASE k WHEN 0 THEN s || ':10' WHEN 1 THEN s || ':30' ELSE '09:09' END AS start_timestamp, CASE WHEN k = 0 THEN s || ':20' END AS end_timestamp,
CASE WHEN k = 1 THEN 'Frame ' || o_orderkey END AS frame_id, CASE WHEN k = 1 THEN 'top-left' END AS spatial_location, CASE WHEN k = 0 AND v >= 1000 THEN v::DOUBLE END AS amount, CASE WHEN k = 0 AND v >= 1000 THEN 'EUR' END AS currency FROM x""")
def edge_assembly(spark, d):
    """Edges of triples whose evidence has a stamp and an amount, a frame and a region, words of eligibility, or nothing."""
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    s = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    said = F.when(k == 0, F.concat(F.lit("["), s, F.lit(":10 - "), s, F.lit(":20] gets "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" EUR"))).when(k == 1, F.concat(F.lit("["), s, F.lit(":30] at the Top-Left"))).when(k == 2, F.lit("open to all")).otherwise("")
    relation = F.when(k == 0, "HAS_BUDGET").when(k == 1, "SHOWS").otherwise("OFFERED_BY")
    source = F.concat(F.when(k == 1, "ENTITY_KEYFRAME_").otherwise("ENTITY_O_"), key)
    rows = S.table(spark, d, "orders").select(
        source.alias("source_id"), F.concat(F.when(k == 1, "Frame ").otherwise("Order "), key).alias("source_name"), F.lit("ENTITY_C").alias("target_id"), F.lit("Customer").alias("target_name"), relation.alias("relation"), said.alias("evidence"),
        F.lit("f").alias("file_id"), F.lit("f.txt").alias("filename"), F.concat(F.lit("c"), key).alias("chunk_id"), F.lit(1).alias("page_number"), F.lit("09:09").alias("timestamp"),
    )
    return extract.edges_of(rows).select("chunk_id", "source", "relation", "timestamp", "start_timestamp", "end_timestamp", "frame_id", "spatial_location", "amount", "currency")


@query("""WITH n AS (SELECT p_partkey AS chunk_id, upper(left(a, 1)) || a[2:] || ' ' || upper(left(b, 1)) || b[2:] AS name FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))
SELECT chunk_id, name AS source, 'INTEGRATES_WITH' AS relation, 'Gear ' || chunk_id AS target FROM n WHERE chunk_id % 3 = 0
UNION ALL SELECT chunk_id, 'Deadweight', 'IS', 'Loss' FROM n WHERE chunk_id % 3 = 0 UNION ALL SELECT chunk_id, 'A Model', 'TOLD', 'This Triple' FROM n WHERE chunk_id % 3 = 1""")
def triples_by_chunk(spark, d):
    """Chunks of which a third has rules' triples and a template's, a third a model's, and a third too little text."""
    key = F.col("p_partkey")
    gear = F.concat("p_name", F.lit(" uses Gear "), key.cast("string"), F.lit(". A deadweight loss here"))
    rows = S.table(spark, d, "part").select(key.alias("chunk_id"), F.when(key % 3 == 2, "too short").otherwise(F.concat(F.lit("Here is a factual summary of the image content: "), gear)).alias("text"))
    templates = spark.createDataFrame([("deadweight loss", "Deadweight", "IS", "Loss", "CONCEPT", "CONCEPT"), ("deadweight gain", "Deadweight", "IS", "Gain", "CONCEPT", "CONCEPT")], "trigger string, source string, relation string, target string, source_type string, target_type string")
    told = rows.where("chunk_id % 3 = 1").select("chunk_id", F.lit("A Model").alias("source"), F.lit("TOLD").alias("relation"), F.lit("This Triple").alias("target"), F.lit("CONCEPT").alias("source_type"), F.lit("CONCEPT").alias("target_type"), F.lit("said").alias("evidence"), F.lit(0.9).alias("confidence"))
    return extract.triples_of(rows, templates, told).select("chunk_id", "source", "relation", "target")


@query("""WITH n AS (SELECT DISTINCT n_regionkey, n_name AS name FROM nation UNION SELECT DISTINCT n_regionkey, left(n_name, 3) FROM nation)
SELECT n_regionkey, string_agg(name, ', ' ORDER BY length(name) <= 3, name) AS names FROM n GROUP BY n_regionkey""")
def names_in_order(spark, d):
    """The names of each region's nations and their short forms: names of up to three characters last."""
    rows = S.table(spark, d, "nation").select("n_regionkey", F.explode(F.array("n_name", F.left("n_name", F.lit(3)))).alias("name")).distinct()
    return rows.groupBy("n_regionkey").agg(resolve.ordered_names(F.collect_list("name")).alias("names"))


# ---- ingest

@query(f"""WITH RECURSIVE b AS (SELECT doc_id, source, text, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' END AS kind FROM documents WHERE doc_id % 5 <> 4),
x AS (SELECT *, CASE kind WHEN 'text' THEN coalesce(text, '') WHEN 'image' THEN '[Image File - doc_' || doc_id || '.png]: Resolution 640x480px.' WHEN 'audio' THEN CASE WHEN trim(coalesce(text, ''), ' ' || chr(10)) = '' THEN '[Audio Transcript - doc_' || doc_id || '.mp3]:' || chr(10) || '(No audible speech detected in audio file)' ELSE '[Audio Transcript - doc_' || doc_id || '.mp3 (Language: en, Duration: 75s)]:' || chr(10) || '[00:05 - 01:15] ' || trim(text, ' ') END END AS said FROM b)
SELECT doc_id AS file_id, CASE WHEN kind = 'video' THEN 'failed' ELSE 'done' END AS status, CASE WHEN kind = 'video' THEN 'Extraction failed: no extractor for video' END AS extraction_error, md5(said) AS extracted FROM x""")
def ingest_files(spark, d):
    """Files of several kinds taken in: texts, images of which only the size is known, recordings of one segment, videos without an
    extractor; files with a suffix that is not allowed stay out."""
    return _ingested(spark, d)[0].select("file_id", "status", "extraction_error", F.md5(F.col("extracted_text").cast("binary")).alias("extracted"))


def _ingested(spark, d):
    files = S.files(spark, d).withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).select("file_id", "conversation_id", "filename", "file_type", "file_size_bytes", "content")
    none = F.lit(None).cast("string")
    said = F.col("content").cast("string")
    image = lambda r: r.select("file_id", ingest.image_text(F.col("filename"), none, none, F.lit(640), F.lit(480)).alias("text"), none.alias("error"))

    def audio(rows):
        segments = rows.select("file_id", F.lit(5).alias("start"), F.lit(75).alias("end"), F.regexp_replace(said, r"^[ \n]+$", "").alias("text"))
        return ingest.transcripts(rows.select("file_id", "filename", F.lit("en").alias("language"), F.lit(75.4).alias("seconds")), segments).withColumn("error", none)

    return ingest.ingested(files, {"text": ingest.plain_texts, "image": image, "audio": audio}, shared_dir(spark, "lexicon"))


@query("SELECT source AS conversation_id, count(*) AS n FROM documents WHERE doc_id % 5 IN (1, 2) OR doc_id % 5 = 0 AND trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY source")
def ingest_indexed(spark, d):
    """The files of each conversation that the ingest flow's index holds."""
    _, parts, stored = _ingested(spark, d)
    own = stored.opened()
    held = own.stats.select("chunk_id").distinct()
    return parts.join(held, "chunk_id", "left_semi").groupBy("conversation_id").agg(F.countDistinct("file_id").alias("n"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k, text, CASE WHEN trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN 1 ELSE 0 END AS full_ FROM documents)
SELECT doc_id AS file_id, CASE k WHEN 2 THEN 'failed' WHEN 3 THEN 'retry' ELSE 'done' END AS status, CASE k WHEN 2 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS attempts, k < 2 AND full_ = 1 AS searchable, k < 2 AND full_ = 1 AS has_vector FROM d""")
def ingest_status(spark, d):
    """Two uploads of the documents: a fourth is done at once, one at the second try, one fails twice, one came late and failed once.

    The text is told as the file's content; a picture has no extractor here and fails.
    """
    base = shared_dir(spark, "flow")
    k, docs = F.col("doc_id") % 4, S.table(spark, d, "documents")
    kind = lambda broken: F.when(broken, "image").otherwise("document")
    rows = lambda broken: docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("conversation_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), kind(broken).alias("file_type"), F.col("text").cast("binary").alias("content"), k.alias("k"))
    for part in (rows(k > 0).where("k < 3"), rows(k > 1).where("k > 0")):
        part.drop("k").write.mode("append").parquet(f"{base}/in")
        flow.ingest_files(spark, f"{base}/in", f"{base}/store", f"{base}/at", {"text": ingest.plain_texts}).awaitTermination()
    store = flow.opened(spark, f"{base}/store")
    held = store.lexicon().docs().select("chunk_id")
    found = store.chunks().join(held, "chunk_id", "left_semi").select("file_id").distinct().withColumn("searchable", F.lit(True))
    dense = store.chunks().join(store.vectors().select("chunk_id"), "chunk_id", "left_semi").select("file_id").distinct().withColumn("has_vector", F.lit(True))
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return store.status().join(found, "file_id", "left").join(dense, "file_id", "left").select("file_id", "status", "attempts", false("searchable"), false("has_vector"))


@query(r"""WITH k AS (SELECT event_id, event_id % 4 AS k, event_type AS t FROM events)
SELECT event_id, CASE k WHEN 0 THEN '[Image OCR Text - a.png]:' || chr(10) || repeat(t, 9) WHEN 1 THEN '[Detected Text Fragments]:' || chr(10) || t || chr(10) || chr(10) || '[Visual Description - a.png]:' || chr(10) || 'seen' WHEN 2 THEN '[Image OCR Text - a.png]:' || chr(10) || t ELSE '[Image File - a.png]: Image data recorded.' END AS text,
'[00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || ' - 02:00 (Speech)]: ' || t AS line FROM k""")
def media_texts(spark, d):
    """Images with enough recognised text, with little and a caption, with little alone, and with neither; and a line of speech."""
    k, t = F.col("event_id") % 4, F.col("event_type")
    ocr = F.when(k == 0, F.repeat(t, F.lit(9))).when(k < 3, t)
    size = F.lit(None).cast("int")
    return S.table(spark, d, "events").select("event_id", ingest.image_text(F.lit("a.png"), ocr, F.when(k == 1, "seen"), size, size).alias("text"), ingest.speech_line(F.col("event_id") % 60, F.lit(120), t, video=True).alias("line"))


@query("SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) <= 1000 THEN md5(text) END AS whole, least(strlen(text), 1000) - 3 <= strlen(text) AS fits FROM documents WHERE text IS NOT NULL")
def capped_bytes(spark, d):
    """Texts cut at 1,000 bytes: shorter ones are whole, and no longer one has more than two bytes over, of a replaced character."""
    cut = ingest.capped(F.col("text"), 1000)
    rows = S.table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.octet_length("text") <= 1000, F.md5(cut.cast("binary"))).alias("whole"), F.octet_length(cut).between(F.least(F.octet_length("text"), F.lit(1000)) - 3, F.lit(1002)).alias("fits"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') ELSE NULL END AS pages FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY doc_id HAVING count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') > 0""")
def chunk_dispatch(spark, d):
    """Every second text has page tags, a page a line, and is chunked by pages; the others by blocks."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), x))
    rows = S.texts(spark, d).withColumn("text", F.when(F.col("file_id") % 2 == 0, F.array_join(lines, "\n\n")).otherwise(F.regexp_replace("text", r"\[Page ", "[")))
    found = chunk.chunked(rows)
    return found.groupBy("file_id").agg(F.nullif(F.countDistinct("page_number"), F.lit(0)).alias("pages"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
SELECT doc_id AS file_id, 0 AS window_no, '00:01 - 00:02 (Speech)' AS timestamp FROM l""")
def graph_windows_stamps(spark, d):
    """The first window of each text, its lines stamped as speech."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("[00:"), F.lpad((i % 50 + 1).cast("string"), 2, "0"), F.lit(" - 00:"), F.lpad((i % 50 + 2).cast("string"), 2, "0"), F.lit(" (Speech)]: "), x))
    found = chunk.windows(S.texts(spark, d).withColumn("text", F.array_join(lines, "\n")), r"(?=\[\d{1,2}:\d{2})", 3000, 15, "\n")
    return found.where("window_no = 0").select("file_id", "window_no", "timestamp")


# ---- sessions

@query("""WITH c AS (SELECT conv_id % 7 AS user_id, conv_id, CASE WHEN conv_id % 5 <> 0 THEN max(length(text)) END AS updated_at FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, conv_id) AS position FROM c)
SELECT user_id, conv_id, CAST(position AS INT) AS position FROM r WHERE position <= 10""")
def list_conversations(spark, d):
    """The ten newest conversations of each user; those without a time last."""
    rows = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.length("text")).alias("n"))
    rows = rows.select((F.col("conv_id") % 7).alias("user_id"), "conv_id", F.when(F.col("conv_id") % 5 != 0, F.col("n")).alias("updated_at"))
    return session.listed_first(rows, "user_id", "updated_at", 10, "conv_id").select("user_id", "conv_id", "position")


@query("SELECT doc_id AS file_id, source AS conversation_id, n_chars AS file_size_bytes FROM documents WHERE doc_id = 7")
def get_file(spark, d):
    return S.files(spark, d).where("file_id = 7").limit(1).select("file_id", "conversation_id", "file_size_bytes")


@query("SELECT conv_id::VARCHAR AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'New ' || conv_id ELSE 'Old ' || conv_id END AS title FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'made', 'Made'")
def rename_conversations(spark, d):
    """Every third conversation gets a new title, and one that was not there is made."""
    ids = S.messages(spark, d).select("conversation_id").distinct()
    new = ids.where("cast(conversation_id as long) % 3 = 0").select("conversation_id", F.concat(F.lit("New "), "conversation_id").alias("title"))
    made = spark.createDataFrame([("made", "Made")], "conversation_id string, title string")
    return session.renamed(ids.withColumn("title", F.concat(F.lit("Old "), "conversation_id")), new.unionByName(made))


@query("SELECT conv_id::VARCHAR AS conversation_id, count(*) AS n, greatest(3, max(turn) FILTER (turn % 2 = 1)) AS updated_at FROM conversations GROUP BY conv_id")
def message_save(spark, d):
    """Odd turns come again, later; a conversation's time moves with its newest message and never back."""
    rows = S.messages(spark, d).select("conversation_id", F.concat_ws("/", "conversation_id", "turn").alias("message_id"), F.col("turn").alias("created_at"))
    conversations = rows.select("conversation_id").distinct().withColumn("updated_at", F.lit(3).cast("long"))
    messages, bumped = session.saved_messages(rows, rows.where("created_at % 2 = 1"), conversations)
    return messages.groupBy("conversation_id").agg(F.count("*").alias("n")).join(bumped, "conversation_id")


@query("SELECT source AS conversation_id, count(*) FILTER (quality = 0) AS n_failed, bool_or(quality IS NULL AND NOT coalesce(length(text) > 0, false)) AS any_active FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def file_progress(spark, d):
    return session.progress(session.with_status(S.files(spark, d)))


@query("SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'copy ' || doc_id WHEN doc_id % 3 = 1 THEN 'named ' || doc_id ELSE doc_id::VARCHAR END AS file_id FROM documents")
def clone_remap_files(spark, d):
    """Rows of copied files: a third is found by id, a third by name, a third stays."""
    rows = S.files(spark, d).select(F.col("file_id").alias("row_id"), F.col("file_id").cast("string").alias("file_id"), F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("filename"))
    by_id = rows.where("row_id % 3 = 0").select("file_id", F.concat(F.lit("copy "), "file_id").alias("new_id"))
    by_name = rows.where("row_id % 3 = 1").select("filename", F.concat(F.lit("named "), "file_id").alias("new_id"))
    return session.remapped(rows, by_id, by_name).select("row_id", "file_id")


@query(f"WITH {O.FUSED} SELECT query_id, file_type, count(*) AS n FROM fused GROUP BY ALL")
def returned_by_type(spark, d):
    """How many of a query's chunks are of each modality."""
    return C.hybrid_retrieve(spark, d).groupBy("query_id", "file_type").agg(F.count("*").alias("n"))


# ---- answers

_GREET = r"'^(hi|hello|hey|greetings|howdy|sup|yo|hi\s+there|hello\s+there)\b|^(good\s+(morning|afternoon|evening|day|night))\b|^(how\s+are\s+you|how\s+are\s+you\s+doing|how''s\s+it\s+going|hows\s+it\s+going|what''s\s+up|whats\s+up)\b|^(who\s+are\s+you|what\s+is\s+your\s+name|what\s+can\s+you\s+do|introduce\s+yourself|help\s+me)\b|^(thanks|thank\s+you|thank\s+you\s+very\s+much|thanks\s+a\s+lot|bye|goodbye|see\s+you)\b'"
_FILES = r"'\b(pdf|docx?|txt|markdown|document|documents|file|files|upload|uploaded|schematic|diagram|blueprint)\b|\b(video|audio|recording|transcript|presentation|keyframe|slide|slides|page\s+\d+|table\s+\d+)\b|\b(in\s+the\s+file|in\s+the\s+document|in\s+the\s+pdf|from\s+the\s+data|according\s+to\s+the|based\s+on\s+the\s+file)\b'"
_ASKED = "SELECT conv_id * 100 + turn AS query_id, conv_id % 3 AS c, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'Hello there, friend' WHEN 2 THEN 'what does report' || (conv_id % 3) || '.x say' ELSE 'hi ' || text END AS query FROM conversations"


@query(rf"""WITH a AS (SELECT *, lower(trim(query)) AS q FROM ({_ASKED})), f AS (SELECT *, regexp_matches(q, {_GREET}) AS greet, regexp_matches(q, {_FILES}) AS files, contains(q, 'report' || c || '.x') AS named FROM a),
i AS (SELECT *, CASE WHEN greet AND NOT files THEN 'CASUAL' WHEN files OR named THEN 'CORPUS_QUERY' ELSE 'GENERAL_KNOWLEDGE' END AS intent FROM f)
SELECT query_id, intent, CASE WHEN intent = 'CORPUS_QUERY' THEN 'first' || c || '.x' END AS target_filename, (greet AND {O.n_words('query')} <= 6) OR intent <> 'CORPUS_QUERY' AS conversational FROM i""")
def intent_in_session(spark, d):
    """Turns as they are, greetings, questions that name a file of the session, and greetings with a turn behind."""
    rows = S.table(spark, d, "conversations")
    c = (F.col("conv_id") % 3).cast("string")
    k = F.col("turn") % 4
    said = F.when(k == 0, F.col("text")).when(k == 1, "Hello there, friend").when(k == 2, F.concat(F.lit("what does report"), c, F.lit(".x say"))).otherwise(F.concat(F.lit("hi "), "text"))
    queries = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), c.alias("conversation_id"), said.alias("query"))
    files = spark.createDataFrame([(str(i), name.format(i), at) for i in range(3) for at, name in enumerate(("first{}.x", "report{}.x", "n.x"))], "conversation_id string, filename string, at int")
    return synthesis.intent_in_session(queries, files)


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(q)), {_GREET}) AND {O.n_words('q')} <= 6 AND turn <= 1 THEN 'greeted' WHEN turn % 3 = 0 THEN 'told' ELSE 'fixed' END AS answer FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Hi there!' ELSE text END AS q FROM conversations)""")
def small_talk_answer(spark, d):
    query_ = F.when(F.col("turn") % 2 == 0, "Hi there!").otherwise(F.col("text"))
    said = synthesis.conversational_answer(query_, F.col("turn"), F.when(F.col("turn") % 3 == 0, " told ").otherwise(" "), "fixed")
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.when(said == synthesis.GREETED, "greeted").otherwise(said).alias("answer"))


@query("""WITH k AS (SELECT *, CASE WHEN length(o_custkey::VARCHAR) >= 4 AND contains(o_orderkey::VARCHAR, o_custkey::VARCHAR) THEN 2 ELSE 1 END AS at_place FROM orders)
SELECT o_orderkey AS answer_id, 'customer ' || o_custkey AS entity, at_place AS place FROM k UNION ALL SELECT o_orderkey, 'order ' || o_orderkey, 3 - at_place FROM k""")
def hop_entities(spark, d):
    """A customer whom only the query names comes before the order that the answer names and the graph has; where the order's digits
    hold those of the customer, four at least, the answer names both and the graph's entity comes first."""
    o, c = F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    rows = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), o.alias("o"), c.alias("c"))
    hops = rows.select("answer_id", F.lit(1).alias("seq"), F.col("c").alias("from_node"), F.col("o").alias("to_node"))
    texts = rows.select("answer_id", F.concat(F.lit("who is "), "c").alias("query"), F.concat(F.lit("The one: "), "o", F.lit(".")).alias("answer"))
    return synthesis.relevant_entities(hops, texts, rows.select("answer_id", F.col("o").alias("entity"), F.lit(1).alias("at")))


@query("SELECT doc_id AS answer_id, n AS occurrence, n AS claim_no FROM documents, range(3) AS t(n)")
def cited_claims(spark, d):
    """Three markers of one passage: two share words with their own claims, and the last shares none and takes its place's."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"))
    said = ["alpha beta", "gamma delta", "no like"]
    told = ["Beta and alpha!", "Delta, then gamma.", "epsilon"]
    row = lambda i, c: F.struct(F.lit(i).cast("long").alias("n"), F.lit(c).alias("x"))
    markers = docs.select("answer_id", F.explode(F.array(*[row(i, x) for i, x in enumerate(said)])).alias("m")).select("answer_id", F.col("m.n").alias("occurrence"), F.lit(1).alias("passage_number"), F.col("m.x").alias("said"))
    checked = docs.select("answer_id", F.explode(F.array(*[row(i, x) for i, x in enumerate(told)])).alias("m")).select("answer_id", F.col("m.n").alias("claim_no"), F.lit(1).alias("passage_number"), F.col("m.x").alias("claim"))
    return answer.cited(markers, checked).select("answer_id", "occurrence", "claim_no")


@query("SELECT p_partkey, '(' || p_size || ' / 2) ≤ ' || p_name || ' × $' || p_size AS plain, left('(' || p_size || ' / 2) ≤ ' || p_name, 12) || '...' AS short FROM part")
def math_text(spark, d):
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("$$\\frac{"), n, F.lit("}{2} \\le \\text{"), "p_name", F.lit("} \\times \\$"), n, F.lit("$$"))
    plain = answer.plain_math(raw)
    return S.table(spark, d, "part").select("p_partkey", plain.alias("plain"), answer.preview(plain, 12).alias("short"))


@query("""WITH e AS (SELECT source, count(*) FILTER (doc_id % 2 = 0) AS held, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 5 <> 4) AS more FROM documents GROUP BY source),
k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unsupported extension' WHEN held + more > 45 THEN 'too many files' END AS error FROM documents JOIN e USING (source) WHERE doc_id % 2 = 1)
SELECT doc_id AS file_id, CASE WHEN error IS NULL THEN 'pending' ELSE 'rejected' END AS status, error FROM k""")
def upload_files(spark, d):
    """Files with odd numbers come to conversations that hold those with even ones."""
    files = S.files(spark, d)
    return session.uploaded(files.where("file_id % 2 = 1"), files.where("file_id % 2 = 0"), 45).select("file_id", "status", "error")


@query("SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS extracted_text, CASE WHEN doc_id % 3 = 1 THEN 'broken' END AS extraction_error FROM documents")
def file_results(spark, d):
    """A third of the files is done with a new text, a third failed and keeps its text, a third has no result yet."""
    files = S.files(spark, d).select("file_id", F.lit("pending").alias("status"), F.lit("old").alias("extracted_text"), F.lit(None).cast("string").alias("extraction_error"))
    k = F.col("file_id") % 3
    results = files.where(k < 2).select("file_id", F.when(k == 0, "done").otherwise("failed").alias("status"), F.when(k == 0, "new").alias("extracted_text"), F.when(k == 1, "broken").alias("extraction_error"))
    return session.with_results(files, results)


@query(f"WITH {O.INDEX}, s AS (SELECT chunk_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY ALL), i AS (SELECT conversation_id, round(sum(idf), 4) AS all_idf, CAST(sum(df) AS BIGINT) AS all_df FROM idf GROUP BY ALL) SELECT conversation_id, chunk_id, dl, round(avgdl, 6) AS avgdl, coalesce(n_terms, 0) AS n_terms, coalesce(tf, 0) AS tf, all_idf, all_df FROM stats JOIN corpus USING (conversation_id) LEFT JOIN s USING (chunk_id) LEFT JOIN i USING (conversation_id)")
def index_rebuilt(spark, d):
    """An index of half of the chunks, after all conversations were indexed anew, opened by its path: lengths, averages, postings and sums."""
    rows, path = S.chunks(spark, d), shared_dir(spark, "lexicon")
    segments.recast(segments.created(rows.where("chunk_id % 2 = 0"), path), rows)
    own = segments.opened(spark, path).opened()
    post = own.postings.groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tf"))
    sums = own.idf.groupBy("conversation_id").agg(F.round(F.sum("idf"), 4).alias("all_idf"), F.sum("df").alias("all_df"))
    rows = own.stats.join(own.corpus, "conversation_id").join(post, "chunk_id", "left").join(sums, "conversation_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("conversation_id", "chunk_id", "dl", F.round("avgdl", 6).alias("avgdl"), none("n_terms"), none("tf"), "all_idf", "all_df")


@query("SELECT o_custkey AS query_id, min(o_orderkey) AS hop_no, o_orderstatus AS relation FROM orders GROUP BY o_custkey, o_orderstatus")
def hops_once(spark, d):
    """Orders of a customer as hops that differ in case only: the first of each status stays."""
    o = S.table(spark, d, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    same = lambda c: F.when(odd, F.upper(c)).otherwise(c)
    hops = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("hop_no"), same(F.lit("from")).alias("source"), F.when(odd, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("relation"), same(F.lit("to")).alias("target"))
    return answer.told_once(hops).select("query_id", "hop_no", F.upper("relation").alias("relation"))
