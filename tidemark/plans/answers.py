"""Queries of answering end to end, of the texts around answers, of index upkeep and of streaming ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import answer, graph, index, resolve, retrieve
from tidemark.sources import tables as S
from tidemark.streaming import ingest

from . import catalogue as C, oracle as O
from .lineage import shared_dir, written
from .registry import query

_STAMPED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '[' || a || '] ' || event_type WHEN 2 THEN '[' || a || ' - ' || b || '] ' || event_type || ' [' || b || ' - ' || c || '] end' ELSE '[' || a || '] x [' || c || ']' END AS said,
CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '00:00' ELSE b END AS fallback FROM (SELECT event_id, event_type, lpad((event_id % 60)::VARCHAR, 2, '0') || ':10' AS a, lpad((event_id % 60)::VARCHAR, 2, '0') || ':20' AS b, lpad((event_id % 60)::VARCHAR, 2, '0') || ':45' AS c FROM events)"""


def _said(spark, d):
    at = lambda s: F.concat(F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(s))
    a, b, c, kind, k = at(":10"), at(":20"), at(":45"), F.col("event_type"), F.col("event_id") % 4
    said = F.when(k == 0, kind).when(k == 1, F.concat(F.lit("["), a, F.lit("] "), kind))
    said = said.when(k == 2, F.concat(F.lit("["), a, F.lit(" - "), b, F.lit("] "), kind, F.lit(" ["), b, F.lit(" - "), c, F.lit("] end"))).otherwise(F.concat(F.lit("["), a, F.lit("] x ["), c, F.lit("]")))
    third = F.col("event_id") % 3
    return S.table(spark, d, "events").select("event_id", said.alias("said"), F.when(third == 0, "").when(third == 1, "00:00").otherwise(b).alias("fallback"))


@query(rf"""WITH s AS ({_STAMPED}), m AS (SELECT *, regexp_extract_all(said, '\[(\d{{1,2}}:\d{{2}}(?:\s*-\s*\d{{1,2}}:\d{{2}})?)\]', 1) AS st FROM s),
e AS (SELECT *, CASE len(st) WHEN 0 THEN NULL WHEN 1 THEN st[1] ELSE trim(string_split(st[1], '-')[1]) || ' - ' || trim(string_split(st[-1], '-')[-1]) END AS span FROM m)
SELECT event_id, span, coalesce(span, nullif(fallback, '')) AS stamp FROM e""")
def evidence_span(spark, d):
    return _said(spark, d).select("event_id", T.evidence_span(F.col("said")).alias("span"), answer.effective_stamp(F.col("said"), F.col("fallback")).alias("stamp"))


@query("""SELECT doc_id, CASE WHEN strpos(text, ' the ') > 0 THEN '... ' || trim(substr(text, greatest(0, strpos(text, ' the ') - 81) + 1, strpos(text, ' the ') - 1 + 400 - greatest(0, strpos(text, ' the ') - 81)), ' ' || chr(9) || chr(10) || chr(13)) || ' ...' END AS excerpt FROM documents""")
def stamp_excerpt(spark, d):
    return S.table(spark, d, "documents").select("doc_id", answer.stamp_excerpt(F.col("text"), F.lit(" the ")).alias("excerpt"))


@query("""SELECT p_partkey, (['pdf','image','audio','video','document','document'])[p_partkey % 6 + 1] AS file_type FROM part""")
def viewer_type(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".jpeg", ".flac", ".avi", ".md", ".bin")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return S.table(spark, d, "part").select("p_partkey", answer.viewed_as(F.concat("p_name", ends)).alias("file_type"))


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


_MARKS = [(r"(?i)\*\(note:[^)]*\)\*", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_{1,2}([^_]+)_{1,2}", r"\1"), (r"#{1,6}\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\s{2,}", " ")]


@query(f"SELECT doc_id, md5(trim({_replaced(chr(39) + '## T **b** [x](y) ' + chr(39) + ' || text', _MARKS)}, ' ' || chr(9) || chr(10) || chr(13))) AS plain FROM documents")
def unmarked_text(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(answer.unmarked(F.concat(F.lit("## T **b** [x](y) "), "text")).cast("binary")).alias("plain"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN event_id::VARCHAR END AS found, event_id % 4 = 3 AS nothing FROM events""")
def json_repair(spark, d):
    """Replies that are whole, fenced, cut off after an object, and no JSON at all: the first id is found in all but the last."""
    k, body = F.col("event_id") % 4, F.concat(F.lit('{"triples": [{"id": '), F.col("event_id").cast("string"), F.lit("}"))
    raw = F.when(k == 0, F.concat(body, F.lit("]}"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(k == 2, F.concat(body, F.lit(', {"id": 7'))).otherwise(F.lit("no json"))
    rows = S.table(spark, d, "events").select("event_id", answer.json_text(raw).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.triples[0].id").alias("found"), (F.col("j") == "{}").alias("nothing"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, trim(coalesce(text, '')) AS t FROM conversations)
SELECT conv_id::VARCHAR AS conversation_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' || t WHEN length(t) > 300 THEN 'Assistant: ' || left(t, 300) || '...' ELSE 'Assistant: ' || t END, chr(10) ORDER BY turn) AS history FROM n WHERE n <= 4 GROUP BY conv_id""")
def history_prompt(spark, d):
    return answer.history_text(S.messages(spark, d))


@query(r"""WITH h AS (SELECT o_custkey AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders)
SELECT query_id, count(*) AS n_hops, md5('### 🕸️ Knowledge Graph Relations (' || count(*) || CASE WHEN count(*) > 1 THEN ' relation hops):' ELSE ' relation hop):' END || chr(10) ||
string_agg('  • Rel ' || n || ': **O:' || o_orderkey || '** (Order) ➔ **PLACED_BY** ➔ **C:' || query_id || '** (Customer)' || chr(10) || '    - Source: [orders | 💰 $' || format('{:,}', amount) || ' USD | 📄 Page ' || (o_orderkey % 9 + 1) || ']' || chr(10) || '    - Evidence: "order"', chr(10) ORDER BY n) FILTER (n <= 15)) AS told FROM h GROUP BY query_id""")
def graph_narrative(spark, d):
    o = S.table(spark, d, "orders")
    hops = o.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("hop_no"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("from_node"), F.lit("Order").alias("from_type"), F.lit("PLACED_BY").alias("relation"),
        F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("to_node"), F.lit("Customer").alias("to_type"), F.lit("orders").alias("filename"), F.lit("order").alias("evidence"), F.floor("o_totalprice").alias("amount"),
        F.lit(None).cast("string").alias("currency"), (F.col("o_orderkey") % 9 + 1).alias("page_number"), F.lit(None).cast("string").alias("timestamp"),
    )
    return answer.narrative(hops).select("query_id", "n_hops", F.md5(F.col("narrative").cast("binary")).alias("told"))


@query(f"WITH {O.BM25} SELECT * FROM sparse WHERE bm25_rank <= 5")
def bm25_topk(spark, d):
    return retrieve.bm25_topk(S.queries(spark, d), index.built(S.chunks(spark, d)), 5)


@query(f"""WITH {O.CHUNKS}, {O.QUERIES}, {O.DENSE}, w AS (SELECT *, min(dense_score) OVER (PARTITION BY query_id) AS low, max(dense_score) OVER (PARTITION BY query_id) AS high FROM dense)
SELECT query_id, chunk_id, round(CASE WHEN high = low THEN CASE WHEN high > 0 THEN 1.0 ELSE 0.0 END ELSE (dense_score - low) / (high - low) END, 6)::DOUBLE AS normalized FROM w""")
def minmax_normalize(spark, d):
    found = C.dense_topk(spark, d)
    return found.select("query_id", "chunk_id", F.round(retrieve.minmax(F.col("dense_score"), Window.partitionBy("query_id")), 6).alias("normalized"))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 <> 2 THEN 'old' ELSE 'new' END AS origin FROM documents WHERE doc_id % 5 <> 0")
def index_add_remove(spark, d):
    """Chunks added where their id is new, then the chunks of every fifth file removed."""
    rows = S.chunks(spark, d).select("chunk_id", F.col("chunk_id").alias("file_id"))
    old, new = rows.where("chunk_id % 3 <> 2").withColumn("origin", F.lit("old")), rows.where("chunk_id % 3 <> 0").withColumn("origin", F.lit("new"))
    gone = rows.where("chunk_id % 5 = 0").select("file_id")
    return index.without_files(index.add_new(old, new), gone).select("chunk_id", "origin")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin, round((CASE WHEN vec_id % 2 = 0 THEN -1 ELSE 1 END) * embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vector_upsert(spark, d):
    own = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    old = own.select("chunk_id", F.lit("old").alias("origin"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    new = own.where("chunk_id % 2 = 0").select("chunk_id", F.lit("new").alias("origin"), (-F.get("embedding", F.lit(0)).cast("double")).alias("v"))
    return index.replaced(old, new).select("chunk_id", "origin", F.round("v", 6).alias("first"))


@query(C.ORACLE_SQL["chunk_blocks"])
def ingest_stream(spark, d):
    """The documents as files in a folder, ingested by the stream; what it wrote equals the batch chunks."""
    base = shared_dir(spark, "ingest")
    rows = S.texts(spark, d).select("file_id", "filename", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows.write.parquet(f"{base}/in")
    ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    body = F.regexp_replace("text", r"^\[[^\n]*\]\n", "")
    return found.select("file_id", "chunk_index", "chunk_id", F.length(body).cast("long").alias("n_chars"), F.size(F.split(body, "\n")).cast("long").alias("n_blocks"), F.md5(body.cast("binary")).alias("body"))


# The answers: the two best excerpts of the three first passages, or what is said without them. Windows of four lines, as above.
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 3)"
_BOUNDARY = r"(?:[.?!] |\.\n|\n\n|\n[-*] )"
_ANSWERED = rf"""low AS (SELECT query_id, conversation_id, query, coalesce(should_retry, true) AS retry, coalesce(missing, '') AS missing FROM q LEFT JOIN (SELECT query_id, should_retry, missing FROM graded) g USING (query_id)),
q2 AS (SELECT query_id, conversation_id, trim(regexp_replace(query, '[^\w\s./-]', '', 'g') || ' ' || missing) AS query FROM low WHERE retry),
{O.again(O.FUSED)},
pass AS (SELECT query_id, position, final_score, file_type, text FROM fused JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id) WHERE query_id NOT IN (SELECT query_id FROM fused2) UNION ALL SELECT query_id, position, final_score2, file_type, text FROM (SELECT query_id, position, final_score AS final_score2, file_type, chunk_id FROM fused2) JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id)),
{C._graded_sql('pass', '3')},
best AS (SELECT query_id, position, list_distinct({O.tokens('query', True)}) AS asked, {_LINES} AS lines FROM pass JOIN q USING (query_id) WHERE position <= 3),
win AS (SELECT query_id, position, i, lines, len(list_intersect(asked, {O.tokens("array_to_string(lines[i:i + 3], ' ')", True)})) AS score FROM best, unnest(range(1, len(lines) + 1)) AS t(i)),
part AS (SELECT query_id, position, CASE WHEN max(score) > 0 THEN array_to_string(any_value(lines)[arg_max(i, score * 100000 - i):arg_max(i, score * 100000 - i) + 3], chr(10)) ELSE any_value(lines)[1] END || ' [' || position || ']' AS part FROM win GROUP BY query_id, position),
parts AS (SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY position) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM part) WHERE n <= 2 GROUP BY query_id),
seen AS (SELECT query_id, list_distinct(flatten(list({O.tokens('text', True)}))) AS seen FROM pass WHERE position <= 3 GROUP BY query_id),
lack AS (SELECT query_id, asked, seen, excerpts, list_filter(asked, lambda w: NOT list_contains(coalesce(seen, []), w)) AS missing FROM (SELECT query_id, list_filter(every, lambda w, i: list_position(every, w) = i) AS asked FROM (SELECT query_id, {O.tokens('query', True)} AS every FROM q)) LEFT JOIN seen USING (query_id) LEFT JOIN parts USING (query_id)),
lacks AS (SELECT *, list_filter(missing, lambda w: NOT list_contains({C._INQUIRY}, w) AND length(w) > 2) AS named FROM lack),
told AS (SELECT query_id AS answer_id, CASE WHEN seen IS NULL THEN 'Based on the provided documents, there is insufficient evidence to answer this question as no relevant source materials were found.'
  WHEN len(asked) > 0 AND 1 - len(missing) / greatest(len(asked), 1) < 0.2 THEN 'Based on the provided documents, there is insufficient evidence to answer this question as the source materials do not contain information on this topic.'
  WHEN len(named) > 0 THEN 'The provided documentation does not explicitly state what happens regarding ' || array_to_string(list_transform(named[1:2], lambda w: chr(39) || w || chr(39)), ', ') || '. While related behavior is documented below, the exact interaction is not defined in the source materials:' || chr(10) || chr(10) || coalesce(excerpts, '')
  ELSE coalesce(excerpts, '') END AS answer FROM lacks),
gap AS (SELECT answer_id, string_split_regex(answer, '\[\d+\]') AS gaps, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::INT) AS marks FROM told),
mark AS (SELECT answer_id, i - 1 AS claim_no, marks[i] AS passage_number, regexp_replace(gaps[i], '\s+$', '') AS own FROM gap, unnest(range(1, len(marks) + 1)) AS t(i)),
said AS (SELECT answer_id, claim_no, passage_number, trim(trim(regexp_replace(trim(CASE WHEN regexp_matches(own, '{_BOUNDARY}') THEN regexp_replace(own, '(?s)^.*{_BOUNDARY}', '') ELSE right(regexp_replace(own, '^\s+', ''), 200) END, ' ' || chr(9) || chr(10) || chr(13)), '^(?:[-*•]|\d+\.)\s+', ''), ' '), '"' || chr(39)) AS claim FROM mark),
claimed AS (SELECT answer_id, claim_no, passage_number, text, claim FROM said LEFT JOIN pass ON query_id = answer_id AND position = passage_number),
{O.checked('claimed')},
done AS (SELECT q.query_id, q.query_id IN (SELECT query_id FROM fused2) AS retried, answer, coalesce(n_claims, 0) AS n_claims, coalesce(groundedness, 1.0) AS groundedness,
  CASE WHEN coalesce(groundedness, 1.0) >= 0.75 AND coalesce(n_claims, 0) > 0 THEN 'high' WHEN coalesce(groundedness, 1.0) >= 0.4 THEN 'medium' ELSE coalesce(graded3.confidence, 'low') END AS confidence
  FROM q JOIN told ON told.answer_id = q.query_id LEFT JOIN ground ON ground.answer_id = q.query_id LEFT JOIN graded3 ON graded3.query_id = q.query_id)"""


@query(f"WITH {O.FUSED}, {C._GRADED}, {_ANSWERED} SELECT query_id, retried, md5(answer) AS answer, n_claims, groundedness, confidence FROM done")
def synthesize_e2e(spark, d):
    done = answer.synthesized(S.queries(spark, d), C.Search(spark, d).passages, written)
    return done.withColumn("answer", F.md5(F.col("answer").cast("binary")))


@query(f"""WITH {O.FUSED}, {C._GRADED}, {_ANSWERED}, types AS (SELECT query_id, count(*) AS n, list_sort(list_distinct(list(file_type))) AS types FROM fused GROUP BY query_id)
SELECT query_id, unnest([0, 1, 2, 3, 4, 5]) AS seq, unnest(['route', 'retrieve', 'confidence', 'answer', 'verify', 'done']) AS event,
unnest([array_to_string(types, ','), n::VARCHAR || '/' || retried, confidence, md5(answer), n_claims::VARCHAR || '/' || round(groundedness * 100)::INT, 'true']) AS data FROM done JOIN types USING (query_id)""")
def stage_log(spark, d):
    """The progress events of every query; what each tells, in short form."""
    q, search = S.queries(spark, d), C.Search(spark, d)
    first = search.passages(q)
    done = answer.synthesized(q, lambda asked: first if asked is q else search.passages(asked), written)
    events = answer.stages(done, first)
    get = lambda k: F.get_json_object("data", f"$.{k}")
    kinds = F.array_join(F.from_json(get("categories"), "array<string>"), ",")
    event = F.col("event")
    told = F.when(event == "route", kinds).when(event == "retrieve", F.concat_ws("/", get("n_passages"), get("retried"))).when(event == "confidence", get("confidence"))
    told = told.when(event == "answer", F.md5(get("answer").cast("binary"))).when(event == "verify", F.concat_ws("/", get("n_claims"), F.round(get("groundedness").cast("double") * 100).cast("int").cast("string"))).otherwise(get("done"))
    return events.select("query_id", "seq", "event", told.alias("data"))


def _level(k: int) -> str:
    """The nodes first reached after k steps, each with its least path."""
    seen = " UNION ALL ".join(f"SELECT node FROM n{j}" for j in range(k))
    return f"n{k} AS (SELECT other AS node, min(list_append(path, other)) AS path FROM n{k - 1} JOIN b USING (node) WHERE other NOT IN ({seen}) GROUP BY other)"


_SEEDS = "SELECT 'C:1' AS node UNION ALL SELECT 'S:1'"


@query(f"""WITH {O.BOTH}, u AS (SELECT min(seq) AS seq, source, relation, target FROM e WHERE source <> target GROUP BY ALL),
n0 AS (SELECT 'C:1' AS node, ['C:1'] AS path), {', '.join(_level(k) for k in range(1, 6))},
p AS (SELECT path FROM ({' UNION ALL '.join(f'SELECT * FROM n{k}' for k in range(6))}) WHERE node = 'S:1'),
h AS (SELECT i AS place, path[i] AS source, path[i + 1] AS target FROM p, unnest(range(1, len(path))) AS t(i)),
f AS (SELECT h.*, min(u.seq) FILTER (u.source = h.source) AS fore, min(u.seq) FILTER (u.source = h.target) AS back FROM h JOIN u ON (u.source = h.source AND u.target = h.target) OR (u.source = h.target AND u.target = h.source) GROUP BY ALL),
own AS (SELECT 'path' AS part, f.place, u.seq, f.source, u.relation, f.target FROM f JOIN u ON u.seq = coalesce(fore, back) AND ((u.source = f.source AND u.target = f.target) OR (u.source = f.target AND u.target = f.source))),
{O.levels(_SEEDS, 3)},
w AS (SELECT seq, source, relation, target, min(depth) AS place FROM (SELECT u.*, depth FROM u JOIN reached ON node = source WHERE depth < 3 UNION ALL SELECT u.*, depth FROM u JOIN reached ON node = target WHERE depth < 3) GROUP BY seq, source, relation, target),
g AS (SELECT * FROM own UNION ALL (SELECT 'search', place, seq, source, relation, target FROM w ORDER BY place, seq, source, target LIMIT 20)),
k AS (SELECT source, relation, target, min(struct_pack(part := part, place := place, seq := seq, s := source, t := target)) AS o FROM g GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY o) AS INT) AS hop_no, source, relation, target, o.part AS part FROM k""")
def traverse(spark, d):
    """From customer 1 to supplier 1: the hops of the shortest path, then of the search around both, each once."""
    e = written(graph.dedup_edges(S.edges(spark, d)))
    return resolve.traversed(e, "C:1", "S:1")
