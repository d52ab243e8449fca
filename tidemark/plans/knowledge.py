"""Queries of triple extraction, entity resolution and graph repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import extract, graph, registry, resolve
from tidemark.sources import tables as S

from . import oracle as O
from .registry import query

_SIM = "(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})))"


# ---- text to triples

@query("""WITH n AS (SELECT p_partkey AS chunk_id, upper(left(a, 1)) || a[2:] || ' ' || upper(left(b, 1)) || b[2:] AS name FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)),
k AS (SELECT *, 'Gear ' || chunk_id AS gear FROM n)
SELECT chunk_id, name AS source, 'INTEGRATES_WITH' AS relation, gear AS target, 'TECH' AS source_type, 'TECH' AS target_type, 0.88::DOUBLE AS confidence FROM k
UNION ALL SELECT chunk_id, gear, 'DEPENDS_ON', name, 'TECH', 'TECH', 0.88 FROM k
UNION ALL SELECT chunk_id, 'Dana Vance', 'EMPLOYED_AT', gear, 'PERSON', 'ORGANIZATION', 0.88 FROM k""")
def pattern_triples(spark, d):
    """Three sentences a part, with a repeat and one that is too short."""
    gear = F.concat(F.lit("Gear "), F.col("p_partkey").cast("string"))
    text = F.concat("p_name", F.lit(" uses "), gear, F.lit(". Short one; the "), gear, F.lit(" relies on the "), "p_name", F.lit("\nDana Vance is the lead engineer at "), gear, F.lit(".\n"), F.upper("p_name"), F.lit(" uses "), gear)
    rows = S.table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"))
    return extract.sentence_triples(rows).drop("evidence")


@query("""WITH k AS (SELECT p_partkey AS chunk_id, 'ABC' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS code, (p_partkey % 5 + 1) || ' Credits' AS credits, p_partkey % 2 = 0 AS again FROM part)
SELECT chunk_id, 'Minor in Dance' AS source, 'OFFERED_BY' AS relation, 'Department of Art' AS target FROM k
UNION ALL SELECT chunk_id, 'Department of Art', 'PART_OF', 'University Curriculum' FROM k
UNION ALL SELECT chunk_id, 'Vance', 'ROLE_AS', 'UG Academic Advisor' FROM k
UNION ALL SELECT chunk_id, 'Department of Art', 'HAS_ADVISOR', 'Vance' FROM k
UNION ALL SELECT chunk_id, 'Vance', 'HAS_EMAIL', 'Vance' || chunk_id || '@X.Org' FROM k
UNION ALL SELECT chunk_id, code, 'AWARDS_CREDITS', credits FROM k
UNION ALL SELECT chunk_id, code, 'OFFERED_IN', 'Spring' FROM k
UNION ALL SELECT chunk_id, code, 'REQUIRES_PREREQUISITE', 'XY100' FROM k WHERE again
UNION ALL SELECT chunk_id, code, 'PART_OF', 'Minor in Dance' FROM k""")
def curriculum_triples(spark, d):
    key = F.col("p_partkey")
    code = F.concat(F.lit("abc"), F.lpad((key % 1000).cast("string"), 3, "0"))
    text = F.concat(F.lit("School of Art\nMinor in Dance\nAdvisor: Vance\nvance"), key.cast("string"), F.lit("@x.org\n"), code, F.lit(" "), (key % 5 + 1).cast("string"), F.when(key % 2 == 0, " XY100 ").otherwise(" None "), F.lit("spring"))
    rows = S.table(spark, d, "part").select(key.alias("chunk_id"), text.alias("text"))
    return extract.curriculum_triples(rows).select("chunk_id", "source", "relation", "target")


@query(r"""WITH t AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]+')) AS trigger FROM benchmark),
w AS (SELECT DISTINCT doc_id AS chunk_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS trigger FROM documents)
SELECT chunk_id, 'Item ' || item_id AS source, 'OPENS_WITH' AS relation, 'Word ' || item_id AS target FROM w JOIN t USING (trigger)""")
def template_triples(spark, d):
    key = F.col("item_id").cast("string")
    templates = S.table(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("trigger"), F.concat(F.lit("Item "), key).alias("source"), F.lit("OPENS_WITH").alias("relation"), F.concat(F.lit("Word "), key).alias("target"), F.lit("CONCEPT").alias("source_type"), F.lit("CONCEPT").alias("target_type"))
    return extract.template_triples(S.chunks(spark, d), templates).select("chunk_id", "source", "relation", "target")


# ---- names and attributes

@query("SELECT DISTINCT p_name AS raw, p_name AS mention FROM part")
def clean_mention(spark, d):
    raw = F.concat(F.lit('"('), F.col("p_name"), F.lit(" [Page 3]  ),"))
    return S.table(spark, d, "part").select(F.col("p_name").alias("raw"), extract.clean_mention(raw).alias("mention")).distinct()


@query("""WITH n AS (SELECT p_partkey, p_name, upper(left(a, 1)) || a[2:] || ' ' || upper(left(b, 1)) || b[2:] AS titled FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN titled WHEN 1 THEN NULL WHEN 2 THEN 'March 2024' ELSE titled END AS name FROM n""")
def clean_entity_name(spark, d):
    key, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(key % 4 == 0, F.concat(F.lit("the "), name, F.lit(" of"))).when(key % 4 == 1, F.concat(F.lit("with "), name)).when(key % 4 == 2, F.lit("march 2024")).otherwise(F.concat(F.lit("[00:12] ("), name, F.lit(");")))
    return S.table(spark, d, "part").select("p_partkey", extract.clean_name(raw).alias("name"))


@query("""WITH k AS (SELECT o_orderkey, floor(o_totalprice) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1000 AND o_orderkey % 2 = 0 THEN v::DOUBLE END AS amount, CASE WHEN v >= 1000 AND o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'USD' END END AS currency FROM k""")
def money_extract(spark, d):
    key = F.col("o_orderkey")
    value = F.floor("o_totalprice")
    # thousands groups where there are, else the plain number
    text = F.concat(F.lit("paid "), F.when(key % 3 == 0, "$").otherwise(""), F.format_number(value, 0), F.when(key % 3 == 1, " eur").otherwise(""), F.lit(" in all"))
    relation = F.when(key % 2 == 0, "HAS_BUDGET").otherwise("MENTIONS")
    return S.table(spark, d, "orders").select("o_orderkey", extract.amount_of(relation, text).alias("amount"), extract.currency_of(relation, text).alias("currency"))


@query("""WITH k AS (SELECT event_id, lpad((event_id % 60)::VARCHAR, 2, '0') AS a, lpad((event_id % 50)::VARCHAR, 2, '0') AS b FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN a || ':' || b WHEN 1 THEN a || ':' || b || ' - ' || a || ':59' ELSE 'none' END AS stamp,
CASE WHEN event_id % 2 = 0 THEN 'top-left' END AS region FROM k""")
def timestamp_extract(spark, d):
    key = F.col("event_id")
    a, b = F.lpad((key % 60).cast("string"), 2, "0"), F.lpad((key % 50).cast("string"), 2, "0")
    stamp = F.when(key % 3 == 0, F.concat(F.lit("["), a, F.lit(":"), b, F.lit("] "))).when(key % 3 == 1, F.concat(F.lit("["), a, F.lit(":"), b, F.lit(" - "), a, F.lit(":59] "))).otherwise("")
    text = F.concat(stamp, "event_type", F.when(key % 2 == 0, " at the Top-Left").otherwise(""))
    return S.table(spark, d, "events").select("event_id", extract.stamp_of(text, F.lit("none")).alias("stamp"), extract.region_of(text).alias("region"))


@query("SELECT DISTINCT upper(replace(event_type, ' ', '_')) || '_BY' AS relation, CASE WHEN event_type = 'click' THEN 'OPEN_TO_STUDENTS_OF' ELSE 'OFFERED_BY' END AS checked FROM events")
def relation_normalize(spark, d):
    text = F.when(F.col("event_type") == "click", "The Matrix of courses").otherwise("a plain statement")
    return S.table(spark, d, "events").select(extract.relation_name(F.concat("event_type", F.lit(" - by!"))).alias("relation"), extract.checked_relation(F.lit("OFFERED_BY"), text).alias("checked")).distinct()


# ---- nodes, names, repair

def _named(spark, d):
    """The given edges with names that differ by relation, so that nodes have several."""
    name = lambda c: F.concat(c, F.lit("/"), "relation")
    return S.edges(spark, d).withColumns({"source_name": name("source"), "target_name": name("target"), "source_type": F.left("source", F.lit(1)), "target_type": F.left("target", F.lit(1))})


_SEEN = "seen AS (SELECT source AS node, source || '/' || relation AS name, left(source, 1) AS type, file_id, seq * 2 AS pos FROM e UNION ALL SELECT target, target || '/' || relation, left(target, 1), file_id, seq * 2 + 1 FROM e)"


@query(f"""WITH {O.EDGES}, {_SEEN},
f AS (SELECT node, arg_min(name, pos) AS name, arg_min(type, pos) AS type FROM seen GROUP BY node),
a AS (SELECT node, string_agg(name, ',' ORDER BY pos, name) AS aliases FROM (SELECT node, name, min(pos) AS pos FROM seen GROUP BY ALL) GROUP BY node),
i AS (SELECT node, string_agg(file_id, ',' ORDER BY pos, file_id) AS file_ids FROM (SELECT node, file_id, min(pos) AS pos FROM seen WHERE file_id <> '' GROUP BY ALL) GROUP BY node)
SELECT node, name, type, aliases, coalesce(file_ids, '') AS file_ids FROM f JOIN a USING (node) LEFT JOIN i USING (node)""")
def build_nodes(spark, d):
    return resolve.nodes(_named(spark, d)).select("node", "name", "type", F.array_join("aliases", ",").alias("aliases"), F.array_join("file_ids", ",").alias("file_ids"))


@query(f"WITH {O.EDGES}, {_SEEN} SELECT file_id, count(DISTINCT node) AS n_nodes FROM seen WHERE file_id <> '' GROUP BY file_id")
def nodes_by_file(spark, d):
    found = resolve.nodes(_named(spark, d)).select(F.explode("file_ids").alias("file_id"))
    return found.groupBy("file_id").agg(F.count("*").alias("n_nodes"))


@query(f"WITH {O.EDGES}, u AS (SELECT DISTINCT source, relation, target FROM e WHERE source <> target), g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM u UNION ALL SELECT target FROM u) GROUP BY node), {_SEEN} SELECT node, arg_min(name, pos) AS name, degree FROM seen JOIN g USING (node) GROUP BY node, degree HAVING contains(lower(arg_min(name, pos)), 'placed_by') OR lower(arg_min(type, pos)) = 'placed_by'")
def node_search(spark, d):
    edges = _named(spark, d)
    return resolve.search(resolve.nodes(edges), graph.degrees(graph.dedup_edges(edges)), "PLACED_by").select("node", "name", "degree")


@query(f"WITH {O.EDGES} SELECT min(seq) AS seq, source, relation, target FROM e WHERE source = 'N:1' OR target = 'N:1' GROUP BY ALL")
def incident_edges(spark, d):
    return graph.dedup_edges(S.edges(spark, d).where("source = 'N:1' or target = 'N:1'")).select("seq", "source", "relation", "target")


@query(f"""WITH {O.EDGES}, f AS (SELECT seq, source, CASE WHEN relation = 'BASED_IN' AND source LIKE 'S:%' AND target <> 'N:0' AND contains(lower(target), 'n:1') THEN 'OPEN_TO_STUDENTS_OF' WHEN relation = 'BASED_IN' THEN 'OFFERED_BY' ELSE relation END AS relation, target FROM e)
SELECT * FROM f UNION ALL SELECT NULL, source, 'OFFERED_BY', 'N:0' FROM (SELECT 'S:' || x AS source FROM range(1, 4) AS t(x)) WHERE source IN (SELECT source FROM f) AND source NOT IN (SELECT source FROM f WHERE relation = 'OFFERED_BY' AND target = 'N:0')""")
def heal_relations(spark, d):
    edges = S.edges(spark, d).withColumn("relation", F.when(F.col("relation") == "BASED_IN", "OFFERED_BY").otherwise(F.col("relation")))
    return resolve.healed(edges, "S:", ["n:1"], "N:0", ["S:1", "S:2", "S:3"])


_PAIRS = [("bolt", "small widget"), ("gear", "large widget"), ("widget", "cold")]


@query(f"""WITH n AS (SELECT DISTINCT p_name AS node FROM part), p AS (SELECT unnest({[a for a, _ in _PAIRS]}) AS short, unnest({[b for _, b in _PAIRS]}) AS long),
s AS (SELECT short, long, max(node) AS source FROM p JOIN n ON list_contains(string_split(lower(node), ' '), short) GROUP BY ALL), l AS (SELECT long, max(node) AS target FROM p JOIN n ON contains(lower(node), long) GROUP BY ALL)
SELECT DISTINCT source, target FROM s JOIN l USING (long) WHERE source <> target""")
def bridge_equivalences(spark, d):
    names = S.table(spark, d, "part").select(F.col("p_name").alias("node")).distinct()
    return graph.bridges(names, S.edges(spark, d), _PAIRS).distinct()


_MENTIONS = """known AS (SELECT 'ENTITY_' || upper(replace(p_name, ' ', '_')) AS node, p_name AS name, min(p_partkey) AS pos FROM part GROUP BY ALL),
m AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'ENTITY_' || upper(replace(p_name, ' ', '_')) WHEN 1 THEN 'Dr. ' || p_name WHEN 2 THEN upper(replace(p_name, ' ', '  ')) WHEN 3 THEN p_name || 's'
  WHEN 4 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 5 THEN 'Zyx ' || p_name || ' qvw kjh' ELSE split_part(p_name, ' ', 2) END AS mention FROM part)"""


@query(f"""WITH {_MENTIONS},
w AS (SELECT *, string_split_regex(lower(mention), '[^a-z0-9_]+') AS ws FROM m), nw AS (SELECT *, string_split(lower(name), ' ') AS ns FROM known),
c AS (SELECT mention, node, pos, 1 AS tier, 0.0 AS s FROM m JOIN known ON mention = node
  UNION ALL SELECT mention, node, pos, 2, 0 FROM m JOIN known ON node = 'ENTITY_' || upper(regexp_replace(regexp_replace(mention, '^Dr. ', ''), ' +', '_', 'g'))
  UNION ALL SELECT mention, node, pos, 3, 0 FROM m JOIN known ON lower(mention) = lower(name)
  UNION ALL SELECT mention, node, pos, 4, -{_SIM.format(a='mention', b='name')} FROM m JOIN known ON {_SIM.format(a='mention', b='name')} >= 0.88
  UNION ALL SELECT mention, node, pos, 6, 0 FROM w JOIN nw ON length(mention) >= 4 AND contains(' ' || lower(name) || ' ', ' ' || array_to_string(ws, ' ') || ' ')
  UNION ALL SELECT mention, node, pos, 7, -len(list_intersect(list_distinct(ws), ns)) / len(list_distinct(ws)) FROM w JOIN nw ON len(list_intersect(list_distinct(ws), ns)) / len(list_distinct(ws)) >= 0.6)
SELECT mention, node, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY tier, s, pos) AS r FROM c) WHERE r = 1""")
def resolve_entity_tiers(spark, d):
    part, name, key = S.table(spark, d, "part"), F.col("p_name"), F.col("p_partkey")
    known = part.groupBy(T.canonical_id(name).alias("node"), name.alias("name")).agg(F.min("p_partkey").alias("at")).withColumn("aliases", F.array("name"))
    word = lambda n: F.split_part(name, F.lit(" "), F.lit(n))
    forms = [T.canonical_id(name), F.concat(F.lit("Dr. "), name), F.upper(F.replace(name, F.lit(" "), F.lit("  "))), F.concat(name, F.lit("s")), F.concat_ws(" ", word(2), word(1)), F.concat(F.lit("Zyx "), name, F.lit(" qvw kjh")), word(2)]
    mention = F.element_at(F.array(*forms), (key % 7 + 1).cast("int"))
    return resolve.lookup(part.select(mention.alias("mention")), known)


_OWN_ID = "('ENTITY_' || upper(replace({c}, ' ', '_')))"
# the first name of the list that a mention is like: without regard to case, similar, or of the same words
_LIKE = "(lower({c}) = lower(x) OR (length({c}) >= 4 AND length(x) >= 4 AND 1 - levenshtein(lower({c}), lower(x)) / greatest(length({c}), length(x)) >= 0.88) OR list_sort(list_distinct(string_split(lower({c}), ' '))) = list_sort(list_distinct(string_split(lower(x), ' '))))"
_TOLD = f"CASE WHEN list_contains(ids, {_OWN_ID}) THEN {_OWN_ID} ELSE coalesce(ids[list_position(list_transform(names, lambda x: {_LIKE}), true)], {_OWN_ID}) END"


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN upper(p_name) ELSE p_name END AS source, split_part(p_name, ' ', 2) AS target FROM part),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM t),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS seq, []::VARCHAR[] AS ids, []::VARCHAR[] AS names, '' AS source_id, '' AS target_id
  UNION ALL SELECT i, seq, CASE WHEN t_new THEN list_append(ids, target_id) ELSE ids END, CASE WHEN t_new THEN list_append(names, target) ELSE names END, source_id, target_id
  FROM (SELECT i, seq, target, source_id, target_id, source_id <> target_id AND NOT list_contains(ids, target_id) AS t_new, CASE WHEN s_new THEN list_append(ids, source_id) ELSE ids END AS ids, CASE WHEN s_new THEN list_append(names, source) ELSE names END AS names
    FROM (SELECT *, source_id <> target_id AND NOT list_contains(ids, source_id) AS s_new FROM (SELECT n.i, n.seq, ids, names, source, target, {_TOLD.format(c='source')} AS source_id, {_TOLD.format(c='target')} AS target_id FROM r JOIN n ON n.i = r.i + 1))))
SELECT seq, source_id, 'MADE_AS' AS relation, target_id FROM r WHERE i > 0 AND source_id <> target_id""")
def resolve_triples(spark, d):
    """Parts as triples told one after another to the running registry; the twin tells them in a recursion."""
    name, key = F.col("p_name"), F.col("p_partkey")
    source = F.when(key % 3 == 0, F.concat(name, F.lit("s"))).when(key % 3 == 1, F.upper(name)).otherwise(name)
    rows = S.table(spark, d, "part").select(key.alias("seq"), source.alias("source"), F.lit("made-as").alias("relation"), F.split_part(name, F.lit(" "), F.lit(2)).alias("target"))
    return registry.registered(rows)[0].select("seq", "source_id", "relation", "target_id")


@query(f"""WITH {O.EDGES}, p AS (SELECT o_orderkey AS chain_id, 1 AS hop_no, 'O:' || o_orderkey AS source, 'C:' || o_custkey AS target FROM orders
UNION ALL SELECT o_orderkey, 2, 'C:' || o_custkey, 'O:' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 3, 'O:' || o_orderkey, 'R:0' FROM orders),
f AS (SELECT source, target, arg_min(relation, seq) AS relation, min(seq) AS seq FROM e GROUP BY ALL)
SELECT chain_id, hop_no, p.source, p.target, coalesce(f.relation, r.relation, 'CONNECTED_TO') AS relation, f.seq IS NULL AND r.seq IS NOT NULL AS is_reverse, coalesce(f.seq, r.seq) AS seq
FROM p LEFT JOIN f ON f.source = p.source AND f.target = p.target LEFT JOIN f r ON r.source = p.target AND r.target = p.source""")
def chain_edge_pick(spark, d):
    o, c = F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")), F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))
    paths = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("chain_id"), F.array(o, c, o, F.lit("R:0")).alias("path"))
    return resolve.path_hops(paths, S.edges(spark, d))
