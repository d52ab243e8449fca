"""Pieces of DuckDB SQL shared by the twins of the queries."""

from __future__ import annotations

import re

# Fixed values, written down once more, so that a list misread in the library shows: stop words (those of one letter or with
# an apostrophe can't be tokens and are left out), and ordinals both ways.
_STOP = """about above actually after again against all also am an and any are as ask asked at be because been before being below between
both but by cannot contain contains could detail details did do doc docs document does doing down during each earlier etc exactly explain
explained explaining few file files find for from further give had has have having he help her here hers herself him himself his how if in
information instead into is it its itself just later like me mention mentioned mentions more most my myself no nor not of off on once only or
other ought our ours ourselves out over own please query rather really reference referenced referencing repeat repeated repeating said same
say says she should show simply basically so some stated such talking talks tell than that the their theirs them themselves then there these
they this those through to too under until up very was we well were what when where which while who whom why with would you your yours
yourself yourselves"""
_ORDINALS = "1st first 2nd second 3rd third 4th fourth 5th fifth 6th sixth 7th seventh 8th eighth 9th ninth 10th tenth".split()
STOP = "[" + ", ".join(f"'{w}'" for w in _STOP.split()) + "]"
TWIN_MAP = "MAP {" + ", ".join(f"'{a}': '{b}', '{b}': '{a}'" for a, b in zip(_ORDINALS[::2], _ORDINALS[1::2])) + "}"


def words(text: str) -> str:
    split = f"string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+')"
    return f"list_filter(list_transform(list_filter({split}, lambda w: regexp_full_match(w, '[a-z0-9_]+')), lambda w: trim(w, '_')), lambda w: length(w) >= 2)"


def stem(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 3 THEN {w} WHEN suffix({w}, 'ies') AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
    WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN left({w}, length({w}) - 1)
    WHEN suffix({w}, 'ing') AND length({w}) > 4 THEN left({w}, length({w}) - 3)
    WHEN suffix({w}, 'ed') AND length({w}) > 4 THEN left({w}, length({w}) - 2) ELSE {w} END"""


def n_words(text: str) -> str:
    trimmed = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    return rf"CASE WHEN {trimmed} = '' THEN 0 ELSE len(string_split_regex({trimmed}, '\s+')) END"


def tokens(text: str, drop: bool = False) -> str:
    base = words(text)
    if drop:
        base = f"list_filter({base}, lambda w: NOT list_contains({STOP}, w))"
    emitted = f"list_transform({base}, lambda w: [w, CASE WHEN ({stem('w')}) <> w THEN {stem('w')} END, {TWIN_MAP}[w]])"
    return f"list_filter(flatten({emitted}), lambda w: w IS NOT NULL)"


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, source AS conversation_id, (['document','image','audio','video'])[doc_id % 4 + 1] AS file_type, text FROM documents)"
QUERIES = "q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS conversation_id, text AS query FROM benchmark)"
EXPANDED = f"trim(query || ' ' || array_to_string(list_filter(list_transform({words('query')}, lambda w: {TWIN_MAP}[w]), lambda w: w IS NOT NULL), ' '))"
INDEX = f"""{CHUNKS},
tok AS MATERIALIZED (SELECT conversation_id, chunk_id, {tokens('text')} AS t FROM chunks),
post AS MATERIALIZED (SELECT conversation_id, chunk_id, term, count(*) AS tf FROM (SELECT conversation_id, chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT conversation_id, chunk_id, CAST(len(t) AS BIGINT) AS dl FROM tok),
corpus AS (SELECT conversation_id, count(*) AS n, avg(dl) AS avgdl FROM stats GROUP BY ALL),
idf AS MATERIALIZED (SELECT conversation_id, term, df, ln((n + 1)::DOUBLE / df) AS idf FROM (SELECT conversation_id, term, count(*) AS df FROM post GROUP BY ALL) JOIN corpus USING (conversation_id))"""
BM25 = f"""{INDEX}, {QUERIES},
x AS (SELECT query_id, conversation_id, {EXPANDED} AS e FROM q),
qt AS (SELECT query_id, conversation_id, term, count(*) AS mult FROM (SELECT query_id, conversation_id, unnest(CASE WHEN len({tokens('e', True)}) > 0 THEN {tokens('e', True)} ELSE {tokens('e')} END) AS term FROM x) GROUP BY ALL),
ti AS (SELECT * FROM qt JOIN idf USING (conversation_id, term)),
base AS (SELECT query_id, conversation_id, sum(mult * idf) AS base FROM ti GROUP BY ALL),
extra AS (SELECT query_id, chunk_id, sum(mult * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS extra
          FROM ti JOIN post USING (conversation_id, term) JOIN stats USING (conversation_id, chunk_id) JOIN corpus USING (conversation_id) GROUP BY ALL),
raw AS (SELECT query_id, chunk_id, round(base + coalesce(extra, 0.0), 6) AS bm25_raw FROM base JOIN chunks USING (conversation_id) LEFT JOIN extra USING (query_id, chunk_id)),
ranked AS (SELECT *, round(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id), 6) AS bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_raw DESC, chunk_id) AS bm25_rank FROM raw WHERE bm25_raw > 0),
sparse AS (SELECT query_id, chunk_id, bm25_raw, bm25_score, CAST(bm25_rank AS INT) AS bm25_rank FROM ranked WHERE bm25_rank <= 30)"""
DENSE = """v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector FROM embeddings),
dscored AS (SELECT query_id, c.chunk_id, round(list_inner_product(qv.vector, cv.vector), 6) AS dense_score
  FROM q JOIN v qv ON qv.chunk_id = query_id JOIN chunks c USING (conversation_id) JOIN v cv ON cv.chunk_id = c.chunk_id),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dscored),
dense AS (SELECT query_id, chunk_id, dense_score, CAST(dense_rank AS INT) AS dense_rank FROM dranked WHERE dense_rank <= 30)"""
# each query's route by its number; a modality without a file in the conversation weighs 0
ROUTE = "(['document', 'image', 'audio', 'video', 'multimodal', 'conversational', 'off', 'failed'])[query_id % 8 + 1]"
WEIGHTS = f"""up AS (SELECT DISTINCT conversation_id, file_type FROM chunks),
routed AS (SELECT query_id, conversation_id, {ROUTE} AS route, unnest(['document','image','audio','video']) AS file_type FROM q),
rw AS (SELECT query_id, routed.file_type, CASE WHEN up.file_type IS NULL THEN 0.0 WHEN route = 'conversational' THEN 0.1 WHEN route = 'multimodal' THEN 1.0 WHEN route = 'off' THEN 0.5
  WHEN route = 'failed' THEN CASE WHEN routed.file_type = 'document' THEN 1.0 ELSE 0.5 END WHEN route = routed.file_type THEN 1.0 ELSE 0.2 END::DOUBLE AS weight
  FROM routed LEFT JOIN up ON up.conversation_id = routed.conversation_id AND up.file_type = routed.file_type)"""
# the files that are done: by their label, or by their text where they have none
ACTIVE = "act AS (SELECT doc_id AS chunk_id FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE quality WHEN 1 THEN true WHEN 0 THEN false ELSE length(text) > 0 END)"
FUSED = f"""{BM25}, {DENSE}, {WEIGHTS}, {ACTIVE},
hits AS (SELECT query_id, chunk_id, dense_score, dense_rank, bm25_score, bm25_rank FROM (SELECT * FROM dense WHERE chunk_id IN (FROM act)) FULL JOIN (SELECT * FROM sparse WHERE chunk_id IN (FROM act)) USING (query_id, chunk_id)),
concepts AS (SELECT query_id, conversation_id, unnest(list_distinct({tokens('query', True)})) AS term FROM q),
cw AS (SELECT query_id, term, greatest(0.05, coalesce(idf, 1.0)) AS w FROM concepts LEFT JOIN idf USING (conversation_id, term)),
ct AS (SELECT query_id, sum(w) AS total FROM cw GROUP BY ALL),
held AS (SELECT chunk_id, list_distinct({tokens('text', True)}) AS held FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM hits)),
cm AS (SELECT query_id, chunk_id, sum(w) AS matched FROM hits JOIN held USING (chunk_id) JOIN cw USING (query_id)
       WHERE list_contains(held, term) OR coalesce(list_contains(held, {TWIN_MAP}[term]), false) GROUP BY ALL),
r AS (SELECT hits.*, CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE round(coalesce(matched, 0.0) / total, 6) END::DOUBLE AS ratio
      FROM hits LEFT JOIN ct USING (query_id) LEFT JOIN cm USING (query_id, chunk_id)),
s AS (SELECT query_id, chunk_id, file_type, coalesce(dense_score, 0.0) AS dense_score, coalesce(bm25_score, 0.0) AS bm25_score, dense_rank, bm25_rank,
       round(ratio, 4) AS coordination_ratio, round((weight - 0.5) * 0.15, 4)::DOUBLE AS modality_boost,
       round(greatest(0.0, least(1.0, (0.45 * ((coalesce(0.5 / (40 + dense_rank), 0.0) + coalesce(0.5 / (40 + bm25_rank), 0.0)) * 41) + 0.45 * ratio + (weight - 0.5) * 0.15)
         * CASE WHEN ratio <= 0.2 THEN 0.05 ELSE 0.4 + 0.6 * pow(ratio, 0.6) END)), 4)::DOUBLE AS final_score
      FROM r JOIN chunks USING (chunk_id) JOIN rw USING (query_id, file_type)),
p AS (SELECT *, {', '.join(f"round(CASE WHEN max({c}) OVER w = min({c}) OVER w THEN CASE WHEN max({c}) OVER w > 0 THEN 100.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) * 100 END, 1)::DOUBLE AS {c}_pct" for c in ('final_score', 'dense_score', 'bm25_score'))} FROM s WINDOW w AS (PARTITION BY query_id)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score_pct DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS INT) AS position FROM p),
scored AS (SELECT *, CASE WHEN final_score_pct >= 70 THEN 'HIGH' WHEN final_score_pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier FROM o),
fused AS (FROM scored WHERE position <= 5)"""
EDGES = """e AS (
  SELECT n_nationkey::BIGINT AS seq, 'N:' || n_nationkey AS source, 'PART_OF' AS relation, 'R:' || n_regionkey AS target, 'nation' AS file_id FROM nation
  UNION ALL SELECT 1000000000000 + c_custkey, 'C:' || c_custkey, 'BASED_IN', 'N:' || c_nationkey, 'customer' FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, 'S:' || s_suppkey, 'BASED_IN', 'N:' || s_nationkey, 'supplier' FROM supplier
  UNION ALL SELECT 2000000000000 + o_orderkey, 'O:' || o_orderkey, 'PLACED_BY', 'C:' || o_custkey, '' FROM orders
  UNION ALL SELECT 3000000000000 + l_orderkey * 8 + l_linenumber, 'S:' || l_suppkey, 'SUPPLIES', 'P:' || l_partkey, 'lineitem' FROM lineitem)"""
BOTH = f"{EDGES}, b AS (SELECT DISTINCT source AS node, target AS other FROM e UNION SELECT DISTINCT target, source FROM e)"


def levels(seed: str, depth: int) -> str:
    """CTEs l0 .. l<depth> of nodes first reached at each depth."""
    out = [f"l0 AS ({seed})"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(k))
        out.append(f"l{k} AS (SELECT DISTINCT b.other AS node FROM b JOIN l{k - 1} USING (node) WHERE b.other NOT IN ({seen}))")
    union = " UNION ALL ".join(f"SELECT node, {k} AS depth FROM l{k}" for k in range(depth + 1))
    return ", ".join(out) + f", reached AS ({union})"


def visits(edges: str, seeds: list[str], depth: int, most: int, first: str = "0") -> str:
    """CTEs of a queue's walk over the edges (seq, source, relation, target, ...): ``walked`` has its first hops, ``hop_no`` their order.

    A node's outgoing edges come before its incoming ones, each by the first edge of the neighbour. All levels are walked, as the order of
    the first hops does not hang on where the walk ends. first: what puts the hops of a file in front.
    """
    out = [f"pr AS (SELECT source, target, min(seq) AS nb FROM {edges} GROUP BY ALL)"]
    out.append(f"ad AS (SELECT x.*, nb, source AS node, target AS other, 0 AS way FROM {edges} x JOIN pr USING (source, target) UNION ALL SELECT x.*, nb, target, source, 1 FROM {edges} x JOIN pr USING (source, target) WHERE source <> target)")
    out.append("v0 AS (" + " UNION ALL ".join(f"SELECT '{s}' AS node, {k} AS no" for k, s in enumerate(seeds)) + ")")
    for k in range(depth):
        seen = " UNION ALL ".join(f"FROM v{j}" for j in range(k + 1))
        out.append(f"w{k} AS (SELECT ad.*, v.no, {k} AS level, s.no AS other_no FROM ad JOIN v{k} v USING (node) LEFT JOIN ({seen}) s ON s.node = other WHERE s.no IS NULL OR s.no >= v.no)")
        out.append(f"v{k + 1} AS (SELECT other AS node, (SELECT max(no) + 1 FROM ({seen})) + row_number() OVER (ORDER BY min((no, way, nb, other, seq, relation))) AS no FROM w{k} WHERE other_no IS NULL GROUP BY other)")
    every = " UNION ALL ".join(f"FROM w{k}" for k in range(depth))
    out.append(f"walked AS (SELECT *, CAST(row_number() OVER (ORDER BY {first}, level, no, way, nb, other, seq, relation) AS INT) AS hop_no FROM ({every}) QUALIFY hop_no <= {most})")
    return ", ".join(out)


_SEARCHED = "q x qt ti base extra raw ranked sparse v dscored dranked dense up routed rw act hits concepts cw ct held cm r s p o scored fused".split()


def again(text: str, suffix: str = "2") -> str:
    """The tables of FUSED behind its queries once more, under other names, for the queries of q<suffix>."""
    tail = text.split(QUERIES + ",\n", 1)[1]
    return re.sub(r"(?<![\w\\'])(" + "|".join(_SEARCHED) + r")(?![\w'])", lambda m: m[1] + suffix, tail)


def checked(claims: str, out: str = "checked") -> str:
    """Tables that verify the claims (answer_id, claim_no, passage_number, text, claim) of the table ``claims``."""
    return rf"""k AS (SELECT answer_id, claim_no, passage_number, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, list_filter({tokens('claim', True)}, lambda w: length(w) > 2) AS toks FROM {claims}),
sen AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS sentences FROM k),
sco AS (SELECT *, list_transform(sentences, lambda x: CASE WHEN len(toks) = 0 THEN 1.0 ELSE len(list_filter(toks, lambda w: contains(lower(x), w)))::DOUBLE / len(toks) END) AS scores FROM sen),
ver AS (SELECT answer_id, claim_no, passage_number, text, toks, coalesce(list_max(scores), 0.0) AS best, sentences[list_position(scores, list_max(scores))] AS sentence FROM sco),
{out} AS (SELECT answer_id, claim_no, passage_number, text IS NOT NULL AS given, CASE WHEN text IS NULL THEN false ELSE len(toks) = 0 OR len(list_filter(toks, lambda w: contains(lower(text), w)))::DOUBLE / greatest(len(toks), 1) >= 0.30 OR best >= 0.25 END AS is_grounded,
  coalesce(trim(regexp_replace(regexp_replace(CASE WHEN best > 0 THEN sentence ELSE left(text, 200) END, '^\s+|\s+$', '', 'g'), '^(?:[-*•]|\d+\.)\s+', ''), '"' || chr(39)), '') AS evidence FROM ver),
ground AS (SELECT answer_id, round(avg(is_grounded::INT), 2)::DOUBLE AS groundedness, count(*) AS n_claims FROM {out} GROUP BY answer_id)"""
