"""Hybrid retrieval for a batch of queries (query_id, conversation_id, query).

Sparse: BM25Plus over the stored index of the conversation's chunks. Dense: dot product of unit vectors. The two
rankings meet in a full outer join; reciprocal ranks, weighted term coverage and a modality weight give the final
score. No text is read here: terms and lengths come from the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import text as T

from . import index

# Constants of the scores.
K1, B, DELTA, RRF_K, OVERFETCH = 1.5, 0.75, 1.0, 40, 6
MODALITIES = ("document", "image", "audio", "video")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, conversation_id, term, mult): tokens without stop words, or with them if none is left."""
    text = T.expanded(F.col("query"))
    without = T.tokens(text, drop_stopwords=True)
    picked = F.when(F.size(without) > 0, without).otherwise(T.tokens(text))
    return queries.select("query_id", "conversation_id", F.explode(picked).alias("term")).groupBy("query_id", "conversation_id", "term").agg(F.count("*").alias("mult"))


def bm25_topk(queries: DataFrame, own: index.Index, limit: int = 30, of_type: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25_raw, bm25_score, bm25_rank): the ``limit`` best chunks of each query.

    A chunk without a query term still scores the sum of delta * idf. Only the first ``limit`` such chunks
    of a conversation can reach the top, so they alone join the matched ones. of_type: the (chunk_id) of wanted
    file types; other chunks go after the best score is taken.
    """
    terms = query_terms(queries).join(own.idf, ["conversation_id", "term"])
    dl = own.stats.join(own.corpus, "conversation_id")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = terms.join(own.postings, ["conversation_id", "term"]).join(dl, ["conversation_id", "chunk_id"])
    hits = hits.groupBy("query_id", "conversation_id", "chunk_id").agg(F.sum(F.col("mult") * F.col("idf") * weight).alias("extra"))
    return ranked(terms, hits, own.stats, limit, of_type)


def ranked(terms: DataFrame, hits: DataFrame, stats: DataFrame, limit: int, of_type: DataFrame | None = None) -> DataFrame:
    """The end of :func:`bm25_topk`: hits (query_id, conversation_id, chunk_id, extra), with the terms of the queries and their idf."""
    base = terms.groupBy("query_id", "conversation_id").agg(F.sum(F.col("mult") * F.col("idf") * DELTA).alias("base"))
    wanted = stats if of_type is None else stats.join(of_type.select("chunk_id").distinct(), "chunk_id", "left_semi")
    first = wanted.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("chunk_id"))).where(F.col("n") <= limit)
    plain = base.join(first.select("conversation_id", "chunk_id"), "conversation_id").select("query_id", "conversation_id", "chunk_id", F.lit(0.0).alias("extra"))
    both = hits.unionByName(plain).groupBy("query_id", "conversation_id", "chunk_id").agg(F.max("extra").alias("extra"))
    scored = both.join(base, ["query_id", "conversation_id"]).select("query_id", "chunk_id", F.round(F.col("base") + F.col("extra"), 6).alias("bm25_raw")).where("bm25_raw > 0")
    top = scored.groupBy("query_id").agg(F.max("bm25_raw").alias("top"))
    if of_type is not None:
        scored = scored.join(of_type.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = scored.withColumn("bm25_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_raw"), "chunk_id"))).where(F.col("bm25_rank") <= limit)
    return best.join(top, "query_id").select("query_id", "chunk_id", "bm25_raw", F.round(F.col("bm25_raw") / F.col("top"), 6).alias("bm25_score"), "bm25_rank")


def dot(a: str, b: str) -> Column:
    """The inner product of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, chunks: DataFrame, limit: int = 30, of_type: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """(query_id, chunk_id, dense_score, dense_rank) by cosine within the conversation.

    vectors: (query_id, conversation_id, query_vector); chunks: (conversation_id, chunk_id, vector). The join key is the
    conversation and a salt of the chunk, so that only its own chunks are compared and a large conversation is the work
    of several tasks; each salt gives its first ``limit``. of_type: as in :func:`bm25_topk`.
    """
    if of_type is not None:
        chunks = chunks.join(of_type.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = vectors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = chunks.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    scored = asked.join(salted, ["conversation_id", "salt"]).select("query_id", "salt", "chunk_id", F.round(dot("query_vector", "vector"), 6).alias("dense_score"))
    best = [F.desc("dense_score"), "chunk_id"]
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*best))).where(F.col("n") <= limit)
    ranked = near.withColumn("dense_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return ranked.where(F.col("dense_rank") <= limit).select("query_id", "chunk_id", "dense_score", "dense_rank")


def coordination(queries: DataFrame, hits: DataFrame, own: index.Index) -> DataFrame:
    """(query_id, chunk_id, ratio): idf-weighted share of the query's distinct concepts a chunk holds.

    Unknown concepts weigh 1; known ones at least 0.05. No concepts: 1. The hits ask the postings for the few
    terms of their queries.
    """
    concepts = F.array_distinct(T.tokens(F.col("query"), drop_stopwords=True))
    asked = queries.select("query_id", "conversation_id", F.explode(concepts).alias("term"))
    weighed = asked.join(own.idf_of(asked).select("conversation_id", "term", "idf"), ["conversation_id", "term"], "left")
    weighed = weighed.select("query_id", "conversation_id", "term", F.greatest(F.lit(0.05), F.coalesce("idf", F.lit(1.0))).alias("w"))
    total = weighed.groupBy("query_id").agg(F.sum("w").alias("total"))
    forms = weighed.withColumn("form", F.explode(F.array_compact(F.array("term", T.twin(F.col("term"))))))
    wanted = hits.select("query_id", "chunk_id").join(forms, "query_id")
    held = own.postings_of(hits).where("content").select("conversation_id", "chunk_id", F.col("term").alias("form"))
    matched = wanted.join(held, ["conversation_id", "chunk_id", "form"]).select("query_id", "chunk_id", "term", "w").distinct()
    matched = matched.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("matched"))
    joined = hits.select("query_id", "chunk_id").join(total, "query_id", "left").join(matched, ["query_id", "chunk_id"], "left")
    return joined.select("query_id", "chunk_id", F.when(F.coalesce("total", F.lit(0.0)) == 0, 1.0).otherwise(F.round(F.coalesce("matched", F.lit(0.0)) / F.col("total"), 6)).alias("ratio"))


def still_active(hits: DataFrame, active: DataFrame) -> DataFrame:
    """The hits whose chunk is of an active file, by (chunk_id); their ranks stay. With no active file at all, every hit."""
    if active.isEmpty():
        return hits
    return hits.join(active.select("chunk_id").distinct(), "chunk_id", "left_semi")


def fuse(dense: DataFrame, sparse: DataFrame, ratios: DataFrame, chunks: DataFrame, weights: DataFrame | None = None, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """The ``k`` best chunks of each query with all scores."""
    return scored(dense, sparse, ratios, chunks, weights, alpha).where(F.col("position") <= k)


def scored(dense: DataFrame, sparse: DataFrame, ratios: DataFrame, chunks: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """Every candidate of each query with all scores and its position; see the module.

    weights: (query_id, file_type, weight); missing ones count 0.5.
    """
    both = dense.join(sparse, ["query_id", "chunk_id"], "full_outer").join(ratios, ["query_id", "chunk_id"], "left")
    both = both.join(chunks.select("chunk_id", "file_type"), "chunk_id")
    if weights is not None:
        both = both.join(weights, ["query_id", "file_type"], "left")
    else:
        both = both.withColumn("weight", F.lit(None).cast("double"))
    part = lambda c, share: F.coalesce(F.lit(share) / (RRF_K + F.col(c)), F.lit(0.0))
    rrf = (part("dense_rank", alpha) + part("bm25_rank", 1 - alpha)) * (RRF_K + 1)
    ratio = F.coalesce("ratio", F.lit(1.0))
    boost = (F.coalesce("weight", F.lit(0.5)) - 0.5) * 0.15
    factor = F.when(ratio <= 0.2, 0.05).otherwise(0.4 + 0.6 * F.pow(ratio, 0.6))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.45 * rrf + 0.45 * ratio + boost) * factor))
    rows = both.select("query_id", "chunk_id", "file_type", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "dense_rank", "bm25_rank", F.round(ratio, 4).alias("coordination_ratio"), F.round(boost, 4).alias("modality_boost"), F.round(final, 4).alias("final_score"))
    whole = Window.partitionBy("query_id")

    rows = rows.select("*", *[F.round(minmax(F.col(c), whole) * 100, 1).alias(f"{c}_pct") for c in ("final_score", "dense_score", "bm25_score")])
    order = whole.orderBy(F.desc("final_score_pct"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    tier = F.when(F.col("final_score_pct") >= 70, "HIGH").when(F.col("final_score_pct") >= 40, "MEDIUM").otherwise("LOW")
    return rows.withColumn("position", F.row_number().over(order)).withColumn("confidence_tier", tier)


def minmax(score: Column, whole: WindowSpec) -> Column:
    """The score's place between the least and the greatest of its window; if all are equal 1, or 0 where they are not above 0."""
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def modality_gaps(routed: DataFrame, found: DataFrame, uploaded: DataFrame, least: float = 8.0) -> DataFrame:
    """(query_id, modality, status, message): routed modalities (query_id, conversation_id, modality) without a file in the
    conversation, or without a candidate of ``least`` percent among all that were scored."""
    good = found.where(F.col("final_score_pct") >= least).select("query_id", F.col("file_type").alias("modality")).distinct()
    there = uploaded.select("conversation_id", F.col("file_type").alias("modality")).distinct()
    asked = routed.where("modality <> 'conversational'")
    served = asked.join(there, ["conversation_id", "modality"], "left_semi").join(good, ["query_id", "modality"], "left_semi").select("query_id", "modality")
    open_ = asked.join(served, ["query_id", "modality"], "left_anti")
    return open_.select("query_id", "modality", F.lit("no_matching_chunks").alias("status"), F.concat(F.lit("No matching "), "modality", F.lit(" context found")).alias("message"))


def default_weights(queries: DataFrame) -> DataFrame:
    """(query_id, file_type, weight) without a routing model: documents weigh 1, other modalities 0.5."""
    return routed_weights(queries.withColumn("route", F.lit("failed")))


# Weights by what a query is routed to; a single modality weighs 1 and the others 0.2.
ROUTES = {"conversational": 0.1, "multimodal": 1.0, "off": 0.5}


def routed_weights(routed: DataFrame) -> DataFrame:
    """(query_id, file_type, weight) of (query_id, route): a modality, conversational, multimodal, off, or failed."""
    weight = F.when(F.col("route") == "failed", F.when(F.col("file_type") == "document", 1.0).otherwise(0.5))
    for route, w in ROUTES.items():
        weight = weight.when(F.col("route") == route, w)
    weight = weight.when(F.col("route") == F.col("file_type"), 1.0).otherwise(0.2)
    kinds = F.explode(F.array(*[F.lit(m) for m in MODALITIES]))
    return routed.select("query_id", "route", kinds.alias("file_type")).select("query_id", "file_type", weight.alias("weight"))


def clamped(weights: DataFrame, queries: DataFrame, files: DataFrame) -> DataFrame:
    """The weights, 0 where the query's conversation has no file of the modality, by (conversation_id, file_type); null is a document."""
    there = files.select("conversation_id", F.lower(F.coalesce("file_type", F.lit("document"))).alias("file_type")).distinct().withColumn("there", F.lit(True))
    rows = weights.join(queries.select("query_id", "conversation_id"), "query_id").join(there, ["conversation_id", "file_type"], "left")
    return rows.select("query_id", "file_type", F.when(F.col("there"), F.col("weight")).otherwise(0.0).alias("weight"))


def with_paths(answers: DataFrame, hops: DataFrame) -> DataFrame:
    """The response rows with multihop, the hops (query_id, hop_no, source, relation, target) of their queries; null without any."""
    per = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hop_no", "source", "relation", "target"))).alias("multihop"))
    return answers.join(per, "query_id", "left")


def response(queries: DataFrame, found: DataFrame, n_candidates: DataFrame, routed: DataFrame, weights: DataFrame, gaps: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row a query: query, conversation_id, routed_categories, router_weights, router_intent_label, alpha, total_candidates, chunks, modality_gaps.

    found: the few chunks of :func:`fuse`; n_candidates: (query_id, total_candidates); routed: (query_id, route).
    """
    label = F.when(F.col("route") == "multimodal", "Multi-Modal").when(F.col("route") == "conversational", "General Conversation").when(F.col("route") == "off", "Balanced").when(F.col("route").isin("failed", "document"), "Document (PDF/Docx)").otherwise(F.initcap("route"))
    every = F.array(*[F.lit(m) for m in MODALITIES])
    names = F.when(F.col("route").isin("multimodal", "off"), every).when(F.col("route") == "failed", F.array(F.lit("document"))).otherwise(F.array("route"))
    chunks = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in found.columns if c not in ("query_id", "position")]))).alias("chunks"))
    shares = weights.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", "weight")))).alias("router_weights"))
    open_ = gaps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("modality", "status"))).alias("modality_gaps"))
    rows = queries.join(routed, "query_id").withColumns({"routed_categories": names, "router_intent_label": label, "alpha": F.lit(alpha)})
    rows = rows.join(shares, "query_id", "left").join(n_candidates, "query_id", "left").join(chunks, "query_id", "left").join(open_, "query_id", "left")
    return rows.select("query_id", "query", "conversation_id", "routed_categories", "router_weights", "router_intent_label", "alpha", F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"), "chunks", "modality_gaps")
