"""Lexical index tables of a chunk table (conversation_id, chunk_id, text): all statistics per conversation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import written


@dataclass(frozen=True)
class Index:
    """Stored tables that searches read in place of the texts.

    postings: (conversation_id, term, chunk_id, tf, content), content where a word that is no stop word gave the term;
    near: the postings without most chunks that lack an id (chunk_id); stats: (conversation_id, chunk_id, dl); corpus: (conversation_id, n, avgdl); idf: (conversation_id, term, df, idf);
    weighed: the idf of some terms (conversation_id, term).
    """

    postings: DataFrame
    stats: DataFrame
    corpus: DataFrame
    idf: DataFrame
    near: Callable[[DataFrame], DataFrame] | None = None
    weighed: Callable[[DataFrame], DataFrame] | None = None

    def postings_of(self, ids: DataFrame) -> DataFrame:
        """The postings of the chunks (chunk_id), and perhaps of more: chunks are left out before they become rows where the tables allow it."""
        return self.near(ids) if self.near else self.postings

    def idf_of(self, terms: DataFrame) -> DataFrame:
        """The idf of the terms (conversation_id, term), and perhaps of more."""
        return self.weighed(terms) if self.weighed else self.idf


def postings(chunks: DataFrame) -> DataFrame:
    """(conversation_id, chunk_id, term, tf, content); counts combine before the shuffle."""
    words = T.word_rows(chunks, ["conversation_id", "chunk_id"], "text").withColumn("content", ~F.col("word").isin(T.STOPWORDS))
    return T.token_rows(words).groupBy("conversation_id", "chunk_id", "term").agg(F.count("*").alias("tf"), F.max("content").alias("content"))


def doc_stats(chunks: DataFrame, post: DataFrame) -> DataFrame:
    """(conversation_id, chunk_id, dl): tokens of a chunk, 0 for one that has none."""
    held = post.groupBy("conversation_id", "chunk_id").agg(F.sum("tf").alias("dl"))
    every = chunks.select("conversation_id", "chunk_id", F.lit(0).cast("long").alias("dl"))
    return held.unionByName(every).groupBy("conversation_id", "chunk_id").agg(F.max("dl").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("conversation_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(post: DataFrame, corpus: DataFrame) -> DataFrame:
    """(conversation_id, term, df, idf) with idf = ln((n + 1) / df)."""
    df = post.groupBy("conversation_id", "term").agg(F.count("*").alias("df"))
    return df.join(corpus, "conversation_id").select("conversation_id", "term", "df", F.log((F.col("n") + 1) / F.col("df")).alias("idf"))


def built(chunks: DataFrame) -> Index:
    """The index of the chunks: texts are tokenised once, and the tables lie in the shared folder."""
    post = written(postings(chunks))
    stats = written(doc_stats(chunks, post))
    corpus = written(corpus_stats(stats))
    return Index(post, stats, corpus, written(idf(post, corpus)))


def add_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old chunks and those new ones whose id is not there yet."""
    return old.unionByName(new.join(old.select("chunk_id"), "chunk_id", "left_anti"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chunk_id: a new row takes the place of the old one."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def without_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index without the given files."""
    return index.join(files.select("file_id").distinct(), "file_id", "left_anti")


def without_conversations(index: DataFrame, conversations: DataFrame) -> DataFrame:
    """The index without the given conversations."""
    return index.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_anti")


def stub_vectors(chunks: DataFrame, size: int = 384) -> DataFrame:
    """(chunk_id, slot, value): unit vectors of hashed words in sparse form, in place of an embedding model."""
    slot = (F.conv(F.left(F.md5("word"), F.lit(8)), 16, 10).cast("long") % size).cast("int")
    words = T.word_rows(chunks, ["chunk_id"], "text")
    counts = T.token_rows(words).select("chunk_id", F.col("term").alias("word")).groupBy("chunk_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "chunk_id").select("chunk_id", "slot", (F.col("n") / F.col("norm")).alias("value"))


def dense_vectors(sparse: DataFrame, keys: DataFrame, size: int = 384) -> DataFrame:
    """(chunk_id, vector): the sparse form as arrays; a chunk of ``keys`` without words has ``size`` zeros."""
    per = sparse.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return keys.select("chunk_id").join(per, "chunk_id", "left").select("chunk_id", filled.alias("vector"))
