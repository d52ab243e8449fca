"""From raw documents to token ids in five stages; each stage's output is a table in the shared folder.

language      drops documents whose language is undetermined (no text or no letter)
lines         drops lines that several documents share, but for their first document
near          keeps one document of each near-duplicate class
mixing        repeats or drops documents so that sources reach their target weights
pieces        encodes each document and checks that the ids decode to its text

Defined results of the stages. Nulls: language drops null, empty and letterless texts, whatever else is null; in lines, rows
with a null doc_id keep all lines; in near, they are the last of their class; in mixing, a null source is a source of its own.
Texts left empty by lines stay, have no like in near, and are not emitted by mixing, as they have no words. Very long texts
are processed whole. Ties: a text exactly at the threshold of near has a like. Repeated rows: equal rows are one document in
lines, one of them stays in near, and mixing shares their copies. An empty table gives an empty table. Further columns stay up
to the last stage, whatever their names, but for lang_pred, lang_score, n_lines and n_dropped, which language and lines write
for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, mixing, ngram_join, sentencepiece_fst
from tidemark.llm.common import written
from tidemark.llm.queries import fold, tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.train(docs, fold(3) != 1))
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_fst.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixing", mixed), ("pieces", pieces)]

#: Language identification and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
