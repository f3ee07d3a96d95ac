"""The corpus pipeline: five of the training-data operators in turn, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of `documents`; the last adds what encoding gives.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfix.llm import bpe, decontam, langid, ngramjoin, suffixes
from skyfix.llm.common import fresh, sent, table, written

#: A document is rejected if its best language has a lower mean probability over its words than this.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: neither `und` (null or empty texts, texts without a letter) nor below LEAST_LANGUAGE_SCORE.

    Judged row by row on the text alone: repeated rows go or stay together; an empty table stays empty."""
    label, score = fresh(docs, "label"), fresh(docs, "score_of_label")
    judged = langid.judged(docs, langid.fit(docs), "text", label, score)
    return judged.where((F.col(label) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id (rows with an id before those without); of equal rows any one. Documents without words are in no group and stay."""
    joined = ngramjoin.similar(docs, tagged=True).where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.max("leads").alias("leads"), F.count(F.lit(1)).alias("rows"))
    joined = joined.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), "leads", "rows")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("gone_digest"))
    kept = docs.join(sent(joined.where("not leads").select("gone_id", "gone_digest"), "duplicates"), same, "left_anti")
    again = sent(joined.where("leads and rows > 1").select("gone_id", "gone_digest"), "repeated")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of smaller id are cut; a document that was nothing else goes. Documents with shorter or no texts stay as they are."""
    return suffixes.without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go. Those without words, and all if it has no items, stay; rows are judged by their text alone."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    found = decontam.decontaminate(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    found = sent(found.select(F.col("doc_id").alias("gone_digest")).distinct(), "contaminated")
    return docs.join(found, digest == F.col("gone_digest"), "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as ids: with n_tokens, ids_sha256 and decoded_sha256 (which replace columns of these names). A null text is the empty one; rows keep their number."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe.appended_ids(docs.drop(*[c for c in docs.columns if c.lower() in made]), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("contamination", contamination), ("encoded", encoded)]

#: No SQL: a trained model and a merge list decide rows. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
