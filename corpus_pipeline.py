"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens.

Defined results, for run() and each stage: null, empty and letter-free texts go with the first stage, as they are in no
language; rows are judged one by one, also those that repeat a doc_id; of a group of linked documents the rows of the
least doc_id stay, and of equal rows of one doc_id one; a row with a null doc_id is linked with nothing; texts are
read whole; all but the last stage keep all columns, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.llm import bpe_codec, decontaminate, jaccard_join, language_id, pii
from tomewise.llm.queries import bpe_paths
from tomewise.llm.shared import Scratch, crc_of_id

LEAST_SCORE = 0.3  # a document whose best language scores less is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; learns from the fold that the query learns from."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), crc_of_id() % 4 != 2)
    return language_id.keep_known(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents, that of the least doc_id."""
    found = Scratch(spark, "near").table(jaccard_join.join(docs, with_sets=True).select("doc_id", "component_id", F.col("fp").alias("_set")), "found")
    copies = found.where("component_id <> doc_id")
    # where a doc_id has several rows, the set tells which of them is meant, and of equal ones the first stays
    many = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    single = docs.join(many, "doc_id", "left_anti").join(copies.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    packed = docs.join(many, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    several = jaccard_join.fingerprints(packed).withColumnRenamed("fp", "_set").join(copies.select("doc_id", "_set"), ["doc_id", "_set"], "left_anti")
    several = several.groupBy("doc_id", "_set").agg(F.min("_row").alias("_row")).select("_row.*")
    return single.unionByName(several)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data; no document goes."""
    return pii.redact(docs, pii.fit(docs.select("doc_id", "text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe_codec.query(docs, *bpe_paths())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The model stages can't be written in SQL; tests hold the pipeline against plain versions of its stages on a planted corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
