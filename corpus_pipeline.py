"""A cleaning pipeline for training data, as a list of stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Rows
that a stage drops are gone for those after it:

* language: documents whose language is not found (no letters, or no language clearly best);
* near_copies: of documents linked by five-word shingles of similarity 0.8 and more the one with the
  least id stays;
* decontamination: documents into which a benchmark item leaks;
* personal_data: no document; personal data in texts is replaced by its kind, in brackets;
* encoding: no document; returns the piece ids of each text, and whether they decode to it.

An empty table passes through as an empty table. Null texts are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import work_folder
from wordloom.llm.decontaminate import keep_clean
from wordloom.llm.langid import keep_identified
from wordloom.llm.ngram_join import keep_first
from wordloom.llm.pii import redact_texts
from wordloom.llm.sp_codec import encode_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_texts(docs, length_col="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = work_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
