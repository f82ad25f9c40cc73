"""The corpus pipeline: documents through five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Between
stages the rows are written as Parquet to the folder in spark.checkpoint.dir and read again.

Documents with null or empty texts go with the first stage, as texts of too few words. Rows repeated under one id stay or
go together. Ties go to the lesser id. An empty table gives an empty result.
Long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.llm import line_dedup, minhash, packing, quality_classifier, quality_rules
from mediaflow.llm.bpe import tokenizer_path
from mediaflow.llm.common import cut


#: Rows that Spark hands to a Python worker at once. Texts are long, and after many stages an executor's memory is mostly the JVM's.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For the session's stages that run Python, from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, learnt on what the rules kept, scores 0.3 or more."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs, model, column="__score__")
    return scored.where(F.col("__score__") >= quality_classifier.THRESHOLD).drop("__score__")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another occurrence stands for; those with nothing but white space left go."""
    return line_dedup.dedup(docs, drop_emptied=False, drop_blank=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at 0.8 on 5-word shingles."""
    small_batches(spark)
    return minhash.keep_representatives(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("minhash", near_duplicates), ("packing", pack)]

#: Classifier and packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
