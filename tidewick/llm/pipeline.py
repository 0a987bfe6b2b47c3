"""A corpus pipeline of five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents. Each row that the pipeline returns is a document with its weight and the copies to take.

Defined results: a null or empty text is classified as an empty one, has no lines to lose, is near nothing, holds no benchmark item, and goes at the
mixing, which draws tokens. A null doc_id is linked with nothing; its row stays as far as its text does. Repeated rows: each is classified; of a line on many
sites the rows with the smallest doc_id keep it; rows of equal doc_id and text become one at the near duplicates. Of a group of near duplicates the
smallest doc_id stays. Of an empty table the result is empty. Columns beside `COLUMNS` are dropped at the first stage. Very long
texts are worked on whole. The tables of the stages stay in the shared folder: the result reads the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, mixing, near_dup, quality_classifier
from .folders import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, labels).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go from all documents but one; a document that has no other lines goes."""
    out = line_dedup.dedup_lines(docs).where("lines_removed = 0 or lines_removed < line_count")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near_dup.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, with the copies to take of each."""
    return mixing.mix_sources(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture)]

ORACLE_SQL = None


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str) -> list[DataFrame]:
    """What each stage returns, written to folder/0 and so on."""
    out = []
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run_stages(spark, docs, sf_dir, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")[-1]
