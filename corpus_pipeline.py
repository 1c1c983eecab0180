"""From documents to token identifiers: toxic texts go, then copies, then near copies; the rest is mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import exact, mixing, simhash, toxicity
from tidewater.llm.common import documents, shared_folder
from tidewater.llm.queries import SIMHASH, TOXIC_AT, digests, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below the threshold of op6, with a model fitted on the labels of the folder."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, folder), TOXIC_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest identifier."""
    return exact.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest identifier."""
    return simhash.drop_near_duplicates(docs, **SIMHASH)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them, shard after shard, shuffled within."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for each row of the mix."""
    return digests(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Models, SimHash and the mix's permutation are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to the documents of `folder`; each writes a table in the shared folder that the next one reads."""
    docs = documents(spark, folder)
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
