"""The ingestion job: clean, profile, then publish or reject."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.operators import profile as P
from tidewater.operators.prepare import choose_split
from tidewater.plans.base import query
from tidewater.plans.cleaning import CLEAN_SQL, raw_labelled
from tidewater.session import checkpointed
from tidewater.sources import catalog
from tidewater.sources.files import read_file


@dataclass(frozen=True)
class IngestResult:
    """Outcome of one run; `path` is None when the table was rejected."""

    dataset_id: str
    path: str | None
    report_path: str
    rows: int
    columns: int
    quality_score: float
    quality_passed: bool
    issues: list[dict]


def dataset_id(spark: SparkSession, root: str, name: str) -> str:
    """The id a new upload of this name gets: its slug, or the next free number of it."""
    known = catalog.read_catalog(spark, root).select("dataset_id").unionByName(
        catalog.read_validations(spark, root).select("dataset_id")
    )
    named = spark.createDataFrame([(0, name)], "n long, name string")
    return C.build_dataset_ids(named, "name", "n", taken=known).first()["dataset_id"]


def ingest(
    source: DataFrame,
    root: str,
    name: str,
    timestamp: str,
    config: C.CleanConfig = C.SENTIMENT,
    split: str | None = None,
) -> IngestResult:
    """Clean a table, profile the result, and publish it if the gate opens.

    The cleaned table is written once; the profile reads it back, so a lost executor costs a re-read
    and never a second cleaning run. Publishing is a catalog row that points at what was written. A name that was
    uploaded before, passed or not, gets the next free number, and both stay readable.
    """
    spark = source.sparkSession
    identity = dataset_id(spark, root, name)
    if split is not None:
        source = choose_split(source, split)
    staged = f"{root}/staged/{identity}/{re.sub(r'[^0-9]', '', timestamp)}"
    cleaned = C.clean(source, config)
    cleaned.write.mode("overwrite").parquet(f"{staged}/data")
    stored = spark.read.schema(cleaned.schema).parquet(f"{staged}/data")

    report_path = f"{staged}/quality_report"
    reported = P.report(stored, config.quality_rules, config.quality_threshold)
    reported.withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").json(report_path)
    row = spark.read.schema(reported.schema).json(report_path).first()
    issues = [i.asDict() for i in row["issues"]]
    status = "passed" if row["passed"] else "failed"

    path = None
    if row["passed"]:
        path = catalog.register(
            stored, root, identity, timestamp, config.output_text, config.output_label, path=f"{staged}/data",
            written=True, quality_status=status, quality_score=row["quality_score"], report_path=report_path,
        )
    catalog.record_validation(
        spark, root, timestamp, issues, dataset_id=identity, dataset_name=name, status=status,
        quality_score=row["quality_score"], report_path=report_path,
    )
    return IngestResult(
        identity, path, report_path, row["total_rows"], row["total_columns"], row["quality_score"], row["passed"], issues
    )


def ingest_file(
    spark: SparkSession,
    file_path: str,
    root: str,
    timestamp: str,
    name: str | None = None,
    multi_line: bool | None = None,
    **options,
) -> IngestResult:
    """`ingest` for a csv, json, jsonl or parquet file; the name defaults to the file's."""
    source = read_file(spark, file_path, multi_line=multi_line)
    return ingest(source, root, name or file_path.rsplit("/", 1)[-1], timestamp, **options)


@query(
    "clean_and_gate",
    f"""WITH {CLEAN_SQL} SELECT text, label FROM cleaned WHERE (
      SELECT 100 - (count(DISTINCT label) = 1)::INT - (count(DISTINCT text) = 1)::INT >= 80 FROM cleaned)""",
)
def clean_and_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned rows under the gate: all of them when the report passes, none when it does not."""
    cleaned = checkpointed(C.clean(raw_labelled(spark, folder), C.SENTIMENT))
    report = P.report(cleaned, C.SENTIMENT.quality_rules, C.SENTIMENT.quality_threshold)
    return cleaned.where(report.select("passed").scalar())
