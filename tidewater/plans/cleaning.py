"""Queries over the cleaning and profiling operators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import clean as C
from tidewater.operators import profile as P
from tidewater.operators.profile_state import StoredProfile, add_batch
from tidewater.plans.base import query, table
from tidewater.session import ensure_checkpoint_dir

WS = X.WHITESPACE_CHARS

# Raw input of most queries here: documents with a label where one was given, in mixed spelling.
RAW_SQL = f"""
raw AS (
  SELECT d.doc_id, d.text,
         CASE WHEN l.quality = 1 THEN 'Positive' WHEN l.toxic = 1 THEN 'NEGATIVE'
              WHEN l.quality = 0 THEN 'None' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
stripped AS (SELECT doc_id, trim(text, '{WS}') AS text, label FROM raw)"""
LABEL_SQL = """CASE WHEN lower(label) IN ('positive', 'negative', 'unspecified') THEN lower(label) END"""
AUTO_SQL = f"""coalesce({LABEL_SQL},
  CASE WHEN contains(lower(text), 'good') OR contains(lower(text), 'great') OR contains(lower(text), 'excellent')
         OR contains(lower(text), 'love') OR contains(lower(text), 'amazing') THEN 'positive'
       WHEN contains(lower(text), 'bad') OR contains(lower(text), 'terrible') OR contains(lower(text), 'awful')
         OR contains(lower(text), 'hate') OR contains(lower(text), 'poor') THEN 'negative'
       ELSE 'unspecified' END)"""
CLEAN_SQL = f"""{RAW_SQL},
cleaned AS (SELECT DISTINCT text, {AUTO_SQL} AS label FROM stripped WHERE length(text) > 0)"""


def raw_labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    label = (
        F.when(F.col("quality") == 1, "Positive").when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 0, "None")
    )
    return (
        table(spark, folder, "documents")
        .join(labels, "doc_id", "left")
        .select("doc_id", "text", label.alias("label"))
    )


@query(
    "clean_strip_and_drop_missing",
    f"""WITH {RAW_SQL}
    SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM stripped WHERE length(text) > 0""",
)
def strip_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    out = C.drop_missing_text(C.strip_text(raw_labelled(spark, folder), "text"), "text")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "clean_normalise_labels",
    f"""WITH {RAW_SQL}
    SELECT doc_id, CASE WHEN lower(label) NOT IN ('none', 'nan', '') THEN lower(label) END AS lowered,
           CASE WHEN label NOT IN ('none', 'nan', '') THEN label END AS kept_case,
           CASE WHEN lower(label) = 'positive' THEN 'positive' END AS allowed FROM raw""",
)
def normalise(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_labelled(spark, folder).select(
        "doc_id", F.col("label").alias("lowered"), F.col("label").alias("kept_case"), F.col("label").alias("allowed")
    )
    out = C.normalise_labels(raw, "lowered")
    out = C.normalise_labels(out, "kept_case", lowercase=False)
    return C.normalise_labels(out, "allowed", allowed=("Positive",))


@query(
    "clean_auto_label",
    f"""WITH {RAW_SQL} SELECT doc_id, {AUTO_SQL} AS label FROM stripped""",
)
def auto_label(spark: SparkSession, folder: str) -> DataFrame:
    raw = C.normalise_labels(raw_labelled(spark, folder), "label", allowed=C.SENTIMENT.allowed_labels)
    out = C.auto_label(raw, "text", "label", C.SENTIMENT.label_rules, C.SENTIMENT.default_label)
    return out.select("doc_id", "label")


@query(
    "clean_drop_missing_label",
    f"""WITH {RAW_SQL}
    SELECT doc_id, lower(label) AS label FROM raw WHERE lower(label) NOT IN ('none', 'nan', '')""",
)
def drop_missing_label(spark: SparkSession, folder: str) -> DataFrame:
    config = C.CleanConfig(strip_text=False, drop_missing_text=False, drop_duplicates=False)
    return C.clean(raw_labelled(spark, folder), config, keep=("doc_id",)).select("doc_id", "label")


@query(
    "clean_drop_duplicates",
    f"""WITH {RAW_SQL},
    normal AS (SELECT doc_id, text, CASE WHEN lower(label) NOT IN ('none', 'nan', '') THEN lower(label) END AS label FROM raw)
    SELECT min(doc_id) AS doc_id, md5(text) AS digest, label FROM normal GROUP BY text, label""",
)
def drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    config = C.CleanConfig(strip_text=False, drop_missing_label=False)
    out = C.clean(raw_labelled(spark, folder), config, keep=("doc_id",))
    return out.select("doc_id", F.md5("text").alias("digest"), "label")


@query(
    "clean_full",
    f"""WITH {CLEAN_SQL}
    SELECT md5(text) AS digest, length(text) AS n_chars, label FROM cleaned""",
)
def clean_full(spark: SparkSession, folder: str) -> DataFrame:
    out = C.clean(raw_labelled(spark, folder), C.SENTIMENT)
    return out.select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "label")


@query(
    "clean_full_with_overrides",
    """WITH kept AS (SELECT text, CASE WHEN contains(lower(text), 'the') THEN 'english' END AS label FROM documents)
    SELECT label, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM kept WHERE label IS NOT NULL GROUP BY label""",
)
def clean_overrides(spark: SparkSession, folder: str) -> DataFrame:
    config = C.CleanConfig(default_label=None).with_overrides(
        label_rules=[C.LabelRule("English", ("THE",))], strip_text=False, drop_duplicates=False
    )
    out = C.clean(table(spark, folder, "documents").select("doc_id", "text"), config)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "dataset_ids",
    r"""WITH slugs AS (
      SELECT doc_id, CASE WHEN s = '' THEN 'dataset' ELSE s END AS slug FROM (
        SELECT doc_id, trim(regexp_replace(lower(source || ' / ' || lang || '!'), '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS s
        FROM documents)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM slugs)
    SELECT doc_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS dataset_id FROM numbered""",
)
def dataset_ids(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit(" / "), F.col("lang"), F.lit("!")).alias("name")
    )
    return C.build_dataset_ids(names, "name", "doc_id").select("doc_id", "dataset_id")


PCT = "round_even({part} / {whole} * 100, 2)"

# A numeric table with defects that follow from its values: nulls, repeats, out-of-range values, a constant.
DEFECTS_SQL = """
defects AS (
  SELECT CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount,
         CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN '' ELSE l_returnflag END AS flag,
         CASE WHEN l_tax > 0.03 THEN 'x' END AS constant, l_extendedprice * l_quantity AS amount
  FROM lineitem)"""
RULES = {"discount": {"min": 0.01, "max": 0.5}, "quantity": {"min": 1, "max": 40}, "absent": {"min": 0}}


def defects(spark: SparkSession, folder: str, part: Column | None = None) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return (lines if part is None else lines.where(part)).select(
        F.when(~(F.col("l_quantity") > 45), F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_tax") > 0.03, "x").alias("constant"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("amount"),
    )


NUMERIC = ("quantity", "discount", "amount")
MEASURED_SQL = f"""{DEFECTS_SQL},
n AS (SELECT count(*) AS n FROM defects),
dup AS (SELECT (SELECT n FROM n) - count(*) AS dups FROM (SELECT DISTINCT * FROM defects)),
quart AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in NUMERIC)} FROM defects),
bounds AS (SELECT {", ".join(f"{c}_1 - 1.5 * ({c}_3 - {c}_1) AS {c}_lo, {c}_3 + 1.5 * ({c}_3 - {c}_1) AS {c}_hi" for c in NUMERIC)} FROM quart),
counts AS (
  SELECT count(*) FILTER (WHERE quantity IS NULL) AS quantity_null, count(*) FILTER (WHERE discount IS NULL) AS discount_null,
         count(*) FILTER (WHERE flag IS NULL) AS flag_null, count(*) FILTER (WHERE constant IS NULL) AS constant_null,
         count(*) FILTER (WHERE amount IS NULL) AS amount_null,
         count(*) FILTER (WHERE flag = '') AS flag_empty, count(*) FILTER (WHERE constant = '') AS constant_empty,
         {", ".join(f"coalesce(min({c}) = max({c}), false) AS {c}_const" for c in ("quantity", "discount", "flag", "constant", "amount"))},
         coalesce(bool_or(discount < 0.01), false) AS discount_min, coalesce(bool_or(discount > 0.5), false) AS discount_max,
         coalesce(bool_or(quantity < 1), false) AS quantity_min, coalesce(bool_or(quantity > 40), false) AS quantity_max,
         {", ".join(f"count(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi) AS {c}_out" for c in NUMERIC)}
  FROM defects, bounds),
m AS (SELECT * FROM n, dup, bounds, counts)"""


def _long_sql() -> str:
    cells = [("uniqueness", None, "duplicate_count", "dups"), ("uniqueness", None, "duplicate_pct", PCT.format(part="dups", whole="n"))]
    for c in ("quantity", "discount", "flag", "constant", "amount"):
        cells.append(("completeness", c, "missing_count", f"{c}_null"))
        cells.append(("completeness", c, "missing_pct", PCT.format(part=f"{c}_null", whole="n")))
        cells.append(("consistency", c, "constant", f"{c}_const::INT"))
        if c in ("flag", "constant"):
            cells.append(("validity", c, "empty_count", f"{c}_empty"))
        if c in ("discount", "quantity"):
            cells.append(("validity", c, "min_broken", f"{c}_min::INT"))
            cells.append(("validity", c, "max_broken", f"{c}_max::INT"))
        if c in NUMERIC:
            cells.append(("outliers", c, "lower_bound", f"round({c}_lo, 6)"))
            cells.append(("outliers", c, "upper_bound", f"round({c}_hi, 6)"))
            cells.append(("outliers", c, "outlier_count", f"{c}_out"))
            cells.append(("outliers", c, "outlier_pct", PCT.format(part=f"{c}_out", whole="n")))
    rows = [
        f"SELECT '{check}' AS \"check\", {repr(col) if col else 'NULL::VARCHAR'} AS \"column\", '{metric}' AS metric, "
        f"({value})::DOUBLE AS value FROM m"
        for check, col, metric, value in cells
    ]
    return f"WITH {MEASURED_SQL}\n" + "\nUNION ALL ".join(rows)


@query("quality_check_rows", _long_sql())
def quality_check_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.check_rows(defects(spark, folder), RULES)
    return rows.withColumn("value", F.round("value", 6))


@query("quality_check_rows_of_batches", _long_sql())
def quality_check_rows_of_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same profile from three batches, each read when it comes and never again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/profile-{uuid4().hex}"
    for batch in range(3):
        add_batch(defects(spark, folder, F.col("l_linenumber") % 3 == batch), path, f"b{batch}")
    return StoredProfile(spark, path, RULES).check_rows().withColumn("value", F.round("value", 6))


def _issues_sql() -> str:
    columns = ("quantity", "discount", "flag", "constant", "amount")
    cells = []
    for c in columns:
        pct = PCT.format(part=f"{c}_null", whole="n")
        cells.append((f"{pct} > 5", c, "completeness", f"CASE WHEN {pct} > 20 THEN 'high' ELSE 'medium' END",
                      f"'{c} has ' || {pct} || '% missing values'"))
    dup = PCT.format(part="dups", whole="n")
    cells.append((f"{dup} > 1", None, "uniqueness", "'medium'", f"{dup} || '% duplicate rows found'"))
    for c in ("flag", "constant"):
        cells.append((f"{c}_empty > 0", c, "validity", "'low'", f"'{c} has ' || {c}_empty || ' empty strings'"))
    for c, bound, word, value in (("discount", "min", "below", "0.01"), ("discount", "max", "above", "0.5"),
                                  ("quantity", "min", "below", "1"), ("quantity", "max", "above", "40")):
        cells.append((f"{c}_{bound}", c, "validity", "'high'", f"'{c} has values {word} {bound} {value}'"))
    for c in columns:
        cells.append((f"{c}_const", c, "consistency", "'low'", f"'{c} has only one unique value'"))
    for c in NUMERIC:
        pct = PCT.format(part=f"{c}_out", whole="n")
        cells.append((f"{pct} > 5", c, "outliers", "'medium'", f"'{c} has ' || {pct} || '% outliers'"))
    rows = [
        f"SELECT {i} AS o, {repr(col) if col else 'NULL::VARCHAR'} AS \"column\", '{kind}' AS type, {sev} AS severity, "
        f"{msg} AS message FROM m WHERE {cond}"
        for i, (cond, col, kind, sev, msg) in enumerate(cells)
    ]
    return f"WITH {MEASURED_SQL}, issues AS (" + "\nUNION ALL ".join(rows) + ")"


@query(
    "quality_issues",
    _issues_sql() + ' SELECT (row_number() OVER (ORDER BY o))::INT AS seq, "column", type, severity, message FROM issues',
)
def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    return P.issue_rows(P.report(defects(spark, folder), RULES))


@query(
    "quality_report_numeric",
    _issues_sql() + f""", kinds AS (SELECT count(*) FILTER (WHERE type = 'validity') AS v,
      count(*) FILTER (WHERE type = 'consistency') AS c, count(*) FILTER (WHERE type = 'completeness') AS k FROM issues),
    s AS (SELECT *, quantity_null + discount_null + flag_null + constant_null + amount_null AS missing,
          {PCT.format(part="dups", whole="n")} AS dup_pct FROM m, kinds)
    SELECT n AS total_rows, missing AS missing_count, dups AS duplicate_count, dup_pct AS duplicate_pct,
           v::INT AS validity_issues, c::INT AS consistency_issues,
           round_even(greatest(0, 30.0::DOUBLE - missing / 100) + greatest(0, 25.0::DOUBLE - dup_pct) + greatest(0, 25.0::DOUBLE - v)
                 + greatest(0, 20.0::DOUBLE - c), 2) AS quality_score,
           round_even(greatest(0, 30.0::DOUBLE - missing / 100) + greatest(0, 25.0::DOUBLE - dup_pct) + greatest(0, 25.0::DOUBLE - v)
                 + greatest(0, 20.0::DOUBLE - c), 2) >= 70 AND k = 0 AND dup_pct < 1 AND v = 0 AS passed
    FROM s""",
)
def quality_report_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return P.report(defects(spark, folder), RULES).select(
        "total_rows", "missing_count", "duplicate_count", "duplicate_pct",
        "validity_issues", "consistency_issues", "quality_score", "passed",
    )


@query(
    "quality_gate_cleaned",
    f"""WITH {CLEAN_SQL}, s AS (
      SELECT count(*) AS n, (count(DISTINCT label) = 1)::INT + (count(DISTINCT text) = 1)::INT AS c FROM cleaned)
    SELECT n AS total_rows, round_even(80.0::DOUBLE + (20.0::DOUBLE - c), 2) AS quality_score,
           80.0::DOUBLE + (20.0::DOUBLE - c) >= 80 AS passed FROM s""",
)
def quality_gate_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = C.clean(raw_labelled(spark, folder), C.SENTIMENT)
    out = P.report(cleaned, C.SENTIMENT.quality_rules, C.SENTIMENT.quality_threshold)
    return out.select("total_rows", "quality_score", "passed")


@query("quality_report_raw")
def quality_report_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The full nested report of the uncleaned documents."""
    return P.report(table(spark, folder, "documents"), C.SENTIMENT.quality_rules, C.SENTIMENT.quality_threshold)
