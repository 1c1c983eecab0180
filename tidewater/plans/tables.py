"""Queries over versioned tables, free SQL and registered functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.ordering import last_known
from tidewater.plans.base import query, table
from tidewater.plans.preparation import WORDS_SQL
from tidewater.sources import catalog, files, sql, versioned

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")

# Orders as a versioned table: one version per month, every January replacing the state.
MONTH = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1"
COMMITS_SQL = f"""data AS (SELECT {MONTH} AS version, o_orderkey, o_totalprice, o_orderdate FROM orders),
commits AS (SELECT version, max(o_orderdate) AS commit_ts, CASE WHEN version % 12 = 0 THEN 'overwrite' ELSE 'append' END AS mode,
  count(*) AS num_rows FROM data GROUP BY version)"""


def monthly(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    data = table(spark, folder, "orders").select(
        F.expr(MONTH).cast("long").alias("version"), "o_orderkey", "o_totalprice", "o_orderdate"
    )
    commits = data.groupBy("version").agg(F.max("o_orderdate").alias("commit_ts"), F.count("*").alias("num_rows"))
    return data, commits.withColumn("mode", F.when(F.col("version") % 12 == 0, "overwrite").otherwise("append"))


@query(
    "read_latest_version",
    f"WITH {COMMITS_SQL} SELECT o_orderkey, o_totalprice FROM data WHERE version >= (SELECT max(version) FROM commits WHERE mode = 'overwrite')",
)
def read_latest_version(spark: SparkSession, folder: str) -> DataFrame:
    data, commits = monthly(spark, folder)
    return versioned.snapshot(data, commits, columns=["o_orderkey", "o_totalprice"])


@query("read_given_version", f"WITH {COMMITS_SQL} SELECT o_orderkey, version FROM data WHERE version BETWEEN 24 AND 30")
def read_given_version(spark: SparkSession, folder: str) -> DataFrame:
    data, commits = monthly(spark, folder)
    return versioned.snapshot(data, commits, version=30, columns=["o_orderkey", "version"])


@query(
    "time_travel",
    f"""WITH {COMMITS_SQL}, seen AS (SELECT * FROM commits WHERE commit_ts <= TIMESTAMP '1998-06-15 12:00:00')
    SELECT o_orderkey, version FROM data WHERE version IN (SELECT version FROM seen)
      AND version >= (SELECT max(version) FROM seen WHERE mode = 'overwrite')""",
)
def time_travel(spark: SparkSession, folder: str) -> DataFrame:
    data, commits = monthly(spark, folder)
    return versioned.snapshot(data, commits, timestamp="1998-06-15 12:00:00", columns=["o_orderkey", "version"])


@query("version_history", f"WITH {COMMITS_SQL} SELECT version, commit_ts, mode, num_rows FROM commits ORDER BY version DESC LIMIT 10")
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    return versioned.history(monthly(spark, folder)[1])


@query(
    "removable_versions",
    f"""WITH {COMMITS_SQL} SELECT version, commit_ts, mode, num_rows FROM commits WHERE version < (
      SELECT max(version) FROM commits WHERE mode = 'overwrite' AND commit_ts <= TIMESTAMP '2000-02-03' - INTERVAL 168 HOUR)""",
)
def removable_versions(spark: SparkSession, folder: str) -> DataFrame:
    return versioned.removable(monthly(spark, folder)[1], "2000-02-03 00:00:00")


def _per_table_sql(columns: str) -> str:
    """One row per table; `{t}` is the table, `{n_columns}` its number of columns."""
    width = "(SELECT count(*)::INT FROM information_schema.columns WHERE table_name = '{t}')"
    rows = [f"SELECT {columns} FROM {{t}}".replace("{n_columns}", width).replace("{t}", name) for name in TABLES]
    return "\nUNION ALL ".join(rows)


@query(
    "table_statistics",
    _per_table_sql("'{t}' AS table_name, count(*) AS num_rows, {n_columns} AS num_columns, true AS has_files, 0::BIGINT AS version"),
)
def table_statistics(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        versioned.statistics(table(spark, folder, name), files.list_files(spark, f"{folder}/{name}.parquet"), 0).withColumn(
            "table_name", F.lit(name)
        )
        for name in TABLES
    ]
    out = reduce(DataFrame.unionByName, parts)
    # SQL cannot see the files, so only that there are some is compared.
    return out.select("table_name", "num_rows", "num_columns", (F.col("size_bytes") > 0).alias("has_files"), "version")


@query(
    "dataset_catalog",
    "WITH langs AS (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) AS splits FROM documents)\n"
    + _per_table_sql(
        "'{t}' AS dataset_id, count(*) AS num_rows, {n_columns} AS num_columns, true AS has_files, "
        "CASE WHEN '{t}' = 'documents' THEN (SELECT splits FROM langs) ELSE 'train' END AS splits"
    ),
)
def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    out = catalog.describe_datasets(spark, {name: f"{folder}/{name}.parquet" for name in TABLES}, split="lang")
    return out.select(
        "dataset_id", "num_rows", "num_columns", (F.col("size_mb") > 0).alias("has_files"),
        F.array_join("splits", ",").alias("splits"),
    )


@query("query_path_default", "SELECT * FROM orders")
def query_path_default(spark: SparkSession, folder: str) -> DataFrame:
    return sql.query_path(spark, f"{folder}/orders.parquet")


@query("query_path_sql", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part WHERE p_size >= 10 GROUP BY p_brand")
def query_path_sql(spark: SparkSession, folder: str) -> DataFrame:
    text = "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM {{path}} WHERE p_size >= :least GROUP BY p_brand"
    return sql.query_path(spark, f"{folder}/part.parquet", text, least=10)


@query(
    "asof_last_signup",
    """SELECT event_id, max(CASE WHEN event_type = 'signup' THEN ts END) OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""",
)
def asof_last_signup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    signup = F.when(F.col("event_type") == "signup", F.col("ts"))
    out = last_known(rows, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), signup, "last_signup")
    return out.select("event_id", "last_signup")


@query("registered_function", f"SELECT lang, sum(len({WORDS_SQL}))::BIGINT AS n_words FROM documents GROUP BY lang")
def registered_function(spark: SparkSession, folder: str) -> DataFrame:
    """An Arrow function registered by name and called from SQL."""

    @F.pandas_udf("long")
    def count_words(texts: pd.Series) -> pd.Series:
        return texts.str.split().str.len()

    sql.Functions(spark).register("count_words", count_words)
    sql.register_views(spark, {"documents": table(spark, folder, "documents")})
    return sql.run(spark, "SELECT lang, sum(count_words(text)) AS n_words FROM documents GROUP BY lang")


@query(
    "batched_rows",
    f"SELECT doc_id, len({WORDS_SQL}) AS n_words, length(text) AS n_chars FROM documents",
)
def batched_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A pandas function over batches that drops the text column and adds two."""

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": batch["doc_id"], "n_words": batch["text"].str.split().str.len(), "n_chars": batch["text"].str.len()
        })

    rows = table(spark, folder, "documents").select("doc_id", "text")
    return sql.map_batches(rows, measure, "doc_id long, n_words long, n_chars long")


# Free SQL, one text per shape; the same text runs on both sides.
SHAPES = {
    "sql_inner_join": """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""",
    "sql_left_join": """SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS n_orders FROM customer
      LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_mktsegment""",
    "sql_full_join": """SELECT coalesce(a.k, b.k) AS k, a.n AS few, b.n AS most FROM
      (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey) a FULL OUTER JOIN
      (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey) b ON a.k = b.k""",
    "sql_semi_anti": """SELECT 'semi' AS kind, c_custkey FROM customer WHERE EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
      UNION ALL SELECT 'anti', c_custkey FROM customer WHERE NOT EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "sql_range_join": """SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders
      JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 90 DAY
      AND l_extendedprice < o_totalprice GROUP BY o_orderpriority""",
    "sql_aggregate_distinct": """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
      round(avg(l_quantity), 6) AS avg_qty, round(stddev_samp(l_quantity), 6) AS sd, min(l_shipdate) AS first_ship
      FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10""",
    "sql_rollup": """SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS g, round(sum(l_quantity), 2) AS qty
      FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
      GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "sql_window": """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        rank() OVER w AS r, round(l_extendedprice - lag(l_extendedprice) OVER w, 4) AS step,
        round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber
          ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS around
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber)""",
    "sql_top_per_group": """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER
      (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS n FROM lineitem) t WHERE n <= 3""",
    "sql_top_k_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sql_set_operations": """SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
      UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') b
      UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') c""",
    "sql_strings": """SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS n, replace(p_brand, 'Brand#', 'B') AS brand,
      substring(p_type, 1, 3) AS prefix, concat_ws('|', p_brand, p_type) AS joined, p_name LIKE '%red%' AS has_red FROM part""",
    "sql_dates": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, extract(year FROM o_orderdate) AS y, count(*) AS n
      FROM orders GROUP BY date_trunc('month', o_orderdate), extract(year FROM o_orderdate)""",
    "sql_math": """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(exp(p_size / 10.0), 4) AS e, round(ln(p_retailprice), 6) AS l,
      greatest(p_size, 25) AS g, abs(p_size - 25) AS a, floor(p_retailprice / 7) AS f FROM part""",
}
# Shapes whose function names differ between the two dialects.
DIALECT = {
    "sql_arrays_json": (
        """SELECT vec_id, size(embedding) AS n, CAST(array_contains(array(1, 3, 5), label) AS INT) AS odd,
          round(CAST(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x) AS DOUBLE), 5) AS norm FROM embeddings""",
        """SELECT vec_id, len(embedding)::INT AS n, list_contains([1, 3, 5], label)::INT AS odd,
          round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 5) AS norm FROM embeddings""",
    ),
    "sql_json": (
        """SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k,
          max(from_json(props, 'k BIGINT').k) AS top FROM events GROUP BY event_type""",
        """SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k,
          max(json_extract_string(props, '$.k')::BIGINT) AS top FROM events GROUP BY event_type""",
    ),
}


def _shape(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sql.register_views(spark, {name: table(spark, folder, name) for name in TABLES if name in text})
        return sql.run(spark, text)

    return run


for _name, _text in SHAPES.items():
    query(_name, _text)(_shape(_text))
for _name, (_spark_text, _other) in DIALECT.items():
    query(_name, _other)(_shape(_spark_text))
