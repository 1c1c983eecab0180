"""Queries over the registry operators. Orders stand in for versions and jobs of their customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import registry as R
from tidewater.plans.base import query, table


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("job_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS id, o_custkey AS parent_id, o_orderpriority AS job_type, o_orderstatus AS status,
  o_orderdate AS created_at, o_totalprice AS price FROM orders)"""


@query("get_by_id", f"WITH {JOBS_SQL} SELECT * FROM jobs WHERE id = 77")
def get_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return R.get(jobs(spark, folder), id=77)


@query("get_by_compound_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 0 AND l_linenumber = 4")
def get_by_compound_key(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.get(lines, l_orderkey=0, l_linenumber=4)


@query("paged_list", f"WITH {JOBS_SQL} SELECT * FROM jobs ORDER BY id LIMIT 50 OFFSET 200")
def paged_list(spark: SparkSession, folder: str) -> DataFrame:
    return R.page(jobs(spark, folder), ["id"], 200, 50)


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as incoming rows for orders, several per order, some for orders not yet listed."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.when(F.col("l_quantity") > 40, F.col("l_orderkey") + 100_000_000).otherwise(F.col("l_orderkey")).alias("id"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("seen_at"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


ARRIVALS_SQL = """arrivals AS (SELECT CASE WHEN l_quantity > 40 THEN l_orderkey + 100000000 ELSE l_orderkey END AS id,
  l_extendedprice AS price, l_shipdate AS seen_at, l_linenumber AS line, l_partkey AS part FROM lineitem),
newest AS (SELECT id, price, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, line DESC, part DESC, price DESC) AS n
  FROM arrivals) WHERE n = 1)"""


def newest_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("seen_at"), F.desc("line"), F.desc("part"), F.desc("price")]
    empty = arrivals(spark, folder).select("id", "price", "seen_at", "line", "part")
    return R.top_per_group(empty, ["id"], order, 1, "_n").select("id", "price", "seen_at")


@query(
    "upsert",
    f"""WITH {ARRIVALS_SQL} SELECT id, price, seen_at FROM newest
    UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey NOT IN (SELECT id FROM newest)""",
)
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("seen_at"), F.desc("line"), F.desc("part"), F.desc("price")]
    existing = jobs(spark, folder).select("id", "price")
    return R.upsert(existing, arrivals(spark, folder), ["id"], order).select("id", "price", "seen_at")


@query(
    "update_columns",
    f"""WITH {ARRIVALS_SQL} SELECT o_orderkey AS id, o_orderstatus AS status,
      CASE WHEN n.id IS NOT NULL THEN n.price ELSE o_totalprice END AS price
    FROM orders LEFT JOIN newest n ON n.id = o_orderkey""",
)
def update_columns(spark: SparkSession, folder: str) -> DataFrame:
    changes = newest_arrivals(spark, folder).select("id", "price")
    return R.update(jobs(spark, folder).select("id", "status", "price"), changes, ["id"])


@query(
    "update_not_found",
    f"WITH {ARRIVALS_SQL} SELECT id, price, seen_at FROM newest WHERE id NOT IN (SELECT o_orderkey FROM orders)",
)
def update_not_found(spark: SparkSession, folder: str) -> DataFrame:
    return R.not_found(jobs(spark, folder), newest_arrivals(spark, folder), ["id"])


@query(
    "delete_by_key",
    """SELECT o_orderkey AS id, o_totalprice AS price FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def delete_by_key(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return R.delete(jobs(spark, folder).select("id", "price"), doomed, ["id"])


@query(
    "latest_version",
    """SELECT c_custkey AS parent_id, id, created_at FROM customer LEFT JOIN (
      SELECT o_custkey, o_orderkey AS id, o_orderdate AS created_at,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
    ON o_custkey = c_custkey AND n = 1""",
)
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "customer").select(F.col("c_custkey").alias("parent_id"))
    versions = jobs(spark, folder).select("parent_id", "id", "created_at")
    return R.latest_version(parents, versions, "parent_id")


@query("versions_of_name", f"WITH {JOBS_SQL} SELECT id, created_at FROM jobs WHERE parent_id = 42 ORDER BY created_at DESC, id")
def versions_of_name(spark: SparkSession, folder: str) -> DataFrame:
    return R.versions_of(jobs(spark, folder), "parent_id", 42).select("id", "created_at")


@query(
    "version_page",
    """SELECT o_custkey AS parent_id, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY n) AS listed FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
    WHERE n <= 5 GROUP BY o_custkey""",
)
def version_page(spark: SparkSession, folder: str) -> DataFrame:
    out = R.version_page(jobs(spark, folder), "parent_id", ["id", "status"], 5)
    listed = F.transform("versions", lambda v: F.concat(v["id"].cast("string"), v["status"]))
    return out.select("parent_id", F.array_join(listed, ",").alias("listed"))


@query(
    "list_jobs",
    f"""WITH {JOBS_SQL}, kept AS (SELECT * FROM jobs WHERE job_type = '1-URGENT' AND status = 'F')
    SELECT id, created_at, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY created_at DESC, id LIMIT 30 OFFSET 10""",
)
def list_jobs(spark: SparkSession, folder: str) -> DataFrame:
    listed, total = R.list_jobs(jobs(spark, folder), "1-URGENT", "F", 10, 30)
    return listed.select("id", "created_at").withColumn("total", total.scalar())


@query(
    "job_duration",
    """SELECT l_orderkey, l_linenumber, l_partkey, date_diff('second', o_orderdate, l_shipdate) AS seconds
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""",
)
def job_duration(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, folder, "orders")
    started = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    rows = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), started.alias("started")), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", R.duration_seconds("started", "l_shipdate").alias("seconds"))


@query(
    "external_states",
    """WITH feed AS (SELECT l_orderkey AS id,
        CASE l_returnflag WHEN 'R' THEN 'COMPLETED' WHEN 'A' THEN 'RUNNING' WHEN 'N' THEN CASE WHEN l_quantity > 25 THEN 'TIMED_OUT' ELSE 'PAUSED' END END AS external,
        l_shipdate + to_seconds(l_linenumber) + to_microseconds(l_partkey) AS observed_at FROM lineitem),
    last AS (SELECT id, arg_max(external, observed_at) AS external, max(observed_at) AS observed_at FROM feed GROUP BY id),
    j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'cancelled' END AS status,
          CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS started_at FROM orders),
    n AS (SELECT j.*, observed_at, CASE external WHEN 'RUNNING' THEN 'running' WHEN 'COMPLETED' THEN 'completed' WHEN 'TIMED_OUT' THEN 'failed' END AS state
          FROM j LEFT JOIN last USING (id)),
    c AS (SELECT *, coalesce(state <> status AND status <> 'cancelled', false) AS changed FROM n)
    SELECT id, CASE WHEN changed THEN state ELSE status END AS status,
      CASE WHEN changed AND state = 'running' THEN coalesce(started_at, observed_at) ELSE started_at END AS started_at,
      CASE WHEN changed AND state IN ('completed', 'failed') THEN observed_at END AS completed_at FROM c""",
)
def external_states(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    external = (
        F.when(F.col("l_returnflag") == "R", "COMPLETED").when(F.col("l_returnflag") == "A", "RUNNING")
        .when(F.col("l_quantity") > 25, "TIMED_OUT").otherwise("PAUSED")
    )
    seen = F.expr("l_shipdate + make_dt_interval(0, 0, 0, l_linenumber + l_partkey / 1000000.0)")
    feed = lines.select(F.col("l_orderkey").alias("id"), external.alias("external"), seen.alias("observed_at"))
    status = F.when(F.col("status") == "O", "pending").when(F.col("status") == "P", "running").otherwise("cancelled")
    current = jobs(spark, folder).select(
        "id", status.alias("status"), F.when(F.col("status") == "P", F.col("created_at")).alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )
    return R.apply_external_states(current, feed)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    issue = F.struct(
        F.lit("text").alias("column"), F.lit("validity").alias("type"),
        F.when(F.col("price") > 300000, "high").otherwise("low").alias("severity"), F.col("job_type").alias("message"),
    )
    issues = F.when(F.col("status") == "O", F.to_json(F.array(issue, issue))).when(F.col("status") == "F", "not json")
    return jobs(spark, folder).select(
        F.col("parent_id").alias("dataset_id"), "id", "created_at", "status", (F.col("price") / 10000).alias("quality_score"),
        issues.alias("issues"),
    )


@query(
    "latest_validation",
    """SELECT dataset_id, id, created_at, quality_score, n_issues, first_severity FROM (
      SELECT o_custkey AS dataset_id, o_orderkey AS id, o_orderdate AS created_at, round(o_totalprice / 10000, 6) AS quality_score,
        CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS n_issues,
        CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice > 300000 THEN 'high' ELSE 'low' END END AS first_severity,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def latest_validation(spark: SparkSession, folder: str) -> DataFrame:
    out = R.parse_issues(R.latest_validation(reports(spark, folder)))
    return out.select(
        "dataset_id", "id", "created_at", F.round("quality_score", 6).alias("quality_score"),
        F.size("issues").alias("n_issues"), F.get("issues", F.lit(0))["severity"].alias("first_severity"),
    )


@query(
    "validation_history",
    """SELECT o_custkey AS dataset_id, o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""",
)
def validation_history(spark: SparkSession, folder: str) -> DataFrame:
    return R.validation_history(reports(spark, folder), 7, 5).select("dataset_id", "id", "created_at")


@query(
    "recent_validations",
    "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
)
def recent_validations(spark: SparkSession, folder: str) -> DataFrame:
    return R.page(reports(spark, folder), [F.desc("created_at"), F.col("id")], 0, 50).select("id", "created_at")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("p_size") > 40, "prod").when(F.col("p_size") > 20, "staging").otherwise("dev")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
        status.alias("governance_status"), F.array(F.lower("p_brand"), F.split("p_name", " ")[0]).alias("tags"),
        F.col("p_retailprice").alias("created_at"),
    )


@query(
    "search_artifacts",
    """SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type = 'SMALL' AND p_size > 20 AND p_size <= 40
      AND (lower(p_brand) IN ('brand#7', 'red') OR split_part(p_name, ' ', 1) IN ('brand#7', 'red'))
    ORDER BY p_retailprice DESC, p_partkey LIMIT 10""",
)
def search_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return R.search_artifacts(artifacts(spark, folder), "SMALL", "staging", ["brand#7", "red"]).select("id", "name")


@query(
    "filter_records",
    "SELECT event_id, ts, value FROM events WHERE user_id = 12 AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 2",
)
def filter_records(spark: SparkSession, folder: str) -> DataFrame:
    kept = R.filtered(table(spark, folder, "events"), user_id=12, event_type="purchase", props=None)
    return R.page(kept, [F.desc("ts"), F.col("event_id")], 2, 20).select("event_id", "ts", "value")


@query(
    "promotion_rules",
    """WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'completed' ELSE 'dev' END AS s,
        CASE WHEN o_orderpriority < '2' THEN 'deployed' WHEN o_orderpriority < '4' THEN 'prod' ELSE 'staging' END AS t,
        o_totalprice > 100000 AND o_orderpriority <> '3-MEDIUM' AS done FROM orders),
    r AS (SELECT *, CASE WHEN t = 'prod' AND s <> 'staging' THEN 'only from staging to prod'
      WHEN t = 'prod' AND NOT done THEN 'checklist not finished'
      WHEN t = 'deployed' AND s <> 'completed' THEN 'only completed can be deployed' END AS reason FROM c)
    SELECT id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN t ELSE s END AS status FROM r""",
)
def promotion_rules(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("status") == "O", "staging").when(F.col("status") == "F", "completed").otherwise("dev")
    target = F.when(F.col("job_type") < "2", "deployed").when(F.col("job_type") < "4", "prod").otherwise("staging")
    checklist = F.create_map(
        F.lit("tested"), F.col("price") > 100000, F.lit("reviewed"), F.col("job_type") != "3-MEDIUM"
    )
    rows = jobs(spark, folder).select("id", status.alias("status"), target.alias("to_status"), checklist.alias("checklist"))
    return R.promote(rows).select("id", "accepted", "reason", "status")


@query(
    "version_tags",
    """SELECT o_orderkey, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS tags FROM orders
    LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""",
)
def version_tags(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "orders").select("o_orderkey")
    association = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    out = R.tags_of(versions, association, table(spark, folder, "part"), "o_orderkey", "p_partkey", "p_brand")
    return out.select("o_orderkey", F.array_join("tags", ",").alias("tags"))


@query(
    "get_or_create",
    """SELECT DISTINCT p_brand AS name, 0 AS known FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)
    UNION ALL SELECT DISTINCT p_brand, 1 FROM part WHERE p_size > 49""",
)
def get_or_create(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    existing = parts.where("p_size > 49").select(F.col("p_brand").alias("name"), F.lit(1).alias("known")).distinct()
    out = R.get_or_create(existing, parts.select(F.col("p_brand").alias("name")))
    return out.select("name", F.coalesce("known", F.lit(0)).alias("known"))


@query(
    "name_conflicts",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 1)",
)
def name_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with even numbers come in, those with odd ones are there."""
    parts = table(spark, folder, "part")
    incoming = parts.where("p_partkey % 2 = 0").select("p_partkey", "p_name")
    return R.conflicts(parts.where("p_partkey % 2 = 1"), incoming, ["p_name"])


@query("deletable_parents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def deletable_parents(spark: SparkSession, folder: str) -> DataFrame:
    return R.deletable(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


def part_tree(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(key.alias("id"), F.floor(key / 2).cast("long").alias("parent_id"))


@query(
    "lineage",
    """WITH RECURSIVE up AS (
      SELECT p_partkey AS id, p_partkey // 2 AS ancestor_id, 1 AS depth FROM part WHERE p_partkey > 0
      UNION ALL SELECT id, ancestor_id // 2, depth + 1 FROM up WHERE ancestor_id > 0)
    SELECT id, ancestor_id, depth FROM up""",
)
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    return R.lineage(part_tree(spark, folder))


@query(
    "lineage_of_used_parts",
    """WITH RECURSIVE up AS (
      SELECT DISTINCT l_partkey AS id, l_partkey // 2 AS ancestor_id, 1 AS depth FROM lineitem WHERE l_partkey > 0
      UNION ALL SELECT id, ancestor_id // 2, depth + 1 FROM up WHERE ancestor_id > 0)
    SELECT id, ancestor_id, depth FROM up""",
)
def lineage_of_used_parts(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    return R.lineage_of(part_tree(spark, folder), used)


@query(
    "update_with_repeated_keys",
    f"""WITH {JOBS_SQL}, changes AS (SELECT l_orderkey AS id, l_returnflag AS status, l_shipdate AS seen_at, l_linenumber AS line FROM lineitem),
    last AS (SELECT id, arg_max(status, (seen_at, line, status)) AS status FROM changes GROUP BY id)
    SELECT jobs.id, coalesce(last.status, jobs.status) AS status, created_at FROM jobs LEFT JOIN last USING (id)""",
)
def update_with_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    changes = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("seen_at"),
        F.col("l_linenumber").alias("line"),
    )
    rows = jobs(spark, folder).select("id", "status", "created_at")
    return R.update(rows, changes, ["id"], ["seen_at", "line"])
