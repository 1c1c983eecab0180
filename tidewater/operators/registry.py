"""Metadata tables: point reads, pages, upserts, versions, promotion rules, tags, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordering import top_per_group
from tidewater.operators.embed import artifact_search_text
from tidewater.operators.lineage import ancestors, lineage_labels
from tidewater.operators.search import search_text
from tidewater.session import checkpointed

# State of an external run -> state of the job.
JOB_STATES = {
    "RUNNING": "running",
    "COMPLETED": "completed",
    "FAILED": "failed",
    "CANCELED": "cancelled",
    "TIMED_OUT": "failed",
}
# Job states that end a job.
FINAL_STATES = ("completed", "failed", "cancelled")


def get(df: DataFrame, **keys) -> DataFrame:
    """Rows matching every key, a single or a compound one."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def page(df: DataFrame, order: Sequence[Column | str], skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def filtered(df: DataFrame, **conditions) -> DataFrame:
    """Equality filters; a condition of None is not applied."""
    for name, value in conditions.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert or replace by key; among incoming rows of one key the last by `order` wins.

    Columns only one side has are added with nulls. A null key is a key like any other.
    """
    newest = top_per_group(incoming, keys, [F.desc(c) if isinstance(c, str) else c for c in order], 1, "_n").drop("_n")
    replaced = newest.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return existing.join(replaced, same, "left_anti").unionByName(newest, allowMissingColumns=True)


def one_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """The last change of each key by `order`; without an order, or among equals, the largest by all other columns."""
    named = [c for c in changes.columns if c not in keys]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    position = F.struct(*by, *[F.col(c) for c in named]) if by or named else F.lit(0)
    last = F.max_by(F.struct(*named), position) if named else F.lit(None)
    picked = changes.groupBy(*keys).agg(last.alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in named])


def update(
    df: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()
) -> DataFrame:
    """Set the columns the change set has, for the keys it names; of several changes of a key the last by `order` counts.

    Columns used only to order changes are not set. Rows and changes with a null key stay apart.
    """
    changes = one_per_key(changes, keys, order)
    named = [c for c in changes.columns if c not in keys and c in df.columns]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in named], F.lit(True).alias("_changed"))
    joined = df.join(marked, list(keys), "left")
    columns = [
        F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
        for c in df.columns
    ]
    return joined.select(*columns)


def not_found(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes whose key the table does not have."""
    return changes.join(df.select(*keys), list(keys), "left_anti")


def delete(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(doomed.select(*keys), list(keys), "left_anti")


def latest_version(
    parents: DataFrame, versions: DataFrame, parent: str, created: str = "created_at", key: str = "id"
) -> DataFrame:
    """Every parent with its newest version; equal times go to the smaller id."""
    newest = top_per_group(versions, [parent], [F.desc(created), F.col(key)], 1, "_n").drop("_n")
    return parents.join(newest, parent, "left")


def versions_of(df: DataFrame, name: str, value, created: str = "created_at", key: str = "id") -> DataFrame:
    """All versions under a name, newest first."""
    return df.where(F.col(name) == F.lit(value)).orderBy(F.desc(created), F.col(key))


def version_page(
    versions: DataFrame, parent: str, fields: Sequence[str], limit: int = 100, created: str = "created_at", key: str = "id"
) -> DataFrame:
    """Per parent a list of its `limit` newest versions, newest first."""
    newest = top_per_group(versions, [parent], [F.desc(created), F.col(key)], limit, "_n")
    listed = F.sort_array(F.collect_list(F.struct("_n", *fields)))
    return newest.groupBy(parent).agg(
        F.transform(listed, lambda v: F.struct(*[v[f].alias(f) for f in fields])).alias("versions")
    )


def list_jobs(
    df: DataFrame, job_type: str | None = None, status: str | None = None, skip: int = 0, limit: int = 100
) -> tuple[DataFrame, DataFrame]:
    """One page of jobs, newest first, and the total before paging."""
    kept = filtered(df, job_type=job_type, status=status)
    return page(kept, [F.desc("created_at"), F.col("id")], skip, limit), kept.agg(F.count(F.lit(1)).alias("total"))


def duration_seconds(started: str, completed: str) -> Column:
    """Whole seconds between two timestamps; null while either is missing."""
    return F.timestamp_diff("SECOND", F.col(started), F.col(completed))


def apply_external_states(jobs: DataFrame, feed: DataFrame) -> DataFrame:
    """Bring jobs up to date from `feed(id, external, observed_at)`, the last observation per job.

    Unknown external states and unchanged ones leave the job as it is; ended jobs stay ended. The
    first time a job runs or ends is stamped.
    """
    last = feed.groupBy("id").agg(
        F.max_by("external", "observed_at").alias("external"), F.max("observed_at").alias("observed_at")
    )
    mapping = F.create_map(*[F.lit(x) for pair in JOB_STATES.items() for x in pair])
    state = F.try_element_at(mapping, F.col("external"))
    changed = F.coalesce(
        state.isNotNull() & (state != F.col("status")) & ~F.col("status").isin(*FINAL_STATES), F.lit(False)
    )
    return jobs.join(last, "id", "left").select(
        *[c for c in jobs.columns if c not in ("status", "started_at", "completed_at")],
        F.when(changed, state).otherwise(F.col("status")).alias("status"),
        F.when(changed & (state == "running"), F.coalesce("started_at", "observed_at"))
        .otherwise(F.col("started_at")).alias("started_at"),
        F.when(changed & state.isin(*FINAL_STATES), F.coalesce("completed_at", "observed_at"))
        .otherwise(F.col("completed_at")).alias("completed_at"),
    )


def latest_validation(reports: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """The newest validation record of every dataset."""
    return top_per_group(reports, [dataset], [F.desc("created_at"), F.col("id")], 1, "_n").drop("_n")


def validation_history(reports: DataFrame, dataset_id, limit: int | None = None) -> DataFrame:
    out = reports.where(F.col("dataset_id") == F.lit(dataset_id)).orderBy(F.desc("created_at"), F.col("id"))
    return out if limit is None else out.limit(limit)


def parse_issues(reports: DataFrame, issues: str = "issues") -> DataFrame:
    """Issues from JSON text to rows; text that is not a list of issues reads as no issue."""
    schema = "array<struct<column:string,type:string,severity:string,message:string>>"
    return reports.withColumn(issues, F.coalesce(F.from_json(F.col(issues), schema), F.array().cast(schema)))


def search_artifacts(
    df: DataFrame,
    artifact_type: str | None = None,
    status: str | None = None,
    tags: Sequence[str] | None = None,
    limit: int = 10,
    text: str | None = None,
) -> DataFrame:
    """Artifacts by type, status and any of the tags, newest first.

    With `text` the artifacts whose name, description or tags hold its terms come best match first (BM25, `score`), and
    those that hold none are left out. The filters come first.
    """
    out = filtered(df, type=artifact_type, governance_status=status)
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if text is not None:
        described = F.col("description") if "description" in df.columns else F.lit(None).cast("string")
        index = out.select("id", artifact_search_text(F.col("name"), described, F.col("tags")).alias("text"))
        asked = df.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
        hits = search_text(index, asked, limit).select("id", "score", "rank")
        return out.join(hits, "id").orderBy("rank").drop("rank")
    return out.orderBy(F.desc("created_at"), F.col("id")).limit(limit)


def promote(df: DataFrame) -> DataFrame:
    """Decide promotions of rows `(status, to_status, checklist map<string,boolean>)`.

    `prod` needs `staging` and a finished checklist (an empty one counts as finished); `deployed`
    needs `completed`. Adds `accepted`, `reason` and the resulting `status`.
    """
    finished = F.forall(F.map_values("checklist"), lambda done: done)
    reason = (
        F.when((F.col("to_status") == "prod") & (F.col("status") != "staging"), "only from staging to prod")
        .when((F.col("to_status") == "prod") & ~finished, "checklist not finished")
        .when((F.col("to_status") == "deployed") & (F.col("status") != "completed"), "only completed can be deployed")
    )
    out = df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return out.withColumn("status", F.when(F.col("accepted"), F.col("to_status")).otherwise(F.col("status")))


def tags_of(versions: DataFrame, association: DataFrame, tags: DataFrame, version: str, tag: str, name: str) -> DataFrame:
    """Versions with the sorted set of their tag names, empty where there is none."""
    named = association.select(version, tag).distinct().join(tags.select(tag, name), tag)
    sets = named.groupBy(version).agg(F.sort_array(F.collect_set(name)).alias("tags"))
    return versions.join(sets, version, "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def get_or_create(existing: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The table with one new row for every incoming name it lacks."""
    new = names.select(name).distinct().join(existing.select(name), name, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def conflicts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is taken."""
    return incoming.join(existing.select(*keys), list(keys), "left_semi")


def deletable(parents: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """Parents without children."""
    return parents.join(children.select(parent), parent, "left_anti")


def lineage(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of every artifact of `edges(id, parent_id)`: id, ancestor_id, depth.

    Known stretches are joined end to end, so a tree of depth d takes about log2(d) rounds, and each
    round's new pairs are cut off through the checkpoint folder. In a cycle every other member is
    listed once, at its smallest depth; pairs are grouped only after a cycle has shown up. A parent
    that is not itself listed ends the line and is not an ancestor.
    """
    known = edges.select(F.col("id").alias("ancestor_id"))
    step = (
        edges.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id")))
        .select("id", F.col("parent_id").alias("ancestor_id"))
        .join(known, "ancestor_id", "left_semi")
        .select("id", "ancestor_id", F.lit(1).alias("depth"))
    )
    parts, length, cyclic = [checkpointed(step)], 1, False
    while max_depth is None or length < max_depth:
        top = parts[-1].agg(
            F.max("depth").alias("depth"), F.bool_or(F.col("id") == F.col("ancestor_id")).alias("cyclic")
        ).first()
        if top["depth"] is None or top["depth"] < length:
            break
        reach, cyclic = reduce(DataFrame.unionByName, parts), cyclic or top["cyclic"]
        if cyclic:
            reach = checkpointed(_shortest(reach))
            parts = [reach]
        far = reach.where(F.col("depth") == length).select("id", F.col("ancestor_id").alias("via"), "depth")
        further = far.join(
            reach.select(F.col("id").alias("via"), "ancestor_id", F.col("depth").alias("more")), "via"
        ).select("id", "ancestor_id", (F.col("depth") + F.col("more")).alias("depth"))
        parts.append(checkpointed(further))
        length *= 2
    out = reduce(DataFrame.unionByName, parts)
    out = _shortest(out) if cyclic else out
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def _shortest(pairs: DataFrame) -> DataFrame:
    shortest = pairs.groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth"))
    return shortest.where(F.col("id") != F.col("ancestor_id"))


def lineage_of(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ancestors of the artifacts of `wanted(id)` in `edges(id, parent_id)`: id, ancestor_id, depth; no depth limit.

    They come from interval labels (`operators.lineage`), whose rows are linear in the artifacts. Artifacts on cycles or
    below them have no labels, and go by `_lineage_by_jumps`. Equal to `lineage` on the same ids, cycles and unlisted
    parents included.
    """
    labels = checkpointed(lineage_labels(edges))
    found = ancestors(labels, wanted)
    cyclic = labels.where("cyclic").select("id")
    if cyclic.isEmpty():
        return found
    return found.unionByName(_lineage_by_jumps(edges.join(cyclic, "id", "left_semi"), wanted.join(cyclic, "id", "left_semi")))


def _lineage_by_jumps(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same, cycles included, a row for each wanted artifact and ancestor all the while.

    Each round knows the ancestors up to a depth for the wanted ids, and a jump of that length for every artifact; both
    double, so a line of depth d takes log2(d) rounds. Only the wanted ids' pairs are kept.
    """
    known = edges.select(F.col("id").alias("to")).distinct()
    jump = checkpointed(
        edges.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id")))
        .select(F.col("id").alias("from"), F.col("parent_id").alias("to"))
        .join(known, "to", "left_semi")
        .distinct()
    )
    # Each wanted artifact is its own ancestor at depth 0, from where the first jump starts.
    found = checkpointed(wanted.select("id").distinct().select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth")))
    length = 1
    while True:
        reached = found.join(jump, found["ancestor_id"] == jump["from"]).select(
            "id", F.col("to").alias("ancestor_id"), (F.col("depth") + length).alias("depth")
        )
        new = reached.groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth"))
        new = checkpointed(new.join(found.select("id", "ancestor_id"), ["id", "ancestor_id"], "left_anti"))
        if new.isEmpty():
            return found.where("depth > 0")
        found = checkpointed(found.unionByName(new.select(*found.columns)))
        further = jump.select(F.col("from").alias("to"), F.col("to").alias("_to"))
        jump = checkpointed(jump.join(further, "to").select("from", F.col("_to").alias("to")).distinct())
        length *= 2
