"""Interval labels of a forest: ancestors and depths from two numbers per artifact, without the closure.

A walk around each tree would pass every artifact twice, down and up; the two numbers are those places. They follow from
the sizes of the subtrees: below its parent an artifact comes after the subtrees of its smaller siblings. Depths and sizes
come from jumps towards the root whose length doubles, sums along the path likewise, so that log2(depth) rounds do. An
artifact is above another if its two numbers enclose the other's. Rows stay one for each artifact, however deep or wide
the trees are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.session import checkpointed

#: At most so many artifacts, those that most jumps lead to, are broadcast in a round.
BROADCAST_ROWS = 100_000
#: Jumps to an artifact that a task takes well by a shuffle.
FEW_JUMPS = 1000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _forest(edges: DataFrame) -> DataFrame:
    """(id, parent_id), a row for each artifact; a parent that is not listed, or the artifact itself, counts as none."""
    single = edges.groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = single.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    parent = F.when(F.col("known") & (F.col("parent_id") != F.col("id")), F.col("parent_id"))
    return checkpointed(single.join(known, "parent_id", "left").select("id", parent.alias("parent_id")))


def _climbed(state: DataFrame, joined: Callable[[str], Column], names: list[str], size: bool = False) -> DataFrame:
    """`state` (id, next, names...) with jumps that have doubled until they end above a root; those of a cycle never do.

    A round looks up where a jump ends and goes on from there; `joined(name)` is the value of both stretches, of columns
    `name` and `_name`. With `size` the artifacts of a jump's length below an artifact are summed in `size`. Artifacts to
    which many jumps lead, as to a popular parent and near a root, are few and are broadcast; the others are shuffled.
    """
    rows = state.count()
    many = max(FEW_JUMPS, rows // BROADCAST_ROWS)
    for _ in range(rows.bit_length()):
        if state.where("next IS NOT NULL").isEmpty():
            break
        below = [F.sum("size").alias("more")] if size else []
        arrivals = state.where("next IS NOT NULL").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("jumps"), *below)
        met = state.join(arrivals, "id", "left")
        met = checkpointed(met.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more") if size else met)
        far = met.where("jumps IS NOT NULL").select(
            F.col("id").alias("next"), F.col("next").alias("_next"), *(F.col(n).alias(f"_{n}") for n in names), F.col("jumps").alias("_jumps")
        )
        hot = F.broadcast(far.where(F.col("_jumps") > many))
        kept = ["size"] if size else []
        jumped = [F.col("id"), F.col("_next").alias("next"), *(joined(n).alias(n) for n in names), *kept]
        open_ = met.where("next IS NOT NULL")
        state = checkpointed(
            met.where("next IS NULL").select("id", "next", *names, *kept)
            .unionByName(open_.join(hot, "next").select(*jumped))
            .unionByName(open_.join(hot, "next", "left_anti").join(far.where(F.col("_jumps") <= many), "next").select(*jumped))
        )
    return state


def _sum(name: str) -> Column:
    return F.col(name) + F.col(f"_{name}")


def _offsets(sized: DataFrame) -> DataFrame:
    """(id, offset) of `sized` (id, parent_id, size): places from the parent's down to the artifact, 0 for a root.

    Children are ordered in ranges of (parent, id), so that a parent with a third of all children is no single task;
    a range begins with what the ranges before it have of the same parent.
    """
    ranged = sized.where("parent_id IS NOT NULL").repartitionByRange(_partitions(sized), "parent_id", "id")
    placed = checkpointed(ranged.withColumn("range", F.spark_partition_id()))
    parts = placed.groupBy("parent_id", "range").agg(F.sum("size").alias("sizes"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    earlier = F.sum("sizes").over(before.partitionBy("parent_id").orderBy("range"))
    inside = F.sum("size").over(before.partitionBy("parent_id", "range").orderBy("id"))
    started = placed.withColumn("inside", inside).join(parts.select("parent_id", "range", earlier.alias("earlier")), ["parent_id", "range"])
    smaller = F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))
    below = started.select("id", "parent_id", (2 * smaller + 1).alias("offset"))
    return below.unionByName(sized.where("parent_id IS NULL").select("id", "parent_id", F.lit(0).cast("long").alias("offset")))


def lineage_labels(edges: DataFrame) -> DataFrame:
    """(id, root, depth, enter, leave, cyclic) for each artifact of `edges(id, parent_id)`.

    `a` is an ancestor of `b` if they have one root and `a.enter < b.enter` and `b.leave < a.leave`; it is then
    `b.depth - a.depth` above it. A parent that is not listed, or the artifact itself, makes a root. Of repeated ids the
    smallest parent counts. Artifacts that lie on a cycle or below one have no root, depth or numbers, and `cyclic`.
    """
    forest = _forest(edges.where("id IS NOT NULL").select("id", "parent_id"))
    # A stretch goes from an artifact to the last one below the end of its jump.
    step = F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long")
    first = forest.select("id", F.col("parent_id").alias("next"), step.alias("depth"), F.col("id").alias("root"), F.lit(1).cast("long").alias("size"))
    climbed = _climbed(first, lambda n: F.col("_root") if n == "root" else _sum(n), ["depth", "root"], size=True)
    sized = checkpointed(climbed.where("next IS NULL").select("id", "depth", "root", "size").join(forest, "id"))
    places = checkpointed(_offsets(sized.select("id", "parent_id", "size")).select("id", F.col("parent_id").alias("next"), "offset"))
    entered = _climbed(places, _sum, ["offset"]).select("id", F.col("offset").alias("enter"))
    labels = sized.join(entered, "id").select(
        "id", "root", "depth", "enter", (F.col("enter") + 2 * F.col("size") - 1).alias("leave"), F.lit(False).alias("cyclic")
    )
    none = F.lit(None)
    cyclic = climbed.where("next IS NOT NULL").select(
        "id", none.cast(forest.schema["id"].dataType).alias("root"), *(none.cast("long").alias(n) for n in ("depth", "enter", "leave")), F.lit(True).alias("cyclic")
    )
    return labels.unionByName(cyclic)


def ancestors(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, ancestor_id, depth) for the artifacts of `wanted(id)`, from labels of artifacts that are on no cycle.

    Numbers are swept in ranges. A range begins with the artifacts that enclose its border, which are the ancestors of
    one artifact, and goes on with a stack. The rows are those of the labels, the borders' and the result's.
    """
    spark = labels.sparkSession
    known = labels.where("not cyclic")
    asked = wanted.select("id").distinct().withColumn("asked", F.lit(True))
    flagged = known.join(asked, "id", "left").select("id", "root", "depth", "enter", "leave", F.coalesce("asked", F.lit(False)).alias("asked"))
    # Leaves enclose nothing.
    useful = flagged.where(F.col("asked") | (F.col("leave") > F.col("enter") + 1))
    ranged = useful.repartitionByRange(_partitions(labels), "root", "enter").withColumn("range", F.spark_partition_id())
    placed = checkpointed(ranged)
    borders = placed.groupBy("range").agg(F.min(F.struct("root", "enter")).alias("first"))
    starts = sorted((r["range"], r["first"]["root"], r["first"]["enter"]) for r in borders.collect())
    if not starts:
        return wanted.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth")).limit(0)
    schema = T.StructType([T.StructField("range", T.IntegerType()), labels.schema["root"], T.StructField("first", T.LongType())])
    # Most artifacts end in their own range: only those that enclose the next border meet the borders of their root.
    following = spark.createDataFrame([(a[0], b[1], b[2]) for a, b in pairwise(starts)], schema).withColumnsRenamed({"root": "_root", "first": "_first"})
    crossing = placed.join(F.broadcast(following), "range").where("root = _root AND _first <= leave").drop("range", "_root", "_first")
    crossed = crossing.join(F.broadcast(spark.createDataFrame(starts, schema)), "root").where("enter < first AND first <= leave")
    both = crossed.select("range", F.lit(0).alias("kind"), "id", "root", "depth", "enter", "leave", F.lit(False).alias("asked")).unionByName(
        placed.select("range", F.lit(1).alias("kind"), "id", "root", "depth", "enter", "leave", "asked")
    )
    dealt = both.repartitionById(_partitions(labels), F.col("range")).sortWithinPartitions("range", "kind", "root", "enter")
    kind = labels.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("ancestor_id", kind), T.StructField("depth", T.IntegerType())])
    return dealt.mapInArrow(partial(_sweep, schema=to_arrow_schema(out)), out)


def _sweep(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    stack: list[tuple] = []
    place = None
    for batch in batches:
        found: tuple[list, list, list] = ([], [], [])
        names = ("range", "kind", "id", "root", "depth", "leave", "asked", "enter")
        for here, kind, identity, root, depth, leave, asked, enter in zip(*(batch[n].to_pylist() for n in names), strict=True):
            # What encloses a range's border is that of its first tree; another tree begins with nothing open.
            if (here, root) != place:
                stack, place = [], (here, root)
            while stack and stack[-1][1] < enter:
                stack.pop()
            if kind and asked and stack:
                found[0].extend([identity] * len(stack))
                found[1].extend(s[0] for s in stack)
                found[2].extend(depth - s[2] for s in stack)
                if len(found[0]) > 1 << 16:
                    yield _pairs(found, schema)
                    found = ([], [], [])
            if leave > enter + 1:
                stack.append((identity, leave, depth))
        if found[0]:
            yield _pairs(found, schema)


def _pairs(found: tuple[list, list, list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(found[0], schema.field(0).type), pa.array(found[1], schema.field(1).type), pa.array(np.array(found[2], dtype=np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
