"""Exact deduplication by sorting contents: range partitions at sampled splitters, equal texts side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import bounded_broadcast, partitions

#: Sampled rows for each range; Spark's own range partitioner takes as many.
SAMPLES_PER_RANGE = 20
#: A splitter is cut to the shortest of these lengths that still lies between its neighbours.
SPLITTER_LENGTHS = (8, 32, 128, 512, 2048)


def unchanged(text: Column) -> Column:
    return text


@dataclass(frozen=True)
class Splitters:
    """Sorted texts that begin a range. A text that itself fills several ranges also has the identifiers to cut it at."""

    texts: list[str] = field(default_factory=list)
    identifiers: list[list[int]] = field(default_factory=list)

    @property
    def ranges(self) -> int:
        return 1 + sum(len(cuts) + 1 for cuts in self.identifiers)

    def place(self, text: Column, identifier: Column) -> tuple[Column, Column]:
        """The range of a row, and the number of its text among the splitters if that text is cut, else 0."""
        if not self.texts:
            return F.lit(0), F.lit(0)
        count = len(self.texts)
        texts = F.array(*(F.lit(t) for t in self.texts))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(count.bit_length()))))
        found = F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= count) & (F.element_at(texts, F.least(at + step, F.lit(count))) <= text), at + step
            ).otherwise(at),
        )
        firsts, total = [0], 1
        for cuts in self.identifiers:
            firsts.append(total)
            total += len(cuts) + 1
        first = F.element_at(F.array(*(F.lit(x) for x in firsts)), F.col("_found") + 1)
        cuts = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)).cast("array<bigint>") for row in self.identifiers))
        own = F.element_at(cuts, F.greatest(F.col("_found"), F.lit(1)))
        same = (F.col("_found") > 0) & (F.size(own) > 0) & (F.element_at(texts, F.greatest(F.col("_found"), F.lit(1))) == text)
        before = F.size(F.filter(own, lambda cut: cut <= identifier))
        inside = F.when(F.col("_found") == 0, 0).when(same, before).otherwise(F.size(own))
        return found, F.struct((first + inside).cast("int").alias("range"), F.when(same, F.col("_found")).otherwise(0).alias("cut"))


def sample_splitters(keyed: DataFrame, ranges: int) -> Splitters:
    """Splitters of `keyed` (_text, _id) into about `ranges` parts of equal row counts, from a sample by hash.

    The sample has about SAMPLES_PER_RANGE rows a range whatever the input, so one task may order it. It only places
    the borders: every row goes to a range. A border inside a run of equal texts cuts the run by identifier.
    """
    rows = keyed.count()
    if ranges < 2 or rows < 2:
        return Splitters()
    rate = max(1, rows // (SAMPLES_PER_RANGE * ranges))
    sample = keyed.where(F.pmod(F.xxhash64("_text", "_id"), F.lit(rate)) == 0)
    order = Window.orderBy("_text", F.col("_id").asc_nulls_first())
    ordered = sample.select("_text", "_id", F.lag("_text").over(order).alias("_before"), F.row_number().over(order).alias("_rank"))
    shorter = F.coalesce(
        *(F.when(F.left("_text", F.lit(k)) != F.left("_before", F.lit(k)), F.left("_text", F.lit(k))) for k in SPLITTER_LENGTHS),
        F.col("_text"),
    )
    inside = F.col("_text") == F.col("_before")
    every = max(1, min(SAMPLES_PER_RANGE, rows // ranges))
    borders = (
        ordered.where((F.col("_rank") > 1) & (F.col("_rank") % every == 0))
        .select(F.when(inside, F.col("_text")).otherwise(shorter).alias("text"), F.when(inside, F.col("_id")).alias("id"), inside.alias("inside"))
        .collect()
    )
    cuts: dict[str, list[int]] = {}
    for border in borders:
        own = cuts.setdefault(border["text"], [])
        if border["inside"] and border["id"] is not None and border["id"] not in own:
            own.append(border["id"])
    texts = sorted(cuts, key=lambda t: t.encode())
    return Splitters(texts, [sorted(cuts[t]) for t in texts])


def mark_duplicates(
    df: DataFrame,
    text: str = "text",
    identifier: str = "doc_id",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """One row per input row: (row struct<input columns>, text string normalised, keep_id, group_size, kept).

    Rows move once, to ranges of the normalised bytes; each range is sorted (external, Spark spills), so equal texts lie
    next to each other and neighbours are compared in full, no hash decides. Of equal texts the row with the smallest or
    largest identifier stays. A text that fills several ranges is cut by identifier; its parts are summed in a table of
    at most one row a splitter. Input columns stay inside `row`, so none can clash.

    Null text counts as empty. A null identifier is kept only if its group has no other, and one row of it. Of repeated
    rows with the same text and identifier one is kept. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.coalesce(normalise(F.col(text)), F.lit("")).alias("_text"),
        F.col(identifier).cast("long").alias("_id"),
    )
    borders = sample_splitters(keyed.select("_text", "_id"), partitions(df.sparkSession))
    found, place = borders.place(F.col("_text"), F.col("_id"))
    if borders.texts:
        placed = keyed.withColumn("_found", found).withColumn("_place", place)
        placed = placed.select("row", "_text", "_id", F.col("_place.range").alias("_range"), F.col("_place.cut").alias("_cut"))
    else:
        placed = keyed.select("row", "_text", "_id", F.lit(0).alias("_range"), F.lit(0).alias("_cut"))
    first = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    run = Window.partitionBy("_range", "_text").orderBy(first)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = placed.repartitionById(borders.ranges, F.col("_range")).select(
        "row",
        "_text",
        "_id",
        "_cut",
        F.first("_id").over(whole).alias("_keep"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        F.row_number().over(run).alias("_number"),
    )
    hot = sum(1 for cuts in borders.identifiers if cuts)
    if hot:
        chosen = F.min("_id") if keep == "smallest" else F.max("_id")
        runs = placed.where("_cut > 0").groupBy("_cut").agg(chosen.alias("_all_keep"), F.count("*").alias("_all_size"))
        marked = marked.join(bounded_broadcast(runs, hot), "_cut", "left")
    else:
        marked = marked.withColumns({"_all_keep": F.lit(None).cast("long"), "_all_size": F.lit(None).cast("long")})
    is_cut = F.col("_all_size").isNotNull()
    keep_id = F.when(is_cut, F.col("_all_keep")).otherwise(F.col("_keep"))
    return marked.select(
        "row",
        F.col("_text").alias("text"),
        keep_id.alias("keep_id"),
        F.when(is_cut, F.col("_all_size")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_number") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
    )


def drop_exact_duplicates(df: DataFrame, **options) -> DataFrame:
    """The rows that `mark_duplicates` keeps, with the columns of the input."""
    return mark_duplicates(df, **options).where("kept").select("row.*")
