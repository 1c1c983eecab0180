"""Mixing sources to target weights: block quotas split down a tree of output shards, drawn from permuted blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import bounded_broadcast, partitions, word_count
from tidewater.session import checkpointed

#: The top bits of a row's hash give its slice of the source, the others its place; a block is a run of slices.
SLICE_BITS = 10
SLICES = 1 << SLICE_BITS
NO_DRAWS = "array<struct<pass:int,shard:int>>"


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, null last, again and again; the share is of the words of all sources."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    limit: int = 2
    shards: int = 16
    blocks: int = 2048
    seed: int = 17


@dataclass(frozen=True)
class MixPlan:
    """What the mix takes, block by block.

    sources: (source, words, rank, target, n_blocks), a row a source.
    blocks: (rank, block, takes array<struct<pass, shard, cut>>), a row a block that is taken; a row of the block is
    taken if its place is not above the cut, and always where the cut is null.
    """

    sources: DataFrame
    n_sources: int
    blocks: DataFrame
    n_blocks: int

    def place(self, keyed: DataFrame) -> DataFrame:
        """Rows (key, source, ...) with source_size, target and draws array<struct<pass, shard>>, one for each time taken."""
        sources = self.sources.select(F.col("source").alias("_source"), "rank", "n_blocks", F.col("words").alias("source_size"), "target")
        found = keyed.join(bounded_broadcast(sources, self.n_sources), F.col("source").eqNullSafe(F.col("_source")), "left")
        found = found.withColumn("block", block_of(slice_of(F.col("key")), F.col("n_blocks")))
        found = found.join(bounded_broadcast(self.blocks, self.n_blocks), ["rank", "block"], "left")
        taken = F.filter("takes", lambda take: take["cut"].isNull() | (place_of(F.col("key")) <= take["cut"]))
        draws = F.transform(taken, lambda take: F.struct(take["pass"].alias("pass"), take["shard"].alias("shard")))
        return found.withColumn("draws", F.coalesce(draws, F.array().cast(NO_DRAWS))).drop(
            "_source", "rank", "n_blocks", "block", "takes"
        )


def row_key(mix: Mix, identifier: Column, text: Column) -> Column:
    """Hash that fixes where a row stands in the permutation of its source, on any partitioning and in any rerun."""
    return F.xxhash64(F.lit(mix.seed), identifier, text)


def slice_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - SLICE_BITS).cast("int")


def place_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << (64 - SLICE_BITS)) - 1))


def block_of(part: Column, blocks: Column) -> Column:
    return F.floor(part * blocks / F.lit(SLICES)).cast("int")


def with_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """`sources` (source, words) with rank, weight, cap and target.

    A target stops at `limit` times the words of its source, and the excess is shared anew by weight until none is
    above. Sorted by cap over weight the sources that stop come first, so the level of the others is found in one pass.
    """
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") - 1) % len(mix.weights) + 1))
    ranked = ranked.withColumn("cap", F.col("words") * F.lit(float(mix.limit)))
    left = mix.share * F.sum("words").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / F.sum("weight").over(from_here))
    levelled = levelled.withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    common = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(everywhere)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(common * F.col("weight"))
    return levelled.withColumn("target", target.cast("double")).drop("level", "stops")


def draw_blocks(blocks: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """The blocks that a source gives, in permuted order: (rank, unit, pass, block, need).

    A pass permutes the blocks of the source anew and takes all of them, or as many as the target still wants. `need` is
    the words wanted of the last block of a pass that ends inside it, else null.
    """
    passes = F.explode(F.sequence(F.lit(0), F.lit(mix.limit - 1))).alias("pass")
    offered = blocks.join(sources.select("rank", "target", F.col("words").alias("all_words")), "rank").select("*", passes)
    wanted = F.least(F.col("all_words").cast("double"), F.greatest(F.lit(0.0), F.col("target") - F.col("pass") * F.col("all_words")))
    permuted = (F.xxhash64(F.lit(mix.seed), "rank", "pass", "block"), F.col("block"))
    in_pass = Window.partitionBy("rank", "pass").orderBy(*permuted)
    before = F.sum("words").over(in_pass.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    drawn = offered.withColumn("wanted", wanted).withColumn("before", before).where("before < wanted")
    need = F.when(F.col("before") + F.col("words") > F.col("wanted"), F.col("wanted") - F.col("before"))
    unit = F.row_number().over(Window.partitionBy("rank").orderBy("pass", *permuted))
    return drawn.select("rank", unit.alias("unit"), "pass", "block", need.alias("need"))


def split_quotas(units: DataFrame, mix: Mix) -> DataFrame:
    """Quotas (rank, shard, quota) of `units` (rank, unit), split down a tree of shards.

    Each node cuts a random order of its units at the exact share of the shards on its left. How many units of each
    source go left is a multivariate hypergeometric draw, and the sums over sources and over shards stay exact. The
    tree works on at most mix.limit * (mix.blocks + 2 * sources) units, whatever the size of the corpus.
    """
    nodes = units.select("rank", "unit", F.lit(0).alias("low"), F.lit(mix.shards).alias("high"))
    for level in range((mix.shards - 1).bit_length()):
        node = Window.partitionBy("low", "high")
        random = node.orderBy(F.xxhash64(F.lit(mix.seed), F.lit(level), "low", "rank", "unit"), "rank", "unit")
        nodes = (
            nodes.withColumn("middle", F.expr("(low + high) div 2"))
            .withColumn("place", F.row_number().over(random))
            .withColumn("size", F.count("*").over(node))
            .withColumn("left", F.expr("place <= (size * (middle - low)) div (high - low)"))
            .select(
                "rank",
                "unit",
                F.expr("if(high - low = 1 or left, low, middle)").cast("int").alias("low"),
                F.expr("if(high - low = 1 or not left, high, middle)").cast("int").alias("high"),
            )
        )
    return nodes.groupBy("rank", F.col("low").alias("shard")).agg(F.count("*").alias("quota"))


def plan_mix(keyed: DataFrame, mix: Mix) -> MixPlan:
    """Plan over rows (source, key long, size long), which should be cheap to read twice.

    One grouping by source and slice, summed before the shuffle, gives all sizes; everything after works on blocks. Of
    the rows, only those in the last block of a source are ordered, to find the place where the target is reached.
    """
    slices = checkpointed(
        keyed.groupBy("source", slice_of(F.col("key")).alias("slice")).agg(F.sum("size").alias("words"))
    )
    sources = with_targets(slices.groupBy("source").agg(F.sum("words").alias("words")), mix)
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fair = F.round(F.col("words") * F.lit(mix.blocks) / F.greatest(F.sum("words").over(everything), F.lit(1)))
    sources = checkpointed(sources.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(SLICES), fair)).cast("int")))
    ranks = sources.select(F.col("source").alias("_source"), "rank", "n_blocks")
    blocks = (
        slices.join(ranks, F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("rank", block_of(F.col("slice"), F.col("n_blocks")).alias("block"))
        .agg(F.sum("words").alias("words"))
        .where("words > 0")
    )
    drawn = checkpointed(draw_blocks(blocks, sources, mix))
    quotas = split_quotas(drawn, mix)
    last = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
    turns = quotas.withColumn("last", last).select(
        "rank", "shard", F.explode(F.sequence((F.col("last") - F.col("quota") + 1).cast("int"), F.col("last").cast("int"))).alias("unit")
    )
    dealt = checkpointed(drawn.join(turns, ["rank", "unit"]))
    cuts = find_cuts(keyed, sources, dealt.where("need is not null"))
    # A pass that ends inside a block may want less than half of the first row: then nothing lies below the cut.
    take = F.struct("pass", "shard", F.when(F.col("need").isNotNull(), F.coalesce("cut", F.lit(-1))).alias("cut"))
    takes = dealt.join(cuts, ["rank", "pass", "block"], "left").groupBy("rank", "block").agg(F.sort_array(F.collect_list(take)).alias("takes"))
    takes = checkpointed(takes)
    return MixPlan(sources, sources.count(), takes, takes.count())


def find_cuts(keyed: DataFrame, sources: DataFrame, partial: DataFrame) -> DataFrame:
    """Where to cut the last blocks: (rank, pass, block, cut), the place of the last row that brings the words nearest to `need`.

    At most one block for each source and pass, a 1/n_blocks part of the source.
    """
    wanted = partial.select("rank", "pass", "block", "need").join(
        sources.select(F.col("source").alias("_source"), "rank", "n_blocks"), "rank"
    )
    rows = keyed.join(
        wanted,
        F.col("source").eqNullSafe(F.col("_source")) & (block_of(slice_of(F.col("key")), F.col("n_blocks")) == F.col("block")),
    ).select("rank", "pass", "block", "need", "size", place_of(F.col("key")).alias("place"))
    ordered = Window.partitionBy("rank", "pass", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("size").over(ordered) - F.col("size") / 2
    return rows.withColumn("middle", middle).where("middle <= need").groupBy("rank", "pass", "block").agg(F.max("place").alias("cut"))


def mix_rows(df: DataFrame, mix: Mix = Mix(), text: str = "text", identifier: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: (identifier, key, source, size, source_size, target, draws array<struct<pass, shard>>).

    `draws` has an entry for each time the mix takes the row, at most mix.limit. Texts are read once, for their words and
    the hash; the narrow rows are written to the shared checkpoint folder and all else reads those.

    Null texts and texts without words have size 0; they are taken with the block they hash to and add nothing. A null
    source is a source, the last. Null identifiers hash with the text. Repeated rows hash alike and are taken alike. An
    empty table gives no rows. Other columns are not read.
    """
    narrow = checkpointed(
        df.select(
            F.col(identifier).alias("identifier"),
            F.col(source).alias("source"),
            row_key(mix, F.col(identifier), F.col(text)).alias("key"),
            word_count(F.col(text)).alias("size"),
        )
    )
    return plan_mix(narrow, mix).place(narrow).withColumnRenamed("identifier", identifier)


def mixed(df: DataFrame, mix: Mix = Mix(), text: str = "text", identifier: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of `df` as often as they are taken, with its columns, shard after shard, shuffled within.

    The plan is a table of blocks, so each row decides on its own whether and where it goes. The copies move once, to
    ranges of shard and random key.
    """
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.col(source).alias("source"),
        row_key(mix, F.col(identifier), F.col(text)).alias("key"),
    )
    sizes = checkpointed(keyed.select("source", "key", word_count(F.col(f"row.`{text}`")).alias("size")))
    placed = plan_mix(sizes, mix).place(keyed).select("row", "key", F.explode("draws").alias("draw"))
    shuffled = placed.select("row", F.col("draw.shard").alias("_shard"), F.xxhash64(F.lit(mix.seed + 1), "key", "draw.pass").alias("_order"))
    return (
        shuffled.repartitionByRange(partitions(df.sparkSession), "_shard", "_order")
        .sortWithinPartitions("_shard", "_order")
        .select("row.*")
    )
