"""Quality rules whose cut-offs follow the data: mergeable quantile sketches for each language and source."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches
from tidewater.session import checkpointed

#: Words in a window that counts as repeated, and the plain rules that hold whatever the data.
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures, in thousandths of the number of words.
MEASURES = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "length": "word_chars"}
TWO_SIDED = ("length",)


@dataclass(frozen=True)
class Fences:
    """A measure may lie beyond its group's outer tenths by `spread` times the way from the median to there, and `room`.

    Room is in thousandths of a word each, and all that a group without any spread allows: 2 symbols or 5 repeated words
    in a hundred, a repeated line in two hundred, half a character of length. Every group has its own sketch, whatever
    its size. A sketch keeps `bits` leading bits of a measure: quantiles are exact below 2**bits and within 2**(1 - bits)
    above.

    The outer tenth of fewer than ten documents is empty, so their own sketch drops none. With `lent`, the sketch of all
    adds so many of its quantiles, a document each, to that of every language, which then lends as many to each of its
    sources: from 20 on the only document of a source is judged by others, and a large source hardly feels them.
    """

    spread: int = 3
    room: tuple[int, ...] = (20, 5, 50, 500)
    bits: int = 7
    lent: int = 0


def count_words(data: bytes, characters: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text of so many code points."""
    words = data.split()
    inner = characters - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW_WORDS)), strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = bytearray(len(words))
        for at, window in enumerate(windows):
            if times[window] > 1:
                inside[at : at + WINDOW_WORDS] = b"\x01" * WINDOW_WORDS
        repeated = sum(inside)
    return len(words), inner, symbols, len(lines) - len(set(lines)), repeated


def counts_column(text: Column) -> Column:
    """struct of COUNTS for whole texts; null counts as empty."""

    @F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in COUNTS]))
    def per_batch(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            words = value.as_py()
            rows.append(count_words(words.encode(), len(words)))
        columns = zip(*rows, strict=True) if rows else ([] for _ in COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))

    return per_batch(F.coalesce(text, F.lit("")))


def bucket(value: Column, bits: int) -> Column:
    """The value with all but its leading bits cleared: the bucket it falls into in any sketch."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - bits)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def bucket_top(lowest: Column, bits: int) -> Column:
    """The largest value of the bucket that begins at `lowest`."""
    return lowest + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(lowest)) - bits)) - 1


def sketches(measured: DataFrame, keys: list[str], fences: Fences) -> DataFrame:
    """Sketches (*keys, measure, bucket, n) of all measures: a count for each bucket, which merge by adding.

    Counts are added before the shuffle, so a group costs as many rows a task as it has buckets, however large it is.
    """
    cells = F.explode(
        F.array(*(F.struct(F.lit(k).alias("measure"), bucket(F.col(m), fences.bits).alias("bucket")) for k, m in enumerate(MEASURES)))
    )
    return measured.select(*keys, cells.alias("cell")).groupBy(*keys, "cell.measure", "cell.bucket").agg(F.count("*").alias("n"))


def lent_cells(cells: DataFrame, keys: list[str], lent: int) -> DataFrame:
    """Of each sketch (*keys, measure, bucket, n) `lent` documents of equal weight: those in the middle of as many equal parts."""
    group = Window.partitionBy(*keys, "measure")
    merged = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    middles = lambda upto: F.call_function("div", upto * (2 * lent) + F.col("total"), F.col("total") * 2)
    counted = ranked.select(*keys, "measure", "bucket", (middles(F.col("upto")) - middles(F.col("upto") - F.col("n"))).alias("n"))
    return counted.where("n > 0")


def merged_sketches(cells: DataFrame, lent: int) -> DataFrame:
    """Sketches (group, measure, bucket, n) with what all documents lend to each language, and a language to its groups.

    A group gets at most `lent` rows for each measure, however many documents its language has.
    """
    if not lent:
        return cells.select("group", "measure", "bucket", "n")
    cells = checkpointed(cells)
    of_all = cells.select("language").distinct().crossJoin(F.broadcast(lent_cells(cells, [], lent)))
    of_languages = lent_cells(cells.select("language", "measure", "bucket", "n").unionByName(of_all), ["language"], lent)
    of_groups = cells.select("group", "language").distinct().join(of_languages, "language")
    return cells.drop("language").unionByName(of_groups.drop("language"))


def fence_table(cells: DataFrame, key: str, fences: Fences) -> DataFrame:
    """One row per `key`: the range of each measure, from the outer tenths and the median of the merged sketch.

    Upper quantiles are the tops of their buckets, lower ones the bottoms, so that a group of equal values keeps them.
    """
    group = Window.partitionBy(key, "measure")
    ranked = cells.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    reached = lambda tenths: F.when(F.col("upto") * 10 >= F.col("total") * tenths, F.col("bucket"))
    tenths = ranked.groupBy(key, "measure").agg(
        F.min(reached(1)).alias("low"), F.min(reached(5)).alias("middle"), F.min(reached(9)).alias("high")
    )
    room = F.element_at(F.array(*(F.lit(r) for r in fences.room)), F.col("measure") + 1)
    top = bucket_top(F.col("high"), fences.bits)
    most = top + (F.col("high") - F.col("middle")) * fences.spread + room
    least = F.col("low") - (F.col("middle") - F.col("low")) * fences.spread - room
    limits = []
    for k, name in enumerate(MEASURES):
        here = F.col("measure") == k
        limits.append(F.max(F.when(here, most)).alias(f"{name}_most"))
        limits.append(F.max(F.when(here, least if name in TWO_SIDED else F.lit(0))).alias(f"{name}_least"))
    return tenths.groupBy(key).agg(*limits)


def judge(
    df: DataFrame, fences: Fences = Fences(), text: str = "text", identifier: str = "doc_id", language: str = "lang", source: str = "source"
) -> DataFrame:
    """One row per input row: (identifier, COUNTS, base_failed, kept).

    Plain rules fail short and repetitive documents. The others, group by group of language and source, give the
    sketches from which the limits come, merged with what languages and the whole table lend; a document is kept if all
    its measures lie within the limits of its group.
    Texts are read once; the narrow counts are written to the shared folder. The limits are one row a group: the join
    back leaves a popular group to adaptive execution, or is a broadcast if Spark finds the limits small.

    Null texts count as empty and fail. Null language and null source are groups of their own. Repeated rows are judged
    alike and all count. A very long text is one row of counts like any other. Ties do not arise: limits depend on counts
    of values alone, and a value on a limit is kept. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    counted = df.select(
        F.col(identifier).alias("identifier"),
        F.to_json(F.struct(F.col(language).alias("l"), F.col(source).alias("s"))).alias("group"),
        F.to_json(F.struct(F.col(language).alias("l"))).alias("language"),
        counts_column(F.col(text)).alias("counts"),
    ).select("identifier", "group", "language", "counts.*")
    words = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = checkpointed(
        counted.withColumn("base_failed", failed).withColumns(
            {name: F.call_function("div", 1000 * F.col(column), words) for name, column in MEASURES.items()}
        )
    )
    cells = sketches(rows.where("not base_failed"), ["group", "language"], fences)
    limits = fence_table(merged_sketches(cells, fences.lent), "group", fences)
    inside = F.lit(True)
    for name in MEASURES:
        inside = inside & F.col(name).between(F.col(f"{name}_least"), F.col(f"{name}_most"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.join(limits, "group", "left").select(F.col("identifier").alias(identifier), *COUNTS, "base_failed", kept.alias("kept"))
