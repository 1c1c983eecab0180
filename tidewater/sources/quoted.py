"""CSV files whose quoted values hold line breaks, read by many tasks.

A task that reads a range of a file cannot tell whether it begins inside quotes. But it can tell, for either case, how
its range ends: a function from two states to two. These functions compose, so a first pass gives one small row a range,
the rows of a file in order give the state each range begins in, and a second pass cuts the ranges into records. A record
that crosses ranges is joined from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import checkpointed, ensure_checkpoint_dir

# A quoted value's inside up to its last quote, or to the end; two quotes are one within it.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
_LEFT_OPEN = re.compile(rf'{_FIELDS}"{_INSIDE}\Z')
_CLOSED = re.compile(rf'{_INSIDE}"[^,]*+')
# Stands for a line break inside a value while records are lines, and for itself.
MARK = ""
MARKED = ((MARK, f"{MARK}e"), ("\n", f"{MARK}n"), ("\r", f"{MARK}r"))
# Ranges whose states are sent along; the rows of more are joined and sorted.
SENT_RANGES = 100_000

RANGE = "file string, start long, from_outside boolean, from_inside boolean, closes boolean, breaks boolean"
PIECE = "file string, start long, owner long, first boolean, whole boolean, text string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line that begins outside or inside one."""
    if inside:
        closed = _CLOSED.match(line)
        if not closed:
            return True
        if closed.end() == len(line):
            return False
        line = line[closed.end() + 1 :]
    return '"' in line and _LEFT_OPEN.match(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and the place where their range begins, in order within a range."""
    place = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(
        place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.col("value").alias("line")
    )


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[str], bool]]:
    """(key, lines, new) of each run of rows with equal `names`; new if the key differs from the run's before."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch[name].to_pylist() for name in names), strict=True))
        lines = batch["line"].to_pylist()
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at], lines[at:end], keys[at] != last
            last, at = keys[at], end


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: how it ends from outside and from inside; whether, from inside, the value is closed in it."""
    done, now = [], None
    for key, lines, new in _runs(batches, "file", "start"):
        if new:
            if now:
                done.append(now)
            now = [*key, False, True, False, False]
        for line in lines:
            outside, inside = now[2], now[3]
            now[2] = ends_inside(line, outside)
            now[3] = now[2] if outside == inside else ends_inside(line, inside)
            now[4] = now[4] or not now[3]
            now[5] = now[5] or now[2]
    if now:
        done.append(now)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "start", "from_outside", "from_inside", "closes", "breaks"])


def range_states(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, owner): the state each range begins in, and the range where the value open there began.

    Of the four functions two forget the state before; after the last of those, what counts is how many of the others
    swap the states. A file has one row here for each range, so these windows are narrow.
    """
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    forgets = F.col("from_outside") == F.col("from_inside")
    swaps = F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)
    counted = ranges.withColumn("swaps", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    # The state that a forgetting range leaves, less the swaps counted by then, so that later ones can be added.
    left = F.when(forgets, F.pmod(F.col("from_outside").cast("int") - F.col("swaps"), F.lit(2)))
    known = counted.withColumn("left", F.coalesce(F.last(left, ignorenulls=True).over(before), F.lit(0)))
    stated = known.withColumn("inside", F.pmod(F.col("left") + F.col("swaps"), F.lit(2)) == 1)
    opens = F.when(F.col("inside"), F.col("from_inside") & F.col("closes")).otherwise(F.col("from_outside"))
    return stated.select("file", "start", "inside", F.max(F.when(opens, F.col("start"))).over(before).alias("owner"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the ranges, line breaks marked, and pieces of those that cross a border of ranges."""
    rows: list[tuple] = []
    key, state, held, own, first = None, False, [], True, False

    def close(whole: bool) -> None:
        nonlocal held, first
        text = "\n".join(held)
        held = []
        owner = key[1] if own else key[3]
        rows.append((key[0], key[1], owner, first and own, whole and own, marked(text) if whole and own else text))
        first = False if own else first

    for here, lines, new in _runs(batches, "file", "start", "inside", "owner"):
        if new:
            if held:
                close(False)
            key, state, own, first = here, here[2], not here[2], here[1] == 0
        for line in lines:
            held.append(line)
            state = ends_inside(line, state)
            if not state:
                close(True)
                own = True
        if len(rows) >= 4096:
            yield _piece_batch(rows)
            rows = []
    if held:
        close(False)
    if rows:
        yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "start", "owner", "first", "whole", "text"])


def marked(record: str) -> str:
    record = record[:-1] if record.endswith("\r") else record
    if "\n" in record or "\r" in record or MARK in record:
        for plain, mark in MARKED:
            record = record.replace(plain, mark)
    return record


def _marked_column(record: Column) -> Column:
    out = F.regexp_replace(record, r"\r\z", "")
    for plain, mark in MARKED:
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def _unmarked(value: Column) -> Column:
    for plain, mark in reversed(MARKED):
        value = F.replace(value, F.lit(mark), F.lit(plain))
    return value


def _with_header(batches: Iterator[pa.RecordBatch], header: str) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"value": [header]})
    yield from batches


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header, or a folder of them, as Spark's multi-line reader gives it, but split over tasks.

    Values are quoted by `"`, doubled inside a value; records end at `\\n` or `\\r\\n`. If no quoted value holds a line
    break, as the first pass tells, the files are read as they are. Else their records are written once more to the
    session's shared folder, one a line, and Spark reads and infers those. A record must fit a row. Line breaks in values
    stay as the file has them; the multi-line reader makes `\\r\\n` a `\\n` in files whose lines end so.
    """
    reader = (lambda: spark.read.schema(schema)) if schema is not None else (lambda: spark.read)
    options = {"header": True, "inferSchema": schema is None, "escape": '"'}
    ranges = checkpointed(_lines(spark, path).mapInArrow(_functions, RANGE))
    facts = ranges.agg(F.bool_or("breaks").alias("breaks"), F.count(F.lit(1)).alias("ranges"), F.min("file").alias("file")).first()
    if not facts["breaks"]:
        return reader().csv(path, **options)
    states = range_states(ranges)
    if facts["ranges"] <= SENT_RANGES:
        ordered = _lines(spark, path).join(F.broadcast(states), ["file", "start"])
    else:
        numbered = _lines(spark, path).withColumn("n", F.monotonically_increasing_id())
        ordered = numbered.join(states, ["file", "start"]).sortWithinPartitions("file", "start", "n")
    pieces = checkpointed(ordered.select("file", "start", "inside", "owner", "line").mapInArrow(_records, PIECE))
    joined = (
        pieces.where("not whole")
        .groupBy("file", "owner")
        .agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    )
    crossing = joined.select("file", "first", _marked_column(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("value"))
    records = pieces.where("whole").select("file", "first", F.col("text").alias("value")).unionByName(crossing)
    header = records.where(F.col("first") & (F.col("file") == facts["file"])).first()["value"]
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid4().hex}"
    body = records.where("not first").select("value")
    body.mapInArrow(partial(_with_header, header=header), "value string").write.text(folder)
    read = reader().csv(folder, **options)
    kept = [_unmarked(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in read.schema]
    names = read.columns
    for plain, mark in reversed(MARKED):
        names = [name.replace(mark, plain) for name in names]
    return read.select(*(c.alias(name) for c, name in zip(kept, names, strict=True)))
