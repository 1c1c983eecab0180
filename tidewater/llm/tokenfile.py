"""Token identifiers on disk: patched frame-of-reference blocks, written in document order and read back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewater.llm.bpe import WordBpe, slices
from tidewater.llm.common import bound_batches, partitions

#: Identifiers in a block, and the share of them that must fit the block's width; the others are exceptions.
BLOCK = 128
FITS = 0.9
#: Identifiers after which a segment ends, at the next document.
SEGMENT = 1 << 16
MAGIC = 0x31524650
HEADER = np.dtype([("magic", "<u4"), ("ids", "<u4"), ("blocks", "<u4")])

DOCUMENTS = "part int, segment int, doc_ids array<long>, lengths array<int>, first long, n_ids long, payload binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """A segment: header, then for each block its minimum, width and number of exceptions, then the index of block
    starts, then the blocks. A block is its low bits, packed, and its exceptions: places, then the high bits.
    """
    blocks = -(-len(ids) // BLOCK)
    padded = np.full((blocks, BLOCK), 0, dtype=np.uint32)
    padded.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        padded.ravel()[len(ids) :] = padded[-1, : len(ids) % BLOCK].min()
    lows = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    deltas = padded - lows[:, None]
    at = min(BLOCK - 1, int(BLOCK * FITS))
    widths = bit_lengths(np.partition(deltas, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    high = deltas >> widths[:, None].astype(np.uint32)
    where, place = np.nonzero(high)
    exceptions = np.bincount(where, minlength=blocks)
    sizes = widths * (BLOCK // 8) + exceptions * 5
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(starts[-1]), dtype=np.uint8)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        bits = np.unpackbits(deltas[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits[:, :, :width]).reshape(len(own), -1), axis=1, bitorder="little")
        data[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    number = np.arange(len(where)) - (np.cumsum(exceptions) - exceptions)[where]
    base = starts[where] + widths[where] * (BLOCK // 8)
    data[base + number] = place
    values = high[where, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    data[(base + exceptions[where] + 4 * number)[:, None] + np.arange(4)] = values
    header = np.array([(MAGIC, len(ids), blocks)], dtype=HEADER)
    parts = (header, lows.astype("<u4"), widths.astype(np.uint8), exceptions.astype(np.uint8), starts.astype("<u4"), data)
    return b"".join(p.tobytes() for p in parts)


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Identifiers `first` to `last` of a segment; the index of block starts leads to their blocks, no other is decoded."""
    header = np.frombuffer(segment, HEADER, 1)[0]
    if header["magic"] != MAGIC:
        raise ValueError("not a token segment")
    count, blocks = int(header["ids"]), int(header["blocks"])
    last = count if last is None else min(last, count)
    if last <= first:
        return np.zeros(0, dtype=np.uint32)
    low, up = first // BLOCK, -(-last // BLOCK)
    at = HEADER.itemsize
    lows = np.frombuffer(segment, "<u4", blocks, at)[low:up]
    widths = np.frombuffer(segment, np.uint8, blocks, at + 4 * blocks)[low:up].astype(np.int64)
    exceptions = np.frombuffer(segment, np.uint8, blocks, at + 5 * blocks)[low:up].astype(np.int64)
    starts = np.frombuffer(segment, "<u4", blocks + 1, at + 6 * blocks)[low:up].astype(np.int64)
    data = np.frombuffer(segment, np.uint8, offset=at + 6 * blocks + 4 * (blocks + 1))
    values = np.zeros((up - low, BLOCK), dtype=np.uint32)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        packed = data[starts[own][:, None] + np.arange(width * (BLOCK // 8))]
        bits = np.zeros((len(own), BLOCK, 32), dtype=np.uint8)
        bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, width)
        values[own] = np.packbits(bits, axis=2, bitorder="little").reshape(len(own), -1).view("<u4")
    where = np.repeat(np.arange(up - low), exceptions)
    number = np.arange(len(where)) - (np.cumsum(exceptions) - exceptions)[where]
    base = starts[where] + widths[where] * (BLOCK // 8)
    high = data[(base + exceptions[where] + 4 * number)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    values[where, data[base + number]] |= high << widths[where].astype(np.uint32)
    return (values + lows[:, None]).ravel()[first - low * BLOCK : last - low * BLOCK]


class LibraryBpe(WordBpe):
    """Words are encoded by the tokenizers library itself, many in one call; a word ends with a symbol that says so."""

    remembered = 250_000

    def __init__(self, specification: str, width: int = 4):
        super().__init__(specification)
        if len(self.names) > 1 << (8 * width):
            raise ValueError(f"identifiers of this vocabulary need more than {width} bytes")
        self.kind = np.dtype(f"<u{width}")
        self.library = Tokenizer.from_str(specification)
        suffix = self.names[int(self.last[0])][-4:]
        self.ends_word = np.array([name is not None and name.endswith(suffix) for name in self.names])

    def learn(self, words: list[str]) -> None:
        found = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype=self.kind)
        cuts = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(cuts) != len(words) + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        data, size = ids.tobytes(), self.kind.itemsize
        parts = (data[size * a : size * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.recent.update(zip(words, parts, strict=True))


@lru_cache(maxsize=1)
def library_of(specification: str, width: int) -> LibraryBpe:
    return LibraryBpe(specification, width)


def token_ids(spark: SparkSession, path: str, text: Column, end: int | None, width: int = 4) -> Column:
    """Identifiers of whole texts as little-endian integers of `width` bytes in a binary column, `end` appended to each."""
    bound_batches(spark)
    specification = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    tail = b"" if end is None else np.array([end], dtype=f"<u{width}").tobytes()

    @F.arrow_udf(T.BinaryType())
    def per_batch(texts: pa.Array) -> pa.Array:
        model = library_of(specification.value, width)
        return pa.array([ids + tail for some in slices(texts) for ids in model.encode(some)], pa.binary())

    return per_batch(F.coalesce(text, F.lit("")))


def write_token_files(df: DataFrame, path: str, identifier: str = "doc_id", ids: str = "ids", width: int = 4) -> None:
    """Write documents (identifier, ids binary of little-endian integers of `width` bytes), in ascending order of identifier.

    Borders of the ranges are quantiles of the identifier alone, from a scan that reads no other column; rows then move
    once, each range is sorted and packed by one task, segment by segment. Segments are rows of Parquet files, so Spark's
    commit protocol covers lost executors and repeated attempts, on any store.

    Rows with a null identifier come first. Equal identifiers stay together, in any order. Documents without ids have
    length 0. A document is never cut: its segment is as long as it needs.
    """
    count = partitions(df.sparkSession)
    shares = [k / count for k in range(1, count)]
    found = df.agg(F.percentile_approx(F.col(identifier), shares or [0.5]).alias("q")).first()["q"]
    borders = sorted({b for b in found or [] if b is not None})
    # The border's own rows go left, so that the smallest identifiers are a range even where borders coincide.
    part = range_of(F.col(identifier), borders)
    ordered = (
        df.select(F.col(identifier).cast("long").alias("doc_id"), F.col(ids).alias("ids"), part.alias("part"))
        .repartitionById(len(borders) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id")
    )
    ordered.mapInArrow(partial(_segments, kind=f"<u{width}"), DOCUMENTS).write.option("compression", "uncompressed").parquet(path)


def range_of(value: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are below the value, by bisection; 0 for null."""
    if not borders:
        return F.lit(0)
    array = F.array(*(F.lit(b).cast("long") for b in borders))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))))
    inside = lambda at, step: (at + step <= len(borders)) & (F.element_at(array, F.least(at + step, F.lit(len(borders)))) < value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(inside(at, step), at + step).otherwise(at))


def _segments(batches: Iterator[pa.RecordBatch], kind: str = "<u4") -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, np.ndarray]] = []
    state = {"part": 0, "segment": 0, "first": 0, "ids": 0}

    def close() -> pa.RecordBatch:
        lengths = [len(ids) for _, ids in held]
        row = {
            "part": [state["part"]],
            "segment": [state["segment"]],
            "doc_ids": [[identifier for identifier, _ in held]],
            "lengths": [lengths],
            "first": [state["first"]],
            "n_ids": [sum(lengths)],
            "payload": [pack(np.concatenate([ids for _, ids in held]))],
        }
        state["segment"] += 1
        state["first"] += sum(lengths)
        state["ids"] = 0
        held.clear()
        return pa.RecordBatch.from_pydict(row, schema=_SEGMENT_SCHEMA)

    for batch in batches:
        for identifier, ids, part in zip(batch["doc_id"], batch["ids"], batch["part"], strict=True):
            state["part"] = part.as_py()
            held.append((identifier.as_py(), np.frombuffer(ids.as_buffer() if ids.is_valid else b"", kind)))
            state["ids"] += len(held[-1][1])
            if state["ids"] >= SEGMENT or len(held) >= SEGMENT:
                yield close()
    if held:
        yield close()


_SEGMENT_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_DOCUMENT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids binary) of files that `write_token_files` wrote.

    `start` counts the ids of all documents before: a running sum over one row a part, plus what the segment recorded.
    """
    segments = spark.read.schema(DOCUMENTS).parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = segments.join(F.broadcast(before), "part").select(
        "doc_ids", "lengths", (F.col("first") + F.col("before")).alias("start"), "payload"
    )
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, lengths, start, payload = (batch.column(k)[row] for k in range(4))
            counts = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
            data = unpack(payload.as_buffer()).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(counts)])
            ids = [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [doc_ids.values, pa.array(cuts[:-1] + start.as_py()), pa.array(counts), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_DOCUMENT_SCHEMA)
