"""Hard-negative mining: Fagin's threshold algorithm over the sorted lists of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.ordering import top_per_group
from tidewater.llm.common import bound_batches, partitions
from tidewater.session import checkpointed

#: Rows of a block, which has one sorted list for each dimension, and anchors of a chunk, which a task searches for.
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 8192
#: Anchors whose access goes on at the same time, and the depth of their first round; each round doubles it.
AT_ONCE = 256
FIRST_DEPTH = 32
#: Row and anchor pairs that are multiplied at a time where few are accessed.
GATHERED = 1 << 15
ALL = np.iinfo(np.int64)

PACKED = "kind int, own_ids binary, ids binary, labels binary, vectors binary, extra binary"
FOUND = "row long, slot int, id long, score long"


@dataclass(frozen=True)
class Mining:
    """An anchor's positives are its `positives` best rows of its label; for each, the `negatives` best rows of other
    labels whose score is between `low` and `high` hundredths of the positive's. Vectors are multiplied by `scale` and
    rounded down, so that scores are integers.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256


class Block:
    """Rows with, for each dimension, the row numbers in ascending order of that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.vectors, self.lists = ids, labels, vectors, lists
        self.largest = int(np.abs(vectors.astype(np.float64)).max(initial=0))

    def products(self, kind: type) -> np.ndarray:
        return self.vectors.astype(kind)


class Search:
    """The best `k` rows so far for each anchor and slot: rows whose score lies in the slot's window, of the anchor's
    label or of any other. Blocks come one after the other; what an earlier one gave lets a later one stop earlier.
    """

    def __init__(self, rows, ids, labels, vectors, low, high, same: bool, k: int):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.low, self.high, self.same, self.k = low, high, same, k
        self.scores = np.full((*low.shape, k), ALL.min)
        self.found = np.full((*low.shape, k), ALL.max)
        self.count = np.zeros(low.shape, dtype=np.int64)

    def least(self, anchors: np.ndarray) -> np.ndarray:
        """The lowest score that could still enter a slot of each anchor: its kth once it is full, else the window's lower end."""
        bound = np.where(self.count[anchors] == self.k, self.scores[anchors, :, -1], self.low[anchors])
        return np.where(self.low[anchors] <= self.high[anchors], bound, ALL.max).min(axis=1)

    def see(self, block: Block) -> None:
        wanted = np.flatnonzero((self.low <= self.high).any(axis=1))
        for start in range(0, len(wanted), AT_ONCE):
            self._see(block, wanted[start : start + AT_ONCE])

    def _see(self, block: Block, anchors: np.ndarray) -> None:
        """Sorted access in rounds of doubled depth, from the end of each list that the anchor's sign asks for; random
        access scores what a round met first. An anchor stops when its threshold, the score of the last components met,
        is strictly below what any of its slots still takes.
        """
        asked = self.vectors[anchors]
        kind = exact_kind(block.largest, int(np.abs(asked.astype(np.float64)).max(initial=0)), asked.shape[1])
        rows, queries = block.products(kind), asked.astype(kind)
        count, width = rows.shape
        seen = np.zeros((len(anchors), count), dtype=bool)
        active, depth = np.arange(len(anchors)), 0
        while len(active):
            before, reach = depth, min(count, max(2 * depth, FIRST_DEPTH))
            depth = reach
            old = seen[active]
            for j in range(width):
                up, down = active[asked[active, j] > 0], active[asked[active, j] < 0]
                seen[up[:, None], block.lists[count - reach : count - before, j][None, :]] = True
                seen[down[:, None], block.lists[before:reach, j][None, :]] = True
            if not asked[active].any(axis=1).all():  # a vector of zeros has no list to go by
                seen[active[~asked[active].any(axis=1)]] = True
            fresh = seen[active] & ~old
            self._score(block, rows, queries, anchors, active, fresh)
            if depth == count:
                return
            top = rows[block.lists[count - reach], np.arange(width)]
            bottom = rows[block.lists[reach - 1], np.arange(width)]
            chosen = queries[active]
            threshold = np.where(chosen > 0, chosen, 0) @ top + np.where(chosen < 0, chosen, 0) @ bottom
            active = active[threshold >= self.least(anchors[active])]

    def _score(self, block: Block, rows, queries, anchors, active, fresh) -> None:
        a, r = np.nonzero(fresh)
        if not len(a):
            return
        if 4 * len(a) >= fresh.size:
            scores = (queries[active] @ rows.T)[a, r]
        else:
            cuts = range(0, len(a), GATHERED)
            scores = np.concatenate([(queries[active[a[c : c + GATHERED]]] * rows[r[c : c + GATHERED]]).sum(axis=1) for c in cuts])
        if scores.dtype == object:
            scores = np.array([min(max(int(x), -ALL.max), ALL.max) for x in scores], dtype=np.int64)
        scores = scores.astype(np.int64)
        anchor = anchors[active[a]]
        alike = block.labels[r] == self.labels[anchor]
        wanted = (scores >= self.least(anchors[active])[a]) & ((alike & (block.ids[r] != self.ids[anchor])) if self.same else ~alike)
        anchor, scores, ids = anchor[wanted], scores[wanted], block.ids[r[wanted]]
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchor)], strict=True):
            if last > first:
                self._take(int(anchor[first]), scores[first:last], ids[first:last])

    def _take(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for slot in range(self.low.shape[1]):
            low, high, kept = self.low[anchor, slot], self.high[anchor, slot], self.count[anchor, slot]
            if kept == self.k:
                low = max(low, self.scores[anchor, slot, -1])
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                all_scores = np.concatenate([self.scores[anchor, slot, :kept], scores[inside]])
                all_ids = np.concatenate([self.found[anchor, slot, :kept], ids[inside]])
                best = np.lexsort((all_ids, -all_scores))[: self.k]
                self.count[anchor, slot] = len(best)
                self.scores[anchor, slot, : len(best)] = all_scores[best]
                self.found[anchor, slot, : len(best)] = all_ids[best]

    def results(self) -> pa.RecordBatch:
        a, slot, place = np.nonzero(np.arange(self.k) < self.count[:, :, None])
        columns = [self.rows[a], slot.astype(np.int32), self.found[a, slot, place], self.scores[a, slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "slot", "id", "score"])


def exact_kind(largest: int, asked: int, width: int) -> type:
    """A number type in which scores of components up to these are exact."""
    bound = max(1, largest) * max(1, asked) * max(1, width)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    out[np.repeat(np.arange(len(vectors)), lengths), place] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    fits = not values.size or np.abs(values.astype(np.float64)).max() < 1 << 31
    return values.astype("<i4" if fits else "<i8")


def _pack_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) as blocks of at most BLOCK_ROWS, each with its sorted lists."""
    held: list[pa.RecordBatch] = []

    def close(table: pa.Table) -> pa.RecordBatch:
        vectors = matrix(table["vector"].combine_chunks(), width)
        lists = np.argsort(vectors, axis=0, kind="stable").astype("<u2")
        return _packed(1, b"", table["id"].to_numpy(), table["label"].to_numpy(), narrow(vectors), lists)

    for batch in batches:
        held.append(batch)
        while (rows := sum(b.num_rows for b in held)) >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            yield close(table.slice(0, BLOCK_ROWS))
            held = table.slice(BLOCK_ROWS).to_batches() if rows > BLOCK_ROWS else []
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield close(table)


def _pack_chunks(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Anchors (row, id, label, vector, windows) as chunks with, for each anchor and slot, the window's two ends."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    for start in range(0, table.num_rows, CHUNK_ANCHORS):
        part = table.slice(start, CHUNK_ANCHORS)
        windows = np.empty((part.num_rows, slots, 2), dtype=np.int64)
        windows[:] = (1, 0)
        for k, own in enumerate(part["windows"].to_pylist()):
            for slot, window in enumerate(own[:slots]):
                windows[k, slot] = (window["low"], window["high"])
        vectors = narrow(matrix(part["vector"].combine_chunks(), width))
        yield _packed(0, part["row"].to_numpy(), part["id"].to_numpy(), part["label"].to_numpy(), vectors, windows)


def _packed(kind: int, rows, ids, labels, vectors, extra) -> pa.RecordBatch:
    parts = [rows if isinstance(rows, bytes) else rows.astype("<i8").tobytes(), *(x.astype("<i8").tobytes() for x in (ids, labels))]
    columns = [pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in (*parts, vectors.tobytes(), extra.tobytes()))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "own_ids", "ids", "labels", "vectors", "extra"])


def _search(batches: Iterator[pa.RecordBatch], width: int, slots: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """For each cell of the grid, its chunks of anchors and then all its blocks; yields what the anchors found there."""
    cell, searches = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            here, kind, own, ids, labels, vectors, extra = (batch[name][at] for name in ("cell", *_PARTS))
            if here.as_py() != cell:
                yield from (s.results() for s in searches)
                cell, searches = here.as_py(), []
            ids, labels = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, labels))
            size = len(vectors.as_buffer()) // max(1, len(ids) * width)
            found = np.frombuffer(vectors.as_buffer(), f"<i{size or 4}").reshape(len(ids), width)
            if kind.as_py() == 0:
                rows = np.frombuffer(own.as_buffer(), "<i8")
                windows = np.frombuffer(extra.as_buffer(), "<i8").reshape(len(ids), slots, 2)
                searches.append(Search(rows, ids, labels, found, windows[:, :, 0], windows[:, :, 1], same, k))
            else:
                block = Block(ids, labels, found, np.frombuffer(extra.as_buffer(), "<u2").reshape(len(ids), width))
                for search in searches:
                    search.see(block)
    yield from (s.results() for s in searches)


_PARTS = ("kind", "own_ids", "ids", "labels", "vectors", "extra")


def best_rows(blocks: DataFrame, anchors: DataFrame, count: int, width: int, slots: int, same: bool, k: int) -> DataFrame:
    """(row, slot, id, score, rank): for each of `count` anchors and each of its windows, the best `k` rows of all blocks.

    Anchors in chunks and blocks in parts make a grid; each cell gets its chunks, then streams its blocks. Every row
    meets every anchor's search as a member of a block, and each cell returns k rows a window, which are merged.
    """
    chunks = max(1, -(-count // CHUNK_ANCHORS))
    parts = max(1, -(-partitions(blocks.sparkSession) // chunks))
    packed = (
        anchors.repartitionById(chunks, F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        .mapInArrow(partial(_pack_chunks, width=width, slots=slots), PACKED)
        .withColumn("chunk", F.spark_partition_id())
    )
    across = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    down = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    grid = across.unionByName(down).withColumn("cell", (F.col("chunk") * parts + F.col("part")).cast("int"))
    dealt = grid.select("cell", *_PARTS).repartitionById(chunks * parts, F.col("cell")).sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(partial(_search, width=width, slots=slots, same=same, k=k), FOUND)
    return top_per_group(found, ["row", "slot"], [F.col("score").desc(), F.col("id")], k)


def mine(
    df: DataFrame, anchors: Column, rule: Mining = Mining(), identifier: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    Rows are packed once into blocks with a sorted list for each dimension; two searches run over them, for positives
    and then, in the windows that the positives' scores give, for negatives. Only counts reach the driver.

    Rows with a null identifier, null label, null vector or a null or non-finite component take no part. Shorter vectors
    count as ending in zeros, an empty one as zeros. Labels are integers. Ties go to the smaller identifier. Rows that
    share an identifier each count as candidates, none of them as another's positive; an anchor row that repeats gives
    its result again. Components and scores beyond a long saturate. A window without a row gives none. An empty table,
    or one without anchors, gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = df.select(
        F.col(identifier).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("raw"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    clean = named.dropna(subset=["id", "label", "raw"]).where(~F.exists("raw", bad))
    rows = clean.select("id", "label", "anchor", F.transform("raw", lambda x: F.floor(x * rule.scale)).alias("vector"))
    size = rows.agg(F.max(F.size("vector")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    width, count = size["width"] or 1, size["anchors"]
    blocks = checkpointed(rows.select("id", "label", "vector").mapInArrow(partial(_pack_blocks, width=width), PACKED))
    asked = checkpointed(rows.where("anchor").select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector"))
    everything = F.array(F.struct(F.lit(int(ALL.min)).cast("long").alias("low"), F.lit(int(ALL.max)).cast("long").alias("high")))
    near = checkpointed(best_rows(blocks, asked.withColumn("windows", everything), count, width, 1, True, rule.positives))
    wide = F.col("score").cast("decimal(38,0)")
    lowest = F.call_function("div", wide * rule.low + 99, F.lit(100))
    highest = F.call_function("div", wide * rule.high, F.lit(100))
    ends = F.struct("rank", F.when(F.col("score") >= 0, lowest).otherwise(1).alias("low"), F.when(F.col("score") >= 0, highest).otherwise(0).alias("high"))
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(ends)).alias("windows"))
    hard = best_rows(blocks, asked.join(windows, "row"), count, width, rule.positives, False, rule.negatives)
    positive = near.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hard.join(positive, ["row", "slot"])
        .join(asked.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
