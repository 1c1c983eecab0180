"""Full-text search in an inverted index: postings of a term by blocks of documents, and top-k that skips blocks.

A posting row is a term in a block of documents: which documents have it, how often, and how long they are, besides the
largest count and the smallest length, which bound what the term can add to a score there. Rows lie in folders by the
hash of their term, so a search opens the folders of its own terms alone. Documents are added as further segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.functions import text as X
from tidewater.functions.ordering import top_per_group
from tidewater.operators.topk import DECIMALS, Best, BatchLimits, emit, top_k_schema
from tidewater.session import ensure_checkpoint_dir

# Documents in a block, folders of an index by its number of documents, and blocks of one term written by one task.
BLOCK_DOCUMENTS = 512
LEAST_BUCKETS, BUCKET_DOCUMENTS = 16, 1 << 16
TASK_BLOCKS = 4096
# Blocks that one task lists, documents whose postings one task writes on average, and documents that one task searches.
LISTED_BLOCKS = 32
WRITTEN_DOCUMENTS = 1 << 13
SEARCHED_DOCUMENTS = 1 << 16
# So many terms are compared in the scan, which then skips row groups; Parquet makes a range of more than these.
PUSHED_TERMS = 10
# Bounds are sums of floats in another order than scores; a block is skipped only if it is worse by more than this.
SLACK = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """An index that `write_text_index` wrote: its tables, and the number of folders that terms are hashed to."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def posting_rows(documents: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Rows (bucket, term, block, n, occurrences, max_count, min_length, ids, counts, lengths) of `documents(id, text)`.

    Texts move once, to their blocks, where a task counts and lists the terms of one block at a time. A term that all
    documents have is a row for each block, so none of its lists is longer than a block. Tasks are dealt their blocks in
    turn, and more blocks make more tasks.
    """
    placed = documents.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    tasks = max(_partitions(documents.sparkSession), -(-blocks // LISTED_BLOCKS))
    split = (
        placed.repartitionById(tasks, F.pmod(F.col("block"), F.lit(tasks)).cast("int"))
        .sortWithinPartitions("block")
        .select("block", "id", X.terms(F.col("text")).alias("terms"))
    )
    schema = T._parse_datatype_string(_posting_columns(documents.schema["id"].dataType.simpleString()))
    listed = split.mapInArrow(partial(_list_blocks, schema=to_arrow_schema(schema)), schema)
    return listed.withColumn("bucket", _bucket(F.col("term"), buckets))


def _posting_columns(id_type: str) -> str:
    return (
        "term string, block long, n long, occurrences long, max_count int, min_length int,"
        f" ids array<{id_type}>, counts array<int>, lengths array<int>"
    )


def _list_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Posting rows of documents (block, id, terms) that come block by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch["block"].to_numpy()
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if first == last:
                continue
            if held and held[-1]["block"][0].as_py() != block[first]:
                yield _list_block(pa.Table.from_batches(held), schema)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield _list_block(pa.Table.from_batches(held), schema)


def _list_block(rows: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    terms, ids = rows["terms"].combine_chunks(), rows["id"].combine_chunks()
    coded = terms.flatten().dictionary_encode()
    documents = len(ids)
    cells = coded.indices.to_numpy().astype(np.int64) * documents + pc.list_parent_indices(terms).to_numpy()
    cell, counts = np.unique(cells, return_counts=True)
    code, document = cell // documents, cell % documents
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)[document]
    offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
    reduce = lambda with_, values: with_.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)
    columns = [
        coded.dictionary.take(pa.array(code[starts])),
        np.full(len(starts), rows["block"][0].as_py()),
        np.diff(np.append(starts, len(code))),
        reduce(np.add, counts),
        reduce(np.maximum, counts),
        reduce(np.minimum, lengths),
        pa.ListArray.from_arrays(offsets, ids.take(pa.array(document))),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(lengths.astype(np.int32))),
    ]
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def posting_groups(documents: int, blocks: int, buckets: int) -> int:
    """Ranges of blocks that the postings of a folder are written by, a task each: their size stays, their number grows."""
    return min(blocks, max(-(-blocks // TASK_BLOCKS), -(-documents // (WRITTEN_DOCUMENTS * buckets))))


def write_text_index(documents: DataFrame, path: str, segment: int = 0, block_documents: int = BLOCK_DOCUMENTS) -> TextIndex:
    """Index `documents(id, text)` as one segment below `path`; writing a segment again replaces it.

    The row of totals is written last: a segment without it does not count, so a failed run leaves no half index.
    Documents of later segments must have other ids. A null text has no term.
    """
    spark = documents.sparkSession
    count = documents.count()
    if segment:
        buckets = text_index(spark, path).buckets
    else:
        buckets = max(LEAST_BUCKETS, -(-count // BUCKET_DOCUMENTS))
    blocks = max(1, -(-count // block_documents))
    rows = posting_rows(documents, blocks, buckets)
    # Every range of blocks of a folder has its own task: hashed to tasks, several of so few would meet in one.
    groups = posting_groups(count, blocks, buckets)
    group = F.call_function("div", F.col("block") * groups, F.lit(blocks))
    folder = f"segment={segment}"
    rows.repartitionById(buckets * groups, (F.col("bucket") * groups + group).cast("int")).sortWithinPartitions("bucket", "term", "block").write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(f"{path}/postings/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/postings/{folder}")
    terms = written.groupBy("bucket", "term").agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences"))
    # A folder gets one file.
    terms.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/{folder}")
    counted = spark.read.schema(terms.schema).parquet(f"{path}/terms/{folder}")
    totals = counted.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("length")).select(
        F.lit(count).cast("long").alias("documents"), "length", F.lit(buckets).alias("buckets"), _id_type(documents).alias("id_type")
    )
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals/{folder}")
    return text_index(spark, path)


def _id_type(documents: DataFrame) -> Column:
    return F.lit(documents.schema["id"].dataType.simpleString())


def text_index(spark: SparkSession, path: str) -> TextIndex:
    """The index below `path`, with all segments that were written to their end."""
    schema = "segment int, documents long, length long, buckets int, id_type string"
    totals = spark.read.schema(schema).json(f"{path}/totals").collect()
    segments = [r["segment"] for r in totals]
    # Column types are given, as an index may have no row to infer them from.
    postings = f"segment int, bucket int, {_posting_columns(totals[0]['id_type'])}"
    terms = "segment int, bucket int, term string, n long, occurrences long"
    read = lambda name, columns: spark.read.schema(columns).parquet(f"{path}/{name}").where(F.col("segment").isin(segments))
    sums = [sum(r[name] for r in totals) for name in ("documents", "length")]
    return TextIndex(read("postings", postings), read("terms", terms), *sums, totals[0]["buckets"])


def temporary_index(documents: DataFrame) -> TextIndex:
    """An index in the session's shared folder, for one search."""
    folder = ensure_checkpoint_dir(documents.sparkSession).rstrip("/")
    return write_text_index(documents.select("id", "text"), f"{folder}/text-index-{uuid4().hex}")


def search(
    index: TextIndex,
    queries: DataFrame,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    limits: BatchLimits = BatchLimits(),
) -> DataFrame:
    """BM25 top-k for `queries(query_id, text)`: query_id, id, rank, score.

    Only folders of asked terms are opened, and only rows of asked terms leave the scan. They meet the queries block by
    block in a grid of query chunks and block groups; a task scores the blocks whose bound reaches the kth score that a
    query has there so far, and skips the others, which cannot hold a hit. A query's repeated terms count once. Equal
    scores are ordered by id. Nothing but counts and folder numbers reaches the driver.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.posexplode(F.array_distinct(X.terms(F.col("text")))).alias("place", "term")).withColumn(
        "bucket", _bucket(F.col("term"), index.buckets)
    )
    facts = asked.agg(
        F.collect_set("bucket").alias("buckets"), F.count(F.lit(1)).alias("terms"), F.count_if(F.col("place") == 0).alias("queries")
    ).first()
    mine = F.col("bucket").isin(sorted(facts["buckets"]))
    if facts["terms"] <= PUSHED_TERMS:
        mine = mine & F.col("term").isin(sorted(r["term"] for r in asked.select("term").distinct().collect()))
    chunks = max(1, -(-facts["queries"] // limits.queries))
    parts = max(1, -(-_partitions(spark) // chunks), -(-index.documents // SEARCHED_DOCUMENTS))

    known = index.terms.where(mine).groupBy("term").agg(F.sum("n").alias("n"))
    idf = F.log1p((index.documents - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = asked.join(known, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("weight")))).alias("pairs"))
    whole = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    question = weights.select(
        F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), whole(parts).alias("part"), F.lit(0).alias("kind"), "query_id", "pairs"
    )
    rows = index.postings.where(mine).join(asked.select("term").distinct(), "term", "left_semi")
    answer = rows.select(
        whole(chunks).alias("chunk"),
        F.pmod(F.xxhash64("segment", "block"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"),
        # A block's rows follow each other; a segment's blocks have numbers of their own.
        (F.col("segment").cast("long") * (1 << 40) + F.col("block")).alias("block"),
        "term",
        "max_count",
        "min_length",
        "ids",
        "counts",
        "lengths",
    )
    grid = question.unionByName(answer, allowMissingColumns=True).withColumn("cell", F.col("chunk") * parts + F.col("part"))
    dealt = grid.drop("chunk", "part").repartitionById(chunks * parts, F.col("cell")).sortWithinPartitions("cell", "kind", "block", "term", "query_id")
    schema = top_k_schema(queries, T.StructField("id", index.postings.schema["ids"].dataType.elementType))
    mean = index.length / index.documents if index.length else 1.0
    hits = dealt.mapInArrow(partial(_score, k=k, k1=k1, b=b, mean=mean, schema=to_arrow_schema(schema)), schema)
    ranked = top_per_group(hits, ["query_id"], [F.col("value"), F.col("id")], k)
    return ranked.select("query_id", "id", "rank", (-F.col("value")).alias("score"))


class _Cell:
    """The queries of a cell of the grid as (query, term, weight) pairs, and their best hits so far."""

    def __init__(self, rows: pa.RecordBatch, k: int, k1: float, b: float, mean: float):
        self.ids = rows["query_id"]
        pairs = rows["pairs"].to_pylist()
        self.vocabulary = {term: n for n, term in enumerate(sorted({p["term"] for own in pairs for p in own}))}
        self.query = np.repeat(np.arange(len(pairs)), [len(own) for own in pairs])
        self.term = np.array([self.vocabulary[p["term"]] for own in pairs for p in own], dtype=np.int64)
        self.weight = np.array([p["weight"] for own in pairs for p in own])
        self.best, self.worst = Best(k), np.full(len(pairs), np.inf)
        self.k, self.k1, self.b, self.mean = k, k1, b, mean
        self.scored = 0

    def _part(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / self.mean))

    def see(self, rows: pa.RecordBatch) -> None:
        """A block's postings: bound each query's scores in it, and score those that may still enter."""
        term = np.array([self.vocabulary.get(t, -1) for t in rows["term"].to_pylist()])
        if (term < 0).any():  # asked by another chunk of queries
            rows, term = rows.filter(pa.array(term >= 0)), term[term >= 0]
        at = np.full(len(self.vocabulary), -1)
        at[term] = np.arange(len(term))
        number = lambda name: rows[name].to_numpy(zero_copy_only=False).astype(np.float64)
        row = at[self.term]
        present = np.flatnonzero(row >= 0)
        query, weight, row = self.query[present], self.weight[present], row[present]
        most = self._part(number("max_count"), number("min_length"))
        bound = np.bincount(query, weights=weight * most[row], minlength=len(self.ids))
        open_ = (bound > 0) & (bound + SLACK >= -self.worst)
        keep = open_[query]
        query, weight, row = query[keep], weight[keep], row[keep]
        if not len(query):
            return
        sizes = rows["ids"].value_lengths().to_numpy().astype(np.int64)
        coded = rows["ids"].flatten().dictionary_encode()
        document = coded.indices.to_numpy()
        flat = lambda name: rows[name].flatten().to_numpy().astype(np.float64)
        parts = self._part(flat("counts"), flat("lengths"))
        width, asking = len(coded.dictionary), np.flatnonzero(open_)
        local = np.searchsorted(asking, query)
        ends = np.cumsum(sizes[row])
        place = np.arange(ends[-1]) - np.repeat(ends - sizes[row], sizes[row]) + np.repeat((np.cumsum(sizes) - sizes)[row], sizes[row])
        cells = np.repeat(local, sizes[row]) * width + document[place]
        scores = np.bincount(cells, weights=np.repeat(weight, sizes[row]) * parts[place], minlength=len(asking) * width)
        values = np.where(scores > 0, -np.round(scores, DECIMALS), np.inf).reshape(len(asking), width)
        self.scored += len(place)
        limit = self.worst[asking]
        if width > self.k:
            limit = np.minimum(limit, np.partition(values, self.k - 1, axis=1)[:, self.k - 1])
        q, d = np.nonzero((values <= limit[:, None]) & np.isfinite(values))
        self.best.merge(asking[q], values[q, d], coded.dictionary.take(pa.array(d)))
        self.worst = self.best.kth(len(self.ids))


def _score(batches: Iterator[pa.RecordBatch], k: int, k1: float, b: float, mean: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cells come one after the other: first their queries, then their postings, block by block."""
    held: list[pa.RecordBatch] = []
    key, cell = None, None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal cell
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        if key[1] == 0:
            cell = _Cell(rows, k, k1, b, mean)
        elif cell is not None:
            cell.see(rows)

    for batch in batches:
        keys = [np.array(batch[name].fill_null(-1)) for name in ("cell", "kind", "block")]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if first == last:
                continue
            here = tuple(int(x[first]) for x in keys)
            if here != key:
                close()
                if cell is not None and here[0] != key[0]:
                    yield from emit(cell.best, cell.ids, schema)
                    cell = None
                key = here
            held.append(batch.slice(first, last - first))
    close()
    if cell is not None:
        yield from emit(cell.best, cell.ids, schema)
