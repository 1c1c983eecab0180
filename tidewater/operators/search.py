"""Top-k search: vectors, full text, their fusion, and vectors by coarse cells.

A query batch is small next to the corpus, so queries travel to the corpus: each task scores its
own rows against the whole batch and passes on k rows per query. No query-document pairs are
shuffled or joined. What travels is bounded (`BatchLimits`): a larger batch is a stated query set
that is searched in blocks, all of it against all rows, one corpus pass per block. Full text is
searched in an inverted index (`fulltext`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.functions.ordering import top_per_group
from tidewater.operators import fulltext
from tidewater.operators.fulltext import TextIndex
from tidewater.operators.topk import DECIMALS, Best, BatchLimits, emit, top_k_schema

RRF_CONSTANT = 60
# Vector pairs measured at a time in a task, and compared at a time by their norms and products.
PAIRS_AT_ONCE = 1 << 16
PAIRS_COMPARED = 1 << 20
# Bits of a vector's code, rows of a part of a cell, and queries whose codes a part compares at a time.
CODE_BITS = 256
CELL_ROWS = 16_384
QUERIES_AT_ONCE = 16
# Rows of a part that are measured at least, or k if that is less.
LEAST_MEASURED = 4


def matches(filters: Mapping[str, Any] | None) -> Column:
    """AND of equalities over metadata columns."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in (filters or {}).items()], F.lit(True))


def _run_blocks(queries: DataFrame, size: int, limit: int, run) -> DataFrame:
    """Union of `run(block)` over blocks of whole queries, so that a block stays below the bound."""
    blocks = -(-size // limit)
    if blocks <= 1:
        return run(queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [run(queries.where(block == b)) for b in range(blocks)])


def _with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column(1)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(rows: np.ndarray, queries: np.ndarray, metric: str, k: int | None = None) -> np.ndarray:
    """Distance of every row to every query, in double precision. A zero vector is at cosine distance 1.

    Under l2 the norms and products only shortlist, as their difference loses the digits of vectors that lie close
    together. What may be among a query's `k` nearest rows, given the error of that difference, is measured by its
    differences; the rest is infinitely far. Without `k` all pairs are measured so.
    """
    if metric == "l2":
        return _l2(rows, queries, k)
    dots = rows @ queries.T
    if metric == "dot":
        return 1.0 - dots
    if metric == "cosine":
        row_norms, query_norms = (rows**2).sum(axis=1), (queries**2).sum(axis=1)
        scale = np.sqrt(row_norms)[:, None] * np.sqrt(query_norms)[None, :]
        return 1.0 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    raise ValueError(f"unknown metric {metric}: use cosine, l2 or dot")


def _l2(rows: np.ndarray, queries: np.ndarray, k: int | None) -> np.ndarray:
    out = np.full((len(rows), len(queries)), np.inf)
    if k is None or len(rows) <= k:
        near = np.ones(out.shape, dtype=bool)
    else:
        sums = (rows**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :]
        squared = sums - 2.0 * (rows @ queries.T)
        error = 4.0 * (rows.shape[1] + 4) * np.finfo(np.float64).eps * sums
        near = squared - error <= np.partition(squared + error, k - 1, axis=0)[k - 1]
    row, query = np.nonzero(near)
    for start in range(0, len(row), PAIRS_AT_ONCE):
        r, q = row[start : start + PAIRS_AT_ONCE], query[start : start + PAIRS_AT_ONCE]
        out[r, q] = np.sqrt(((rows[r] - queries[q]) ** 2).sum(axis=1))
    return out


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    filters: Mapping[str, Any] | None = None,
    limits: BatchLimits = BatchLimits(),
) -> DataFrame:
    """Exact top-k of `index(id, vector, …)` for `queries(query_id, vector)`: query_id, id, rank, distance.

    Filters apply before the k best are taken. Equal distances are ordered by id.
    """
    distances(np.zeros((1, 1)), np.zeros((1, 1)), metric)
    # Rows without a vector are left out inside the task: as a filter the test would sink below an
    # embedding function and make Spark run it twice.
    corpus = index.where(matches(filters)).select("id", "vector")
    size = queries.count()
    schema = top_k_schema(queries, index.schema["id"])

    def run(block: DataFrame) -> DataFrame:
        local = block.select("query_id", "vector").toArrow()
        query_ids = local.column("query_id").combine_chunks()
        vectors = _matrix(local.column("vector").combine_chunks()) if len(query_ids) else np.zeros((0, 0))
        arrow_schema = to_arrow_schema(schema)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            rows = max(1, PAIRS_COMPARED // max(1, len(query_ids)))
            for batch in _with_vector(batches):
                for start in range(0, batch.num_rows if len(query_ids) else 0, rows):
                    part = batch.slice(start, rows)
                    best.offer(distances(_matrix(part.column(1)), vectors, metric, k), part.column(0))
            yield from emit(best, query_ids, arrow_schema)

        return corpus.mapInArrow(score, schema)

    hits = _run_blocks(queries, size, limits.queries, run)
    ranked = top_per_group(hits, ["query_id"], [F.col("value"), F.col("id")], k)
    return ranked.select("query_id", "id", "rank", F.col("value").alias("distance"))


def search_text(
    index: DataFrame | TextIndex,
    queries: DataFrame,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    limits: BatchLimits = BatchLimits(),
) -> DataFrame:
    """BM25 top-k for `queries(query_id, text)`: query_id, id, rank, score, from a text index or rows `(id, text, …)`.

    Rows are indexed first, in the session's shared folder; keep a `TextIndex` to search it again.
    """
    return fulltext.search(index if isinstance(index, TextIndex) else fulltext.temporary_index(index), queries, k, k1, b, limits)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10, text_weight: float = 0.3) -> DataFrame:
    """Reciprocal rank fusion of two hit lists: query_id, id, rank, score. Ties are ordered by id."""

    def share(hits: DataFrame, weight: float) -> DataFrame:
        return hits.select("query_id", "id", (F.lit(weight) / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("part"))

    scored = (
        share(vector_hits, 1.0 - text_weight)
        .unionByName(share(text_hits, text_weight))
        .groupBy("query_id", "id")
        .agg(F.round(F.sum("part"), 12).alias("score"))
    )
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "id", "rank", "score")


def search_hybrid(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    text_weight: float = 0.3,
    metric: str = "cosine",
    texts: TextIndex | None = None,
) -> DataFrame:
    """Vector and full-text search of `queries(query_id, text, vector)`, 2k candidates each, fused.

    `index` has the vectors; the texts come from it too, unless their text index is given.
    """
    found = search_text(texts or index, queries, 2 * k)
    return fuse(nearest(index, queries, 2 * k, metric), found, k, text_weight)


@dataclass(frozen=True)
class CellModel:
    """Centres of cells, and the directions whose signs are a vector's code."""

    centers: np.ndarray
    directions: np.ndarray
    metric: str

    def normal(self, vectors: np.ndarray) -> np.ndarray:
        """Under cosine, vectors of unit length; zero vectors stay."""
        if self.metric != "cosine":
            return vectors
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norms == 0, 1.0, norms)

    def to_centers(self, vectors: np.ndarray) -> np.ndarray:
        """Distance of each vector to each centre, smaller is closer; by product under dot, as a query's hits may be long."""
        return -(vectors @ self.centers.T) if self.metric == "dot" else distances(self.normal(vectors), self.centers, "l2")

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits(vectors @ self.directions > 0, axis=1).view("<u8")


def train_cells(
    index: DataFrame, cells: int = 256, seed: int = 42, iterations: int = 10, metric: str = "cosine", rows_per_cell: int = 1024
) -> CellModel:
    """Cluster the vectors (distributed k-means), those of unit length under cosine.

    The fit reads at most about `rows_per_cell` rows a cell, chosen by the hash of their id; a smaller table is read whole.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = index.where(F.col("vector").isNotNull())
    share = min(1.0, cells * rows_per_cell / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector").cast("array<double>"))
    vectors = chosen.select(array_to_vector(unit if metric == "cosine" else F.col("vector")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cell").fit(vectors)
    centers = np.asarray(model.clusterCenters(), dtype=np.float64)
    if metric == "cosine":  # a mean of unit vectors is short, and short centres are all about as far
        norms = np.linalg.norm(centers, axis=1, keepdims=True)
        centers = centers / np.where(norms == 0, 1.0, norms)
    width, chance = centers.shape[1], np.random.default_rng(seed)
    turns = [np.linalg.qr(chance.normal(size=(width, width)))[0] for _ in range(-(-CODE_BITS // width))]
    return CellModel(centers, np.concatenate(turns, axis=1)[:, :CODE_BITS], metric)


def assign_cells(index: DataFrame, model: CellModel, overlap: float = 0.03) -> DataFrame:
    """Rows with `cell` and `code`; a vector nearly as close to a second cell, by `overlap` of the distance, is in both.

    Write the table partitioned by `cell` to prune files when searching. Rows without a vector are left out.
    """

    @F.arrow_udf("struct<cells:array<int>,code:binary>")
    def place(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        far = model.to_centers(matrix)
        order = np.argsort(far, axis=1, kind="stable")[:, :2]
        near = np.take_along_axis(far, order, axis=1)
        both = near[:, -1] - near[:, 0] < overlap * np.abs(near[:, 0]) if order.shape[1] > 1 else np.zeros(len(far), dtype=bool)
        keep = np.column_stack([np.ones(len(far), dtype=bool), both])[:, : order.shape[1]]
        offsets = np.append(0, np.cumsum(keep.sum(axis=1))).astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order[keep].astype(np.int32)))
        return pa.StructArray.from_arrays([cells, pa.array([c.tobytes() for c in model.codes(matrix)], pa.binary())], names=["cells", "code"])

    placed = index.where(F.col("vector").isNotNull()).withColumn("_place", place(F.col("vector")))
    kept = [c for c in index.columns if c not in ("cell", "code")]
    return placed.select(*kept, F.explode("_place.cells").alias("cell"), F.col("_place.code").alias("code"))


def cell_parts(index: DataFrame, model: CellModel, limit: int | None = None) -> Column:
    """How many parts of about CELL_ROWS rows the row's cell is cut into: an expression made of the cells' sizes."""
    counted = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    parts = [max(1, -(-counted.get(cell, 0) // (limit or CELL_ROWS))) for cell in range(len(model.centers))]
    return F.element_at(F.array(*(F.lit(p) for p in parts)), F.col("cell").cast("int") + 1)


def probe_table(queries: DataFrame, model: CellModel, probes: int) -> DataFrame:
    """`queries(query_id, vector)` once for each of their `probes` closest cells: query_id, vector, cell."""

    @F.arrow_udf("array<int>")
    def closest(vectors: pa.Array) -> pa.Array:
        order = np.argsort(model.to_centers(_matrix(vectors)), axis=1, kind="stable")[:, :probes].astype(np.int32)
        offsets = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))

    placed = queries.where(F.col("vector").isNotNull()).withColumn("_cells", closest(F.col("vector")))
    return placed.select("query_id", "vector", F.explode("_cells").alias("cell"))


def measured_rows(size: Column, k: int, share: float) -> Column:
    """Of a part of so many rows, how many are measured for a query that probes it."""
    return F.least(size, F.greatest(F.lit(min(k, LEAST_MEASURED)), F.ceil(size * share))).cast("long")


def probe_cost(index: DataFrame, queries: DataFrame, model: CellModel, k: int = 10, probes: int = 8, share: float = 0.25) -> DataFrame:
    """What `nearest_by_cell` measures: query_id and the number of distances to rows that are computed in full."""
    parts = _part_of(index.withColumn("parts", cell_parts(index, model)))
    sizes = parts.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("size"))
    used = share if model.metric == "cosine" else 1.0
    asked = probe_table(queries, model, probes).drop("vector")
    return asked.join(sizes, "cell").groupBy("query_id").agg(F.sum(measured_rows(F.col("size"), k, used)).alias("computed"))


def _part_of(index: DataFrame) -> DataFrame:
    return index.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def nearest_by_cell(
    index: DataFrame,
    queries: DataFrame,
    model: CellModel,
    k: int = 10,
    probes: int = 8,
    share: float = 0.25,
    limits: BatchLimits = BatchLimits(),
) -> DataFrame:
    """Approximate top-k: a query meets the rows of its `probes` closest cells alone, and measures the `share` of them
    whose codes differ least from its own, a few at least (under cosine; other metrics measure all rows of the cells).

    `index` comes from `assign_cells`. Queries and rows meet by (cell, part), so a crowded cell is several groups, of
    about CELL_ROWS rows each; a query batch beyond the limit is cut into chunks that each meet the rows. Only the
    cells' sizes reach the driver. A row that lies in two cells counts once.
    """
    spark = queries.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = min(probes, len(model.centers))
    parts = cell_parts(index, model)
    chunks = max(1, -(-queries.count() // limits.queries))
    whole = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    question = probe_table(queries, model, probes).select(
        F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"),
        "cell",
        whole(parts).alias("part"),
        F.lit(0).alias("kind"),
        "query_id",
        F.col("vector").cast("array<double>").alias("vector"),
    )
    answer = _part_of(index.withColumn("parts", parts)).select(
        whole(F.lit(chunks)).alias("chunk"), "cell", "part", F.lit(1).alias("kind"), "id", F.col("vector").cast("array<double>").alias("vector"), "code"
    )
    both = question.unionByName(answer, allowMissingColumns=True)
    keys = ["chunk", "cell", "part"]
    dealt = both.repartition(partitions, *keys).sortWithinPartitions(*keys, "kind", "id", "query_id")
    schema = top_k_schema(queries, index.schema["id"])
    used = share if model.metric == "cosine" else 1.0
    found = dealt.mapInArrow(partial(_score_parts, model=model, k=k, share=used, schema=to_arrow_schema(schema)), schema)
    # The copies of a row that lies in two cells are equals in this order.
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("value", "id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return best.select("query_id", "id", "rank", F.col("value").alias("distance"))


def _score_parts(batches: Iterator[pa.RecordBatch], model: CellModel, k: int, share: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Groups come one after the other: a part's queries, then its rows."""
    held: list[pa.RecordBatch] = []
    key, asked = None, None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal asked
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        if key[3] == 0:
            asked = (key, rows["query_id"], _matrix(rows["vector"]))
        elif asked is not None and asked[0][:3] == key[:3]:
            yield from emit(_nearest_in_part(rows, asked[2], model, k, share), asked[1], schema)

    for batch in batches:
        keys = [batch[name].to_numpy() for name in ("chunk", "cell", "part", "kind")]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if first < last:
                here = tuple(int(x[first]) for x in keys)
                if held and here != key:
                    yield from close()
                key = here
                held.append(batch.slice(first, last - first))
    if held:
        yield from close()


def _nearest_in_part(rows: pa.RecordBatch, queries: np.ndarray, model: CellModel, k: int, share: float) -> Best:
    vectors, best = _matrix(rows["vector"]), Best(k)
    measured = min(len(vectors), max(min(k, LEAST_MEASURED), math.ceil(len(vectors) * share)))
    if measured == len(vectors):
        best.offer(distances(vectors, queries, model.metric, k), rows["id"])
        return best
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype="<u8").reshape(len(vectors), -1)
    own = model.codes(queries)
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        block = queries[start : start + QUERIES_AT_ONCE]
        differ = np.zeros((len(block), len(vectors)), dtype=np.uint16)
        for word in range(codes.shape[1]):
            differ += np.bitwise_count(codes[None, :, word] ^ own[start : start + len(block), None, word])
        near = np.argsort(differ, axis=1, kind="stable")[:, :measured]
        for q, place in enumerate(near):
            values = np.round(distances(vectors[place], block[q : q + 1], model.metric)[:, 0], DECIMALS)
            first = np.argsort(values, kind="stable")[:k]
            kept = np.flatnonzero(values <= values[first[-1]])
            best.merge(np.full(len(kept), start + q), values[kept], rows["id"].take(pa.array(place[kept])))
    return best


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    return (
        exact.select("query_id", "id")
        .join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n_exact"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )
