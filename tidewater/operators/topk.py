"""What a task keeps of a top-k search: the k best rows for each query of a bounded batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Distances and scores are ranked at this many decimals, so that the order of float additions
# inside a task cannot change the order of hits.
DECIMALS = 9


@dataclass(frozen=True)
class BatchLimits:
    """Largest query block sent to the tasks: number of queries, and (query, term) pairs."""

    queries: int = 1024
    terms: int = 200_000


class Best:
    """The k best rows per query seen by one task."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.value = np.empty(0)
        self.ids: pa.Array | None = None

    def offer(self, values: np.ndarray, ids: pa.Array, allowed: np.ndarray | None = None) -> None:
        """Merge a batch; `values` is rows x queries, smaller is better, +inf means no hit."""
        values = np.round(values, DECIMALS)
        if allowed is not None:
            values = np.where(allowed, values, np.inf)
        if values.shape[0] > self.k:
            worst_kept = np.partition(values, self.k - 1, axis=0)[self.k - 1]
            row, query = np.nonzero((values <= worst_kept) & np.isfinite(values))
        else:
            row, query = np.nonzero(np.isfinite(values))
        self.merge(query, values[row, query], ids.take(pa.array(row)))

    def merge(self, query: np.ndarray, value: np.ndarray, ids: pa.Array) -> None:
        """Merge hits, one per element; values are rounded already."""
        merged_query = np.concatenate([self.query, query])
        merged_value = np.concatenate([self.value, value])
        merged_ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        if not len(merged_query):
            return
        id_order = pc.rank(merged_ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((id_order, merged_value, merged_query))
        sorted_query = merged_query[order]
        starts = np.searchsorted(sorted_query, sorted_query, side="left")
        keep = order[np.arange(len(order)) - starts < self.k]
        self.query, self.value, self.ids = merged_query[keep], merged_value[keep], merged_ids.take(pa.array(keep))

    def kth(self, queries: int) -> np.ndarray:
        """The kth value of each query, +inf for those with fewer."""
        out = np.full(queries, np.inf)
        if len(self.query):
            last = np.flatnonzero(np.append(self.query[1:] != self.query[:-1], True))
            counts = np.diff(np.append(-1, last))
            full = last[counts == self.k]
            out[self.query[full]] = self.value[full]
        return out


def top_k_schema(queries: DataFrame, id_field: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", id_field.dataType),
        T.StructField("value", T.DoubleType()),
    ])


def emit(best: Best, query_ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if best.ids is not None and len(best.ids):
        picked = query_ids.take(pa.array(best.query))
        yield pa.RecordBatch.from_arrays([picked, best.ids.cast(schema.field(1).type), pa.array(best.value)], schema=schema)
