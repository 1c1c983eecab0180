"""Chunking and embedding of documents, and upkeep of the index table (id, text, vector, metadata)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X

Embedder = Callable[[pa.Array], np.ndarray]
# Terms whose hashes a task remembers.
REMEMBERED_TERMS = 200_000


def chunks(df: DataFrame, key: str, text: str = "text", size: int = 512, overlap: int = 0) -> DataFrame:
    """Cut texts into windows of `size` words, `overlap` of them shared with the window before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap
    split = df.withColumn("_words", X.words(F.col(text)))
    # The last window is the first one that reaches the end of the text.
    last = F.greatest(F.ceil((F.size("_words") - size) / step), F.lit(0)).cast("int")
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return (
        split.select(key, "_words", F.explode(starts).alias("chunk_no"))
        .withColumn("_part", F.slice("_words", F.col("chunk_no") * step + 1, size))
        .select(key, "chunk_no", F.size("_part").alias("n_tokens"), F.array_join("_part", " ").alias("text"))
    )


def hashed_words(dimensions: int = 64) -> Embedder:
    """Bag-of-words embedder without weights: counts per hash bucket, scaled to unit length."""
    known: dict[str, int] = {}

    def bucket(term: str) -> int:
        found = known.get(term)
        if found is None:
            found = known[term] = int.from_bytes(md5(term.encode()).digest()[:4]) % dimensions
        return found

    def embed(terms: pa.ListArray) -> np.ndarray:
        if len(known) > REMEMBERED_TERMS:
            known.clear()
        coded = terms.flatten().dictionary_encode()
        buckets = np.array(list(map(bucket, coded.dictionary.to_pylist())), dtype=np.int64)
        cells = pc.list_parent_indices(terms).to_numpy() * dimensions + buckets[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(terms) * dimensions).reshape(len(terms), dimensions)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(norms == 0, 1.0, norms)

    return embed


def embedding(prepared: Column, embedder: Callable[[], Embedder]) -> Column:
    """Vector column of a prepared column; a null has no vector."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = embedder()
        for batch in batches:
            vectors = embed(batch).astype(np.float32)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=batch.is_null())

    return run(prepared)


def embed(
    df: DataFrame,
    text: str = "text",
    vector: str = "vector",
    embedder: Callable[[], Embedder] = hashed_words,
    prepare: Callable[[Column], Column] = X.terms,
) -> DataFrame:
    """Add a vector per text.

    `embedder` is a factory, so a model is loaded once per task; it maps an Arrow array of what
    `prepare` makes of the text (terms, or the text itself for a model) to a matrix.
    """
    return df.withColumn(vector, embedding(prepare(F.col(text)), embedder))


def content_id(df: DataFrame, text: str = "text", name: str = "id") -> DataFrame:
    """Ids from the content, so that two batches never hand out the same id for different texts."""
    return df.withColumn(name, F.concat(F.lit("doc_"), F.substring(F.sha2(F.col(text), 256), 1, 32)))


def index_rows(
    df: DataFrame,
    key: str | None,
    text: str = "text",
    metadata: Sequence[str] = (),
    embedder: Callable[[], Embedder] = hashed_words,
) -> DataFrame:
    """Rows of an index table; without a key column the id comes from the content."""
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *metadata) if key else content_id(
        df.select(F.col(text).alias("text"), *metadata)
    )
    return embed(base, embedder=embedder).select("id", "text", "vector", *metadata)


def write_index(rows: DataFrame, path: str) -> str:
    """Create the index table, replacing an older one."""
    rows.write.mode("overwrite").parquet(path)
    return path


def add_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def update_documents(
    index: DataFrame, updates: DataFrame, embedder: Callable[[], Embedder] = hashed_words, order: str | None = None
) -> DataFrame:
    """Index rows with new texts by id; only changed texts are embedded again.

    Of several updates of an id the one with the largest `order` counts, or without that the largest text.
    """
    position = F.struct(*([order] if order else []), "text")
    single = updates.groupBy("id").agg(F.max_by("text", position).alias("text"))
    changes = embed(single, embedder=embedder).select(
        "id", F.col("text").alias("_text"), F.col("vector").alias("_vector")
    )
    others = [c for c in index.columns if c not in ("id", "text", "vector")]
    return index.join(changes, "id", "left").select(
        "id",
        F.coalesce("_text", "text").alias("text"),
        F.coalesce("_vector", "vector").alias("vector"),
        *others,
    )


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def index_stats(index: DataFrame, text: str = "text", chunk_size: int = 512) -> DataFrame:
    """Documents, chunks and vector dimension in one pass."""
    n_chunks = F.ceil(F.size(X.words(F.col(text))) / F.lit(float(chunk_size)))
    return index.agg(
        F.count(F.lit(1)).alias("num_documents"),
        F.sum(n_chunks).cast("long").alias("num_chunks"),
        F.max(F.size("vector")).alias("dimension"),
    )


def artifact_search_text(name: Column, description: Column, tags: Column) -> Column:
    """The text an artifact is found by: name, description if any, tags."""
    return F.concat_ws(" ", name, F.coalesce(description, F.lit("")), F.array_join(tags, " "))
