"""Queries over chunking, embedding and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import embed as E
from tidewater.operators import search as S
from tidewater.operators.fulltext import temporary_index
from tidewater.plans.base import query, table
from tidewater.plans.preparation import WORDS_SQL
from tidewater.session import checkpointed
from tidewater.sources.indexes import kept_table, kept_text_index

TERMS = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(
    "chunks",
    f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(ceil(len(w) / 512.0)::BIGINT)) AS i FROM w)
    SELECT doc_id, i::INT AS chunk_no, len(w[i * 512 + 1 : i * 512 + 512])::INT AS n_tokens,
           md5(array_to_string(w[i * 512 + 1 : i * 512 + 512], ' ')) AS digest FROM c""",
)
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    out = E.chunks(table(spark, folder, "documents"), "doc_id")
    return out.select("doc_id", "chunk_no", "n_tokens", F.md5("text").alias("digest"))


@query(
    "chunks_overlapping",
    f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 200) / 150.0), 0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, count(*) AS n_chunks, sum(len(w[i * 150 + 1 : i * 150 + 200]))::BIGINT AS n_tokens FROM c GROUP BY doc_id""",
)
def chunks_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    out = E.chunks(table(spark, folder, "documents"), "doc_id", size=200, overlap=50)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


def _embedded_sql(relation: str, key: str) -> str:
    """Non-zero vector entries of a text table, as (key, bucket, weight)."""
    return f"""(SELECT k, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY k)))::FLOAT::DOUBLE AS weight FROM (
      SELECT k, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n
      FROM (SELECT {key} AS k, unnest({TERMS.format(text='text')}) AS term FROM {relation}) GROUP BY ALL))"""


@query(
    "embed_documents",
    f"SELECT k AS doc_id, bucket::INT AS position, round(weight, 5) AS weight FROM {_embedded_sql('documents', 'doc_id')}",
)
def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    out = E.embed(table(spark, folder, "documents").select("doc_id", "text"))
    # The outer form: a plain explode makes Spark add a filter that embeds every text a second time.
    cells = out.select("doc_id", F.posexplode_outer("vector").alias("position", "weight"))
    return cells.where("weight <> 0").withColumn("weight", F.round(F.col("weight").cast("double"), 5))


def scaled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The given vectors, stretched by label so that the three metrics disagree."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("vector"),
        "label",
    )


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector")
    ).withColumnRenamed("label", "query_id")


CENTROIDS_SQL = """
cells AS (SELECT label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
queries AS (SELECT label AS query_id, list(m ORDER BY p) AS q FROM (
  SELECT label, p, avg(x) AS m FROM cells GROUP BY label, p) GROUP BY label),
corpus AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings)"""
METRIC_SQL = {
    "cosine": "list_cosine_distance(v, q)",
    "l2": "list_distance(v, q)",
    "dot": "1 - list_dot_product(v, q)",
}


def _nearest_sql(metric: str, where: str = "true") -> str:
    return f"""WITH {CENTROIDS_SQL}, d AS (
      SELECT query_id, id, round({METRIC_SQL[metric]}, 9) AS distance FROM corpus, queries WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
    SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10"""


def _nearest(metric: str, filters: dict | None = None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = S.nearest(scaled_vectors(spark, folder), label_centroids(spark, folder), 10, metric, filters)
        return hits.withColumn("distance", F.round("distance", 6))

    return run


for _metric in METRIC_SQL:
    query(f"nearest_{_metric}", _nearest_sql(_metric))(_nearest(_metric))
query("nearest_filtered", _nearest_sql("cosine", "label = 3"))(_nearest("cosine", {"label": 3}))


ROWS_SQL = """
corpus AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings),
queries AS (SELECT id AS query_id, v AS q FROM corpus WHERE id % 100 = 0)"""


def _nearest_rows(metric: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        index = scaled_vectors(spark, folder)
        queries = index.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
        return S.nearest(index, queries, 10, metric).withColumn("distance", F.round("distance", 6))

    return run


for _metric in METRIC_SQL:
    query(f"nearest_rows_{_metric}", _nearest_sql(_metric).replace(CENTROIDS_SQL, ROWS_SQL))(_nearest_rows(_metric))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


BM25_SQL = f"""
dt AS (SELECT doc_id AS id, unnest({TERMS.format(text='text')}) AS term FROM documents),
tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id AS id, len({TERMS.format(text='text')})::DOUBLE AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format(text='text')}) AS term FROM benchmark),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY query_id, id)"""


@query(
    "search_text",
    f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)
    SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
)
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text index is built by the first search of this state of the table, and kept."""
    hits = S.search_text(kept_text_index(corpus(spark, folder), "documents-text"), asked(spark, folder), 10)
    return hits.withColumn("score", F.round("score", 5))


@query(
    "text_index_terms",
    f"""SELECT term, count(DISTINCT doc_id) AS n, count(*) AS occurrences FROM (
      SELECT doc_id, unnest({TERMS.format(text='text')}) AS term FROM documents) GROUP BY term""",
)
def text_index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The text index built anew, and what it says of its terms."""
    index = temporary_index(corpus(spark, folder))
    return index.terms.groupBy("term").agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences"))


@query(
    "search_hybrid",
    f"""WITH {BM25_SQL},
    dv AS MATERIALIZED {_embedded_sql('documents', 'doc_id')},
    qv AS MATERIALIZED {_embedded_sql('benchmark', 'item_id')},
    qn AS (SELECT k, sqrt(sum(weight * weight)) AS norm FROM qv GROUP BY k),
    dn AS (SELECT k, sqrt(sum(weight * weight)) AS norm FROM dv GROUP BY k),
    vs AS (SELECT q.k AS query_id, d.k AS id, round(1 - sum(q.weight * d.weight) / (any_value(qn.norm) * any_value(dn.norm)), 9) AS distance
      FROM qv q JOIN dv d ON q.bucket = d.bucket JOIN qn ON qn.k = q.k JOIN dn ON dn.k = d.k GROUP BY q.k, d.k),
    vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM vs),
    tr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm),
    parts AS (SELECT query_id, id, 0.7::DOUBLE / (60 + r) AS part FROM vr WHERE r <= 20
      UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60 + r) FROM tr WHERE r <= 20),
    fused AS (SELECT query_id, id, round(sum(part), 12) AS score FROM parts GROUP BY query_id, id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused)
    SELECT query_id, id, rank::INT AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 10""",
)
def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Text index and vectors are built by the first search of this state of the table, and kept."""
    texts = corpus(spark, folder)
    vectors = kept_table(texts, "documents-vectors", lambda df: E.embed(df).select("id", "vector"))
    index = kept_text_index(texts, "documents-text")
    hits = S.search_hybrid(vectors, E.embed(asked(spark, folder)), 10, texts=index)
    return hits.withColumn("score", F.round("score", 9))


@query(
    "update_documents",
    """SELECT d.doc_id AS id, md5(coalesce(b.text, d.text)) AS digest, d.lang,
       (b.text IS NOT NULL)::INT AS embedded_again
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def update_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents take the text of the benchmark item of the same number; the rest keep their zero vector."""
    index = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", F.array_repeat(F.lit(0.0).cast("float"), 64).alias("vector"), "lang"
    )
    updates = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = E.update_documents(index, updates)
    again = F.exists("vector", lambda x: x != 0).cast("int")
    return out.select("id", F.md5("text").alias("digest"), "lang", again.alias("embedded_again"))


@query(
    "delete_documents",
    "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_documents(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    ids = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return E.delete_documents(index, ids)


@query(
    "index_stats",
    f"""SELECT count(*) AS num_documents, sum(ceil(len({WORDS_SQL}) / 512.0))::BIGINT AS num_chunks, 64 AS dimension FROM documents""",
)
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as an index whose vectors are the given ones; a document may have none."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return E.index_stats(corpus(spark, folder).join(vectors, "id", "left"))


@query(
    "artifact_search_text",
    """SELECT p_partkey AS id, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type ELSE '' END,
      p_brand || ' ' || 'size' || p_size) AS text FROM part""",
)
def artifact_search_text(spark: SparkSession, folder: str) -> DataFrame:
    description = F.when(F.col("p_size") > 25, F.col("p_type"))
    tags = F.array("p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), E.artifact_search_text(F.col("p_name"), description, tags).alias("text")
    )


def artifact_texts(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array("p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), E.artifact_search_text(F.col("p_name"), F.col("p_type"), tags).alias("text")
    )


@query(
    "search_artifact_texts",
    f"""WITH a AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand || ' size' || p_size AS text FROM part),
    q AS (SELECT DISTINCT p_type AS id, 'blue ' || p_type AS text FROM part),
    av AS MATERIALIZED {_embedded_sql('a', 'id')}, qv AS MATERIALIZED {_embedded_sql('q', 'id')},
    an AS (SELECT k, sqrt(sum(weight * weight)) AS norm FROM av GROUP BY k),
    qn AS (SELECT k, sqrt(sum(weight * weight)) AS norm FROM qv GROUP BY k),
    d AS (SELECT q.k AS query_id, a.k AS id, round(1 - sum(q.weight * a.weight) / (any_value(qn.norm) * any_value(an.norm)), 9) AS distance
      FROM qv q JOIN av a ON q.bucket = a.bucket JOIN qn ON qn.k = q.k JOIN an ON an.k = a.k GROUP BY q.k, a.k),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
    SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10""",
)
def search_artifact_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts by meaning: one query per artifact type, over name, description and tags."""
    asked_types = table(spark, folder, "part").select(
        F.col("p_type").alias("query_id"), F.concat(F.lit("blue "), F.col("p_type")).alias("text")
    ).distinct()
    hits = S.nearest(E.embed(artifact_texts(spark, folder)), E.embed(asked_types), 10)
    return hits.withColumn("distance", F.round("distance", 6))


def _cell_recall(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Recall of the cell search against the exact search, and the share of all distances that it measures, per query."""
    model = S.train_cells(index, cells=16)
    cells = checkpointed(S.assign_cells(index, model))
    found = S.nearest_by_cell(cells, queries, model, k=10, probes=13, share=0.2)
    cost = S.probe_cost(cells, queries, model, k=10, probes=13, share=0.2)
    share = F.col("computed") / F.lit(float(index.count()))
    return S.recall(found, S.nearest(index, queries, 10)).join(cost.select("query_id", share.alias("measured")), "query_id")


@query("nearest_by_cell_recall")
def nearest_by_cell_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per label centroid."""
    index = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _cell_recall(index, label_centroids(spark, folder))


@query("nearest_rows_by_cell_recall")
def nearest_rows_by_cell_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per row whose number is divisible by 100, over all rows."""
    index = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _cell_recall(index, index.where("id % 100 = 0").withColumnRenamed("id", "query_id"))
