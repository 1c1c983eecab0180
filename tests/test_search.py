import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import embed as E
from tidewater.operators import fulltext
from tidewater.operators import search as S
from tidewater.plans import retrieval
from tidewater.sources import indexes

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8)).astype(np.float32) * rng.uniform(0.1, 5, size=(300, 1)).astype(np.float32)
    data[10] = data[11]
    data[20] = 0
    return data


def as_frame(spark, data, key="id"):
    rows = [(int(i), [float(x) for x in v], int(i % 3)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} long, vector array<float>, kind int")


def brute(data, queries, k, metric, allowed):
    out = {}
    d = np.round(S.distances(data.astype(float), queries.astype(float), metric), 9)
    for q in range(len(queries)):
        out[q] = sorted((d[i, q], i) for i in allowed)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
@pytest.mark.parametrize("partitions,block", [(1, 1024), (16, 3)])
def test_nearest_matches_brute_force(spark, vectors, metric, partitions, block):
    queries = as_frame(spark, vectors[:12], "query_id").drop("kind")
    hits = S.nearest(as_frame(spark, vectors).repartition(partitions), queries, 5, metric, limits=S.BatchLimits(queries=block))
    expected = brute(vectors, vectors[:12], 5, metric, range(300))
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    assert len(got) == 12
    for q, rows in got.items():
        assert [i for _, i, _ in sorted(rows)] == [i for _, i in expected[q]]
        np.testing.assert_allclose([d for _, _, d in sorted(rows)], [d for d, _ in expected[q]], atol=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_pairs_compared_at_a_time_are_bounded(spark, vectors, monkeypatch, metric):
    """A batch of rows is compared part by part, so that memory does not grow with the queries of a block."""
    index, queries = as_frame(spark, vectors), as_frame(spark, vectors[:40], "query_id")
    whole = S.nearest(index.coalesce(1), queries, 5, metric).select("query_id", "id", "rank").collect()
    measure = S.distances

    def bounded(rows, asked, *args):
        assert len(rows) * len(asked) <= 400
        return measure(rows, asked, *args)

    monkeypatch.setattr(S, "PAIRS_COMPARED", 400)
    monkeypatch.setattr(S, "distances", bounded)
    assert sorted(S.nearest(index.coalesce(1), queries, 5, metric).select("query_id", "id", "rank").collect()) == sorted(whole)


def test_filter_comes_before_the_cut_and_k_may_exceed_the_table(spark, vectors):
    queries = as_frame(spark, vectors[:2], "query_id").drop("kind")
    hits = S.nearest(as_frame(spark, vectors), queries, 500, filters={"kind": 1})
    assert hits.groupBy("query_id").count().select("count").distinct().collect() == [(100,)]
    assert S.nearest(as_frame(spark, vectors), queries, 5, filters={"kind": 9}).isEmpty()
    assert S.nearest(as_frame(spark, vectors), queries.limit(0), 5).isEmpty()
    with pytest.raises(ValueError):
        S.nearest(as_frame(spark, vectors), queries, metric="manhattan")


def test_string_ids_break_ties_by_id(spark):
    index = spark.createDataFrame([(i, [1.0, 0.0]) for i in "dcba"], "id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [r["id"] for r in S.nearest(index, queries, 2).orderBy("rank").collect()] == ["a", "b"]


def test_rows_without_a_vector_are_left_out(spark):
    index = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r["id"] for r in S.nearest(index, queries, 5).collect()] == [2]
    texts = spark.createDataFrame([(1, None), (2, "a b")], "id int, text string")
    assert [r["vector"] is None for r in E.embed(texts).orderBy("id").collect()] == [True, False]


TEXTS = ["the cat sat", "The dog sat on the mat", "cat cat cat", "", "bird", "a cat and a dog; a bird"]


def brute_bm25(query, k1=1.2, b=0.75):
    split = [[t for t in "".join(c if c.isalnum() else " " for c in x.lower()).split()] for x in TEXTS]
    mean = sum(map(len, split)) / len(split)
    scores = {}
    for i, terms in enumerate(split):
        counts, total = Counter(terms), 0.0
        for term in set(query.lower().split()):
            n = sum(term in s for s in split)
            if n and counts[term]:
                idf = math.log(1 + (len(split) - n + 0.5) / (n + 0.5))
                total += idf * counts[term] * (k1 + 1) / (counts[term] + k1 * (1 - b + b * len(terms) / mean))
        if total:
            scores[i] = total
    return sorted(((-round(s, 9), i) for i, s in scores.items()))


@pytest.mark.parametrize("block", [1, 1024])
def test_bm25_matches_brute_force(spark, block):
    index = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(4)
    asked = ["cat dog", "BIRD bird", "unknown", "sat the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    hits = S.search_text(index, queries, 3, limits=S.BatchLimits(queries=block)).collect()
    for q, text in enumerate(asked):
        got = sorted((r["rank"], r["id"], r["score"]) for r in hits if r["query_id"] == q)
        expected = brute_bm25(text)[:3]
        assert [i for _, i, _ in got] == [i for _, i in expected]
        np.testing.assert_allclose([s for _, _, s in got], [-s for s, _ in expected], atol=1e-8)


def random_texts(count, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    weights = 1 / np.arange(1, 61)
    return [(f"d{k}", " ".join(rng.choice(words, size=int(rng.integers(0, 40)), p=weights / weights.sum()))) for k in range(count)]


def dense_bm25(rows, query, k, k1=1.2, b=0.75):
    split = {i: (t or "").lower().split() for i, t in rows}
    mean = sum(map(len, split.values())) / len(split)
    hits = []
    for i, terms in split.items():
        counts, total = Counter(terms), 0.0
        for term in sorted(set(query.lower().split())):
            n = sum(term in s for s in split.values())
            if counts[term]:
                total += math.log1p((len(split) - n + 0.5) / (n + 0.5)) * counts[term] * (k1 + 1) / (
                    counts[term] + k1 * (1 - b + b * len(terms) / mean)
                )
        if total:
            hits.append((-round(total, 9), i))
    return [i for _, i in sorted(hits)[:k]]


def found_ids(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("chunk", [2, 1024])
def test_text_index_of_several_blocks_and_segments(spark, tmp_path, chunk):
    rows = [*random_texts(300, 1), ("null", None), ("empty", ""), ("copy", "w1 w2 w3"), ("copy2", "w1 w2 w3")]
    frame = lambda part: spark.createDataFrame(part, "id string, text string").repartition(3)
    path = str(tmp_path / "index")
    fulltext.write_text_index(frame(rows[:200]), path, block_documents=16)
    fulltext.write_text_index(frame(rows[200:250]), path, segment=1, block_documents=16)
    index = fulltext.write_text_index(frame(rows[200:]), path, segment=1, block_documents=16)  # a retry replaces
    asked = ["w1 w2 w3", "w40 W59", "nothing known", "w50", "w0 w0 w7 w33"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = found_ids(S.search_text(index, queries, 7, limits=S.BatchLimits(queries=chunk)))
    expected = {q: hits for q, text in enumerate(asked) if (hits := dense_bm25(rows, text, 7))}
    assert got == expected
    (tmp_path / "index" / "totals" / "segment=1").rename(tmp_path / "gone")  # a segment without totals does not count
    half = fulltext.text_index(spark, path)
    assert found_ids(S.search_text(half, queries, 7)) == {q: h for q, t in enumerate(asked) if (h := dense_bm25(rows[:200], t, 7))}
    assert S.search_text(half, queries.limit(0), 7).isEmpty()


def test_search_opens_only_folders_of_asked_terms(spark, tmp_path):
    rows = random_texts(200, 2)
    path = tmp_path / "index"
    index = fulltext.write_text_index(spark.createDataFrame(rows, "id string, text string"), str(path))
    queries = spark.createDataFrame([(1, "w3 w20")], "query_id int, text string")
    wanted = {r["bucket"] for r in index.terms.where("term in ('w3', 'w20')").collect()}
    for name in ("postings", "terms"):
        for folder in (path / name / "segment=0").glob("bucket=*"):
            if int(folder.name.split("=")[1]) not in wanted:
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"not a Parquet file")  # opening it fails
    fresh = fulltext.text_index(spark, str(path))
    assert found_ids(S.search_text(fresh, queries, 5)) == {1: dense_bm25(rows, "w3 w20", 5)}
    with pytest.raises(Exception, match="not a Parquet|PARQUET|Parquet"):
        fresh.postings.groupBy("term").agg(F.max("n")).collect()


def test_every_range_of_a_folder_has_its_own_task(spark, tmp_path, monkeypatch):
    """Hashed to tasks, several ranges met in one, which read them all."""
    monkeypatch.setattr(fulltext, "WRITTEN_DOCUMENTS", 8)
    rows = random_texts(400, 3)
    index = fulltext.write_text_index(spark.createDataFrame(rows, "id string, text string"), str(tmp_path), block_documents=8)
    files = [(f.parent.name, f.name.split("-")[1]) for f in tmp_path.glob("postings/segment=0/bucket=*/*.parquet")]
    groups = fulltext.posting_groups(400, 50, index.buckets)
    assert groups == 4 and len({task for _, task in files}) == len(files) > len({bucket for bucket, _ in files})
    queries = spark.createDataFrame([(1, "w3 w20 w0")], "query_id int, text string")
    assert found_ids(S.search_text(index, queries, 5)) == {1: dense_bm25(rows, "w3 w20 w0", 5)}


def test_more_documents_make_more_tasks_not_larger_ones():
    for documents in (50_000, 500_000, 3_000_000, 30_000_000):
        blocks, buckets = -(-documents // fulltext.BLOCK_DOCUMENTS), max(fulltext.LEAST_BUCKETS, -(-documents // fulltext.BUCKET_DOCUMENTS))
        groups = fulltext.posting_groups(documents, blocks, buckets)
        assert documents / (buckets * groups) <= fulltext.WRITTEN_DOCUMENTS and -(-blocks // groups) <= fulltext.TASK_BLOCKS
        assert buckets * groups <= max(fulltext.LEAST_BUCKETS, 2 * documents / fulltext.WRITTEN_DOCUMENTS)


def test_blocks_below_the_kth_score_are_skipped():
    schema = pa.schema([("term", pa.string()), ("max_count", pa.int32()), ("min_length", pa.int32()),
                        ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])
    pairs = pa.array([[{"term": "a", "weight": 2.0}]], pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())])))
    cell = fulltext._Cell(pa.RecordBatch.from_arrays([pa.array([7]), pairs], names=["query_id", "pairs"]), 2, 1.2, 0.75, 10.0)
    block = lambda ids, counts: pa.RecordBatch.from_pydict(
        {"term": ["a"], "max_count": [max(counts)], "min_length": [10], "ids": [ids], "counts": [counts], "lengths": [[10] * len(ids)]}, schema
    )
    cell.see(block([1, 2, 3], [5, 4, 3]))
    assert cell.scored == 3
    cell.see(block([4, 5], [2, 3]))
    assert cell.scored == 3  # at most as good as the third best
    cell.see(block([6, 0], [1, 4]))
    assert cell.scored == 5 and cell.best.ids.to_pylist() == [1, 0]


def test_kept_indexes(spark, tmp_path):
    table = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red cat"), (2, "blue dog")], "id long, text string").write.parquet(table)
    queries = spark.createDataFrame([(1, "cat")], "query_id int, text string")
    first = indexes.kept_text_index(spark.read.parquet(table), "t")
    again = indexes.kept_text_index(spark.read.parquet(table), "t")
    assert first.postings.inputFiles() == again.postings.inputFiles()
    spark.createDataFrame([(3, "cat cat")], "id long, text string").write.mode("append").parquet(table)
    assert found_ids(S.search_text(indexes.kept_text_index(spark.read.parquet(table), "t"), queries, 5)) == {1: [3, 1]}
    root = indexes.index_root(spark)
    names = [r["name"] for r in indexes.list_indexes(spark, root).collect() if r["name"].startswith("t-")]
    assert len(names) == 2 and indexes.drop_index(spark, root, names[0]) and not indexes.drop_index(spark, root, names[0])
    assert names[0] not in [r["name"] for r in indexes.list_indexes(spark, root).collect()]
    assert indexes.list_indexes(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(ValueError):
        indexes.drop_index(spark, root, "../x")


def test_fusion(spark):
    vector = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    text = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 5, 1)], "query_id int, id int, rank int")
    out = S.fuse(vector, text, 3, 0.3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in out] == [(1, 11), (1, 10), (1, 12), (2, 5)]
    assert out[0]["score"] == pytest.approx(0.7 / 62 + 0.3 / 61)
    tie = spark.createDataFrame([(1, 3, 1), (1, 2, 1)], "query_id int, id int, rank int")
    assert [r["id"] for r in S.fuse(tie, tie.limit(0), 2).orderBy("rank").collect()] == [2, 3]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_cell_search_with_all_cells_is_exact(spark, vectors, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(S, "CELL_ROWS", 40)  # cells are cut
    index = as_frame(spark, vectors)
    queries = as_frame(spark, vectors[:5], "query_id").drop("kind")
    model = S.train_cells(index, cells=4, metric=metric)
    S.assign_cells(index, model, overlap=0.2).write.partitionBy("cell").parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert 300 < stored.count() < 600 and stored.select("id").distinct().count() == 300
    exact = S.nearest(index, queries, 5, metric)
    every = S.nearest_by_cell(stored, queries, model, 5, probes=4, share=1.0, limits=S.BatchLimits(queries=2))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    some = S.recall(S.nearest_by_cell(stored, queries, model, 5, probes=2), exact).collect()
    assert all(0 < r["recall"] <= 1 for r in some)


def test_cell_search_measures_what_it_says(spark, vectors, monkeypatch):
    index = as_frame(spark, vectors)
    queries = as_frame(spark, vectors[:7], "query_id").drop("kind")
    model = S.train_cells(index, cells=3)
    cells = S.assign_cells(index, model).collect()
    sizes = Counter(r["cell"] for r in cells)
    probed = S.probe_table(queries, model, 2).collect()
    expected = Counter()
    for r in probed:
        n = sizes[r["cell"]]
        expected[r["query_id"]] += min(n, max(4, math.ceil(n * 0.25)))
    cost = S.probe_cost(spark.createDataFrame(cells), queries, model, 4, 2)
    assert {r["query_id"]: r["computed"] for r in cost.collect()} == dict(expected)
    own = [np.array(r["vector"]) for r in cells if r["cell"] == 0]
    part = pa.RecordBatch.from_pydict({"id": list(range(len(own))), "vector": [v.tolist() for v in own], "code": [model.codes(v[None, :])[0].tobytes() for v in own]})
    measured = []
    plain = S.distances
    monkeypatch.setattr(S, "distances", lambda rows, *a: (measured.append(len(rows)), plain(rows, *a))[1])
    S._nearest_in_part(part, np.array(own[:2]), model, 4, 0.25)
    assert measured == [max(4, math.ceil(len(own) * 0.25))] * 2


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "x")], "id int, text string")
    got = [(r["id"], r["chunk_no"], r["text"]) for r in E.chunks(df, "id", size=2).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (3, 0, "x")]
    lapped = E.chunks(df.where("id = 1"), "id", size=3, overlap=1).orderBy("chunk_no").collect()
    assert [r["text"] for r in lapped] == ["a b c", "c d e"]
    with pytest.raises(ValueError):
        E.chunks(df, "id", size=2, overlap=2)


def test_index_life_cycle(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([("a", "red cat", 2020), ("b", "blue dog", 2021)], "key string, text string, year int")
    E.write_index(E.index_rows(docs, "key", metadata=["year"]), path)
    more = E.index_rows(spark.createDataFrame([("green bird", 2022), ("old fish", 2019)], "text string, year int"), None, metadata=["year"])
    E.add_documents(more, path)
    index = spark.read.parquet(path)
    assert index.count() == 4 and index.select("id").distinct().count() == 4
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in index.collect())
    updates = spark.createDataFrame([("a", "black cat")], "id string, text string")
    changed = {r["id"]: r for r in E.update_documents(index, updates).collect()}
    assert changed["a"]["text"] == "black cat" and changed["a"]["year"] == 2020
    before = {r["id"]: r["vector"] for r in index.collect()}
    assert changed["a"]["vector"] != before["a"] and changed["b"]["vector"] == before["b"]
    left = E.delete_documents(index, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert left.count() == 3
    query = E.embed(spark.createDataFrame([(1, "blue dog")], "query_id int, text string"))
    assert S.search_hybrid(index, query, 1).first()["id"] == "b"
    assert E.index_stats(index).first().asDict() == {"num_documents": 4, "num_chunks": 4, "dimension": 64}


def test_artifact_text(spark):
    df = spark.createDataFrame([("n", None, ["t", "u"]), ("m", "d", [])], "n string, d string, t array<string>")
    got = [r[0] for r in df.select(E.artifact_search_text(F.col("n"), F.col("d"), F.col("t"))).collect()]
    assert got == ["n  t u", "m d "]


def test_l2_of_near_vectors(spark):
    """Large vectors that differ by little: norms and products alone cannot tell their distances."""
    base = np.full(64, 1e4)
    offsets = {1: 1e-5, 2: 1e-7, 3: 1e-4, 4: 3.0}
    rows = [(i, [float(x) for x in base + o * (np.arange(64) == i)]) for i, o in offsets.items()]
    rows += [(100 + k, [float(x) for x in base + 50 + k]) for k in range(40)]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(0, [float(x) for x in base])], "query_id int, vector array<double>")
    got = S.nearest(index, queries, 4, "l2").orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1, 3, 4]
    assert [r["distance"] for r in got] == pytest.approx([1e-7, 1e-5, 1e-4, 3.0], rel=0.02)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_cell_search_finds_the_neighbours_of_rows(spark, folder):
    got = retrieval.nearest_rows_by_cell_recall(spark, folder).collect()
    asked = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()
    assert {r["query_id"] for r in got} == {r["vec_id"] for r in asked}
    assert all(r["n_exact"] == 10 for r in got) and np.mean([r["recall"] for r in got]) >= 0.9
    assert all(r["measured"] <= 0.25 for r in got)
