from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing
from tidewater.llm.mixing import Mix


def brute_targets(sizes, mix):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    left, open_, target = mix.share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > mix.limit * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = mix.limit * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.fixture
def corpus(spark):
    random = np.random.default_rng(5)
    rows = []
    for k in range(3000):
        source = "hot" if k % 3 == 0 else (None if k % 97 == 1 else f"s{k % 11}")
        rows.append((k, " ".join(["w"] * int(random.integers(1, 30))) + f" {k}", source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(corpus):
    mix = Mix()
    rows = mixing.mix_rows(corpus, mix).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    target = brute_targets(sizes, mix)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert len(r["draws"]) <= mix.limit
        assert len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    for source, words in taken.items():
        assert abs(words - target[source]) <= 31
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_and_partitionings_agree(corpus):
    first = sorted(mixing.mix_rows(corpus).select("doc_id", "draws").collect())
    again = sorted(mixing.mix_rows(corpus.repartition(7, "source")).select("doc_id", "draws").collect())
    assert first == again


def test_quotas_are_exact(spark):
    mix = Mix(shards=6)
    owned = {1: 100, 2: 37, 3: 1, 4: 63}
    units = spark.createDataFrame([(r, u) for r, n in owned.items() for u in range(n)], "rank int, unit int")
    quotas = mixing.split_quotas(units, mix).collect()
    by_source, by_shard = Counter(), Counter()
    for q in quotas:
        by_source[q["rank"]] += q["quota"]
        by_shard[q["shard"]] += q["quota"]
    assert by_source == owned
    assert set(by_shard) == set(range(6)) and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_blocks_are_disjoint(corpus):
    """Each pass takes a row at most once, and a block of rows goes to one shard."""
    mix = Mix(blocks=40)
    rows = mixing.mix_rows(corpus, mix).select("source", "key", F.explode("draws").alias("d"), "doc_id").collect()
    assert len({(r["doc_id"], r["d"]["pass"]) for r in rows}) == len(rows)
    assert {r["d"]["shard"] for r in rows} == set(range(16))


def test_mixed_rows(corpus):
    draws = {r["doc_id"]: len(r["draws"]) for r in mixing.mix_rows(corpus).collect()}
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in draws.items() if n})


def test_odd_rows(odd, empty):
    rows = mixing.mix_rows(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(len(r["draws"]) <= 2 for r in rows)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix_rows(empty).count() == 0 and mixing.mixed(empty).count() == 0
    wordless = odd.where("doc_id in (3, 4, 5)")
    assert [len(r["draws"]) for r in mixing.mix_rows(wordless).collect()] == [0, 0, 0]


def test_no_python_in_the_plan(corpus):
    plan = mixing.mix_rows(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
