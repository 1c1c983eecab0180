import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import hardnegatives
from tidewater.llm.hardnegatives import Block, Mining, Search

SCHEMA = "vec_id long, label long, embedding array<float>, row string, id string, anchor string, slot int, score string, windows string"


def brute(rows, rule=Mining(), modulus=10):
    good = []
    for identifier, label, vector in rows:
        if identifier is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((identifier, label, [math.floor(rule.scale * float(np.float32(x))) for x in vector]))
    out = []
    for anchor, label, own in good:
        if anchor % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i, other) for i, other, v in good)
        positives = [(i, -s) for s, i, other in scored if other == label and i != anchor][: rule.positives]
        for positive, high in positives:
            fits = [(i, -s) for s, i, other in scored if other != label and rule.low * high <= -100 * s <= rule.high * high]
            out += [(anchor, positive, k + 1, i, high, s) for k, (i, s) in enumerate(fits[: rule.negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "i", "a", 1, "s", "w") for r in rows], SCHEMA)


def mined(df, rule=Mining(), modulus=10):
    found = hardnegatives.mine(df, F.col("vec_id") % modulus == 0, rule)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(count, width, seed, labels=4):
    chance = random.Random(seed)
    return [(k, chance.randrange(labels), [chance.gauss(0, 0.3) for _ in range(width)]) for k in range(count)]


@pytest.mark.parametrize("blocks", [(4096, 8192), (16, 3)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hardnegatives, "CHUNK_ANCHORS", blocks[1])
    rows = vectors(300, 6, 1)
    same = [(1000 + k, 2, rows[10][2]) for k in range(40)]  # a common vector: ties go to the smaller identifier
    odd = [
        (None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
        (2003, 1, [math.nan] * 6), (2004, 1, [math.inf] * 6), (2010, 1, []), (2020, 2, [0.0] * 6), (2030, 3, [0.5, 0.5]),
        (2031, 0, [0.7, 0.7, -0.1]), (2040, 77, [0.4] * 6), (2041, 77, [-0.4] * 6),
    ]
    given = rows + same + odd
    assert mined(frame(spark, given)) == brute(given)


def test_large_components_are_exact(spark):
    chance = random.Random(5)
    rows = [(k, k % 2, [chance.choice([3e4, -2e4, 1.5e4, 9e5]) * chance.random() for _ in range(8)]) for k in range(60)]
    assert mined(frame(spark, rows)) == brute(rows)
    huge = [(k, k % 2, [1e12 * (1 + chance.random()), 1e10, 1.0]) for k in range(30)]
    got = mined(frame(spark, huge))
    assert got and all(p == 2**63 - 1 for *_, p, _ in got)  # saturated


def test_repeated_anchors_and_empty_tables(spark):
    rows = vectors(60, 4, 3)
    twice = [*rows, rows[20]]
    once, again = brute(rows), mined(frame(spark, twice))
    assert sorted(r for r in again if r[0] == 20) == sorted(2 * sorted({r for r in again if r[0] == 20}))
    assert {r[:2] for r in once if r[0] == 20} == {r[:2] for r in again if r[0] == 20}
    assert mined(frame(spark, [])) == [] and mined(frame(spark, rows[1:10])) == []


def test_stops_before_the_whole_list():
    """Rows that one component tells apart: the threshold falls below the kth score after a few rounds."""
    count, width, k = 4000, 3, 5
    values = np.zeros((count, width), dtype=np.int64)
    values[:, 0] = np.arange(count)
    block = Block(np.arange(count), np.zeros(count, dtype=np.int64), values, np.argsort(values, axis=0, kind="stable").astype("<u2"))
    met = []
    search = Search(np.array([0]), np.array([-1]), np.array([1]), np.array([[7, 0, 0]]), np.array([[0]]), np.array([[10**9]]), False, k)
    plain = search._score
    search._score = lambda *args: (met.append(int(args[-1].sum())), plain(*args))
    search.see(block)
    assert search.found[0, 0].tolist() == [3999, 3998, 3997, 3996, 3995] and sum(met) <= 64
    window = Search(np.array([0]), np.array([-1]), np.array([1]), np.array([[7, 0, 0]]), np.array([[70]]), np.array([[77]]), False, k)
    window.see(block)
    assert sorted(window.found[0, 0, : window.count[0, 0]].tolist()) == [10, 11]
