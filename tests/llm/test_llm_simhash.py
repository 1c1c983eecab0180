import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import common, simhash


def brute_fingerprint(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, radius):
    """rows (identifier, unsigned fingerprint) -> smallest identifier of each row's component."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([f for _, f in rows], dtype=np.uint64)
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius):
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    members = {}
    for k, (identifier, _) in enumerate(rows):
        members.setdefault(find(k), []).append(identifier)
    smallest = {root: min((i for i in ids if i is not None), default=None) for root, ids in members.items()}
    return [(identifier, fingerprint, smallest[find(k)]) for k, (identifier, fingerprint) in enumerate(rows)]


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("width", [1, 3])
def test_fingerprints(odd, width):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash.near_duplicates(odd, width=width).collect()
    expected = brute_components([(i, brute_fingerprint(t, width)) for i, t in rows], 2)
    assert sorted(map(repr, ((r[0], r[1] % (1 << 64), r[2]) for r in got))) == sorted(map(repr, expected))


def test_shingle_hash_is_spark_xxhash64(spark):
    text = "one two three"
    assert spark.sql(f"SELECT xxhash64('{text}')").first()[0] % (1 << 64) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_keep_every_connection(spark, radius):
    random = np.random.default_rng(radius)
    base = [int(x) for x in random.integers(0, 1 << 63, 12)]
    values = {signed(b) for b in base}
    for b in base:
        for _ in range(12):
            flips = random.choice(64, size=random.integers(1, 5), replace=False)
            for bit in flips:
                b ^= 1 << int(bit)
            values.add(signed(b))
    rows = [(k, v % (1 << 64)) for k, v in enumerate(sorted(values))]
    found = simhash.links(spark.createDataFrame([(signed(v),) for _, v in rows], "fingerprint long"), radius)
    roots = {r["node"]: r["root"] for r in common.components(found).collect()}
    got = {}
    for k, v in rows:
        got.setdefault(roots.get(signed(v), signed(v)), []).append(k)
    expected = {}
    for k, _, root in brute_components(rows, radius):
        expected.setdefault(root, []).append(k)
    assert sorted(got.values()) == sorted(expected.values())


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, k) for k in range(1001, 1200)]
    pairs = spark.createDataFrame([*chain, *star, (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(pairs).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1200)}}


def test_drop(odd, empty):
    kept = simhash.drop_near_duplicates(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd.where("doc_id is not null")).collect()}
    assert ids == sorted(i for i, c in found.items() if i == c)
    assert simhash.drop_near_duplicates(odd).where("doc_id is null").count() == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_hexadecimal(spark):
    row = spark.createDataFrame([(-1,), (255,)], "f long").select(simhash.hexadecimal(F.col("f")).alias("h")).collect()
    assert [r["h"] for r in row] == ["f" * 16, "0" * 14 + "ff"]
