import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewater.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, node string, pos int, p0 string, d0 string, row string"
NAMES = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(
        (
            min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), children[path], leaves[path],
            saved[path], hashlib.sha256(",".join(str(c) for c in sorted(own_members) if paths[c] == path).encode()).hexdigest(),
        )
        for path, own_members in members.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "n", 2, "p", "d", "r") for r in rows], SCHEMA)
    return sorted(tuple(r[n] for n in NAMES) for r in prefixtrie.trie(df).collect())


def conversations(count, seed, words=("a", "b", "é"), longest=7):
    chance = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(chance.randrange(1, longest)):
            rows.append((c, turn, chance.choice(["user", "assistant"]), chance.choice(words)))
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = conversations(120, seed)
    rows = [r for r in rows if r[0] not in (10, 35)]  # absent bases
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, None, "second"), (3, 1, "user", None), (4, None, None, None),
        (5, 2, "user", "x" * 100_000), (5, 1, "a", "b"), (6, 1, "", "ab"), (7, 1, "a", "b"), (8, 1, "user", "b"), (10**12, 5, "u", "v"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert len(found(spark, [*rows, (8, 1, "user", "b")])) >= len(brute(rows))  # a repeated row is a turn of its own


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    monkeypatch.setattr(prefixtrie, "SLICE", 8)
    copies = [(5 * c, turn, "user", f"t{turn}") for c in range(60) for turn in range(3)]
    long = [(1001, turn, "user", f"t{turn % 5}") for turn in range(400)]
    rows = copies + long
    assert found(spark, rows) == brute(rows)


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    rows = conversations(60, 3)
    monkeypatch.setattr(prefixtrie, "BASES", ((1, 1, 1), prefixtrie.BASES[0]))  # base 1: the order of turns does not count
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(prefixtrie, "BASES", ((1, 1, 1),))
    with pytest.raises(ValueError):
        found(spark, [(5, 0, "u", "a"), (5, 1, "u", "b"), (10, 0, "u", "b"), (10, 1, "u", "a")])
