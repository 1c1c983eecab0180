import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import lineage as L
from tidewater.operators import registry as R


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "id long, parent_id long").repartition(3)


def brute_lineage(pairs):
    parent, out = dict(pairs), set()
    for start in parent:
        seen, node, depth = {start}, parent[start], 1
        while node is not None and node in parent and node not in seen:
            out.add((start, node, depth))
            seen.add(node)
            node, depth = parent[node], depth + 1
    return out


TREES = {
    "root": [(1, None)],
    "deep": [(i, i - 1 if i else None) for i in range(37)],
    "wide": [(i, 0 if i else None) for i in range(50)],
    "missing parent": [(1, 99), (2, 1)],
    "cycle of two": [(1, 2), (2, 1), (3, 1), (4, 3)],
    "self": [(0, 0), (1, 0), (2, 1)],
    "long cycle": [(i, (i + 1) % 7) for i in range(7)] + [(i, i - 1) for i in range(8, 20)] + [(7, 3)],
}


@pytest.mark.parametrize("name", TREES)
def test_lineage(spark, name):
    got = {tuple(r) for r in R.lineage(edges(spark, TREES[name])).select("id", "ancestor_id", "depth").collect()}
    assert got == brute_lineage(TREES[name])


def test_lineage_depth_cap(spark):
    assert R.lineage(edges(spark, TREES["deep"]), max_depth=5).agg(F.max("depth")).first()[0] == 5


@pytest.mark.parametrize("name", list(TREES))
def test_lineage_of_wanted_ids(spark, name):
    some = [i for i, _ in TREES[name]][::3]
    wanted = spark.createDataFrame([(i,) for i in [*some, *some[:1], 10**6]], "id long")
    got = R.lineage_of(edges(spark, TREES[name]), wanted).select("id", "ancestor_id", "depth").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {r for r in brute_lineage(TREES[name]) if r[0] in some}


@pytest.mark.parametrize("name", list(TREES))
def test_lineage_labels(spark, name):
    rows = L.lineage_labels(edges(spark, TREES[name])).collect()
    assert len(rows) == len({i for i, _ in TREES[name]})
    brute = brute_lineage(TREES[name])
    parent = dict(TREES[name])
    for r in rows:
        walked, node = set(), r["id"]
        while node is not None and node in parent and node not in walked and parent[node] != node:
            walked.add(node)
            node = parent[node]
        assert r["cyclic"] == (node in walked)
    plain = [r for r in rows if not r["cyclic"]]
    enclosed = {
        (b["id"], a["id"], b["depth"] - a["depth"])
        for a in plain for b in plain if a["root"] == b["root"] and a["enter"] < b["enter"] and b["leave"] < a["leave"]
    }
    ids = {r["id"] for r in plain}
    assert enclosed == {p for p in brute if p[0] in ids}


def test_lineage_of_a_random_forest(spark):
    chance = random.Random(4)
    pairs = [(i, chance.choice([None, *range(max(0, i - 6), i)]) if i % 40 else None) for i in range(300)]
    wanted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "id long")
    got = R.lineage_of(edges(spark, pairs).repartition(3), wanted).collect()
    assert {tuple(r) for r in got} == {r for r in brute_lineage(pairs) if r[0] % 2 == 0} and len(got) == len(set(got))


def test_lineage_has_no_depth_limit(spark):
    chain = [(i, i - 1 if i else None) for i in range(131)]
    got = R.lineage_of(edges(spark, chain), spark.createDataFrame([(130,)], "id long"))
    assert {(r["ancestor_id"], r["depth"]) for r in got.collect()} == {(i, 130 - i) for i in range(130)}


@pytest.mark.parametrize("name", list(TREES))
def test_popular_parents_are_broadcast_and_change_nothing(spark, monkeypatch, name):
    plain = {tuple(r) for r in L.lineage_labels(edges(spark, TREES[name])).collect()}
    monkeypatch.setattr(L, "FEW_JUMPS", 2)
    assert {tuple(r) for r in L.lineage_labels(edges(spark, TREES[name])).collect()} == plain


def test_lineage_rounds_follow_the_depth_and_not_the_artifacts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(L, "checkpointed", lambda df, inner=L.checkpointed: made.append(1) or inner(df))

    def rounds(artifacts):
        made.clear()
        width = round(artifacts**0.5)
        tree = spark.range(artifacts).selectExpr("id", f"CASE WHEN id > {width} THEN id % {width} + 1 WHEN id > 0 THEN 0 END AS parent_id")
        assert L.lineage_labels(tree).agg(F.max("depth")).first()[0] == 2
        return len(made)

    assert rounds(4000) == rounds(40)


def test_update_with_repeated_unknown_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "older", 0), (9, "q", 1), (None, "z", 1)], "id int, name string, seen int")
    got = sorted((tuple(r) for r in R.update(table, changes, ["id"], ["seen"]).collect()), key=repr)
    assert got == sorted([(1, "new", 5), (2, "b", 6), (None, "c", 7)], key=repr)
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "id int, name string")
    assert sorted(r["name"] for r in R.update(table, twice, ["id"]).collect()) == ["a", "c", "y"]


def test_text_search_of_artifacts(spark):
    rows = [(1, "tiny model", "for tests", ["nlp"], "model", "staging", 1), (2, "big model", None, ["vision"], "model", "prod", 2),
            (3, "report", "on a tiny model", [], "doc", "prod", 3)]
    df = spark.createDataFrame(rows, "id long, name string, description string, tags array<string>, type string, governance_status string, created_at int")
    assert [r["id"] for r in R.search_artifacts(df, text="tiny nlp").collect()] == [1, 3]
    assert [r["id"] for r in R.search_artifacts(df, artifact_type="doc", text="tiny").collect()] == [3]
    assert R.search_artifacts(df, text="absent").isEmpty()


def test_upsert_update_delete(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, score int")
    incoming = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, name string, seq int")
    out = {r["id"]: (r["name"], r["score"]) for r in R.upsert(table, incoming, ["id"], ["seq"]).collect()}
    assert out == {1: ("a", 10), 2: ("y", None), 3: ("z", None)}
    changes = spark.createDataFrame([(1, None), (9, "q")], "id int, name string")
    assert {r["id"]: r["name"] for r in R.update(table, changes, ["id"]).collect()} == {1: None, 2: "b"}
    assert [r["id"] for r in R.not_found(table, changes, ["id"]).collect()] == [9]
    assert [r["id"] for r in R.delete(table, changes, ["id"]).collect()] == [2]


def test_latest_version_with_equal_times(spark):
    at = dt.datetime(2024, 1, 1)
    versions = spark.createDataFrame([("p", "v2", at), ("p", "v1", at), ("q", "v0", at)], "parent string, id string, created_at timestamp_ntz")
    parents = spark.createDataFrame([("p",), ("q",), ("none",)], "parent string")
    out = {r["parent"]: r["id"] for r in R.latest_version(parents, versions, "parent").collect()}
    assert out == {"p": "v1", "q": "v0", "none": None}
    page = {r["parent"]: [v["id"] for v in r["versions"]] for r in R.version_page(versions, "parent", ["id"], 1).collect()}
    assert page == {"p": ["v1"], "q": ["v0"]}


@pytest.mark.parametrize(
    "status,to,checklist,reason",
    [
        ("dev", "prod", {}, "only from staging to prod"),
        ("staging", "prod", {"a": True, "b": False}, "checklist not finished"),
        ("staging", "prod", {}, None),
        ("staging", "prod", {"a": True}, None),
        ("training", "deployed", {}, "only completed can be deployed"),
        ("completed", "deployed", {}, None),
        ("dev", "staging", {"a": False}, None),
    ],
)
def test_promotion(spark, status, to, checklist, reason):
    df = spark.createDataFrame([(status, to, checklist)], "status string, to_status string, checklist map<string,boolean>")
    row = R.promote(df).first()
    assert (row["reason"], row["accepted"]) == (reason, reason is None)
    assert row["status"] == (to if reason is None else status)


def test_external_states(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    jobs = spark.createDataFrame(
        [("a", "pending", None, None), ("b", "running", t[0], None), ("c", "completed", t[0], t[1]), ("d", "pending", None, None), ("e", "pending", None, None)],
        "id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz")
    feed = spark.createDataFrame(
        [("a", "RUNNING", t[2]), ("b", "RUNNING", t[1]), ("b", "TIMED_OUT", t[3]), ("c", "RUNNING", t[4]), ("d", "PAUSED", t[1])],
        "id string, external string, observed_at timestamp_ntz")
    out = {r["id"]: (r["status"], r["started_at"], r["completed_at"]) for r in R.apply_external_states(jobs, feed).collect()}
    assert out == {"a": ("running", t[2], None), "b": ("failed", t[0], t[3]), "c": ("completed", t[0], t[1]),
                   "d": ("pending", None, None), "e": ("pending", None, None)}


def test_issues_that_are_not_json_read_as_none(spark):
    df = spark.createDataFrame([('[{"column": "a", "type": "t", "severity": "low", "message": "m"}]',), ("oops",), (None,)], "issues string")
    assert [len(r["issues"]) for r in R.parse_issues(df).collect()] == [1, 0, 0]


def test_tags_and_search(spark):
    versions = spark.createDataFrame([(1,), (2,)], "v int")
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 10)], "v int, t int")
    tags = spark.createDataFrame([(10, "b"), (11, "a")], "t int, name string")
    assert {r["v"]: r["tags"] for r in R.tags_of(versions, links, tags, "v", "t", "name").collect()} == {1: ["a", "b"], 2: []}
    found = spark.createDataFrame([(1, "m", "dev", ["a"], 5), (2, "m", "dev", ["c"], 9)],
                                  "id int, type string, governance_status string, tags array<string>, created_at int")
    assert [r["id"] for r in R.search_artifacts(found, "m").collect()] == [2, 1]
    assert [r["id"] for r in R.search_artifacts(found, tags=["a", "z"]).collect()] == [1]
    assert R.search_artifacts(found, status="prod").isEmpty()
