from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import exact


def brute(rows, keep):
    groups = defaultdict(list)
    for identifier, text in rows:
        groups[text or ""].append(identifier)
    best = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[text] = (max(known) if keep == "largest" else min(known)) if known else None
    return sorted(((i, best[t or ""], len(groups[t or ""])) for i, t in rows), key=repr), len(groups)


def check(df, keep, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    marked = exact.mark_duplicates(df, keep=keep, **options).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    expected, groups = brute(rows, keep)
    assert sorted(((r[0], r[1], r[2]) for r in marked), key=repr) == expected
    assert sum(r["kept"] for r in marked) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in marked if r["kept"])


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(odd, keep):
    check(odd, keep)


def test_hot_text_is_cut_into_ranges(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same long text " * 20).otherwise(F.concat(F.lit("the same long text "), (F.col("id") % 900).cast("string"))).alias("text"),
    )
    keyed = df.select(F.col("text").alias("_text"), F.col("doc_id").alias("_id"))
    borders = exact.sample_splitters(keyed, 12)
    assert max(map(len, borders.identifiers)) >= 2
    assert borders.texts == sorted(borders.texts) and borders.ranges <= 24
    check(df, "largest")
    check(df, "smallest")


def test_borders_are_short(spark):
    df = spark.range(500).select(F.col("id").alias("_id"), F.concat(F.format_string("%05d", "id"), F.repeat(F.lit("x"), 5000)).alias("_text"))
    assert all(len(t) <= 8 for t in exact.sample_splitters(df, 8).texts)


def test_normalised_texts(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    kept = exact.drop_exact_duplicates(df, normalise=F.lower)
    assert sorted(map(tuple, kept.collect())) == [(1, "A b"), (3, "c")]


def test_columns_stay(odd, empty):
    assert exact.drop_exact_duplicates(odd).columns == odd.columns
    assert exact.mark_duplicates(empty).count() == 0
    assert exact.drop_exact_duplicates(empty).columns == empty.columns


def test_one_shuffle_of_texts_and_no_python(spark, odd):
    plan = exact.mark_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "hashpartitioning(_text" not in plan
    assert "Python" not in plan and "Arrow" not in plan
