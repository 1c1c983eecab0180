import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewater.operators import profile as P
from tidewater.operators.profile_state import StoredProfile, add_batch

RULES = {"n": {"min": 0, "max": 90}, "t": {"min": "b"}, "unknown": {"min": 1}}
SCHEMA = "n int, x double, t string, same string, `a.b` double, at timestamp"


def rows(count, seed):
    chance = random.Random(seed)
    return [
        (
            chance.choice([None, *range(-2, 60), 500]), chance.choice([None, float("nan"), -0.0, 0.0, chance.gauss(0, 1), 1e9]),
            chance.choice([None, "", "a", "bb"]), chance.choice([None, "k"]), float(chance.randrange(3)), None,
        )
        for _ in range(count)
    ]


def cells(df):
    return sorted(((r["check"], r["column"], r["metric"], r["value"]) for r in df.collect()), key=repr)


def test_profile_of_batches_is_that_of_the_whole(spark, tmp_path):
    batches = [rows(150, 1), [], rows(3, 2), rows(150, 1)[:40]]  # rows repeat across batches
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    sources, path = [], str(tmp_path / "state")
    for k, frame in enumerate(frames):
        source = str(tmp_path / f"batch{k}")
        frame.write.parquet(source)
        add_batch(spark.read.parquet(source), path, f"{k}")
        sources.append(source)
    for source in sources[:3]:
        shutil.rmtree(source)  # what was read once is not read again
    add_batch(spark.read.parquet(sources[3]), path, "3")  # a retry replaces
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    stored = StoredProfile(spark, path, RULES)
    wanted = P.quartile_bounds(P.comparable(whole))
    assert stored.bounds.keys() == wanted.keys() and all(stored.bounds[c] == pytest.approx(wanted[c]) for c in wanted)
    assert cells(stored.check_rows()) == cells(P.check_rows(whole, RULES))
    assert stored.report(60).first() == P.report(whole, RULES, 60).first()


def test_states_of_odd_tables(spark, tmp_path):
    path = str(tmp_path / "state")
    with pytest.raises(ValueError):
        StoredProfile(spark, path)
    empty = spark.createDataFrame([], SCHEMA)
    add_batch(empty, path, "0")
    assert cells(StoredProfile(spark, path, RULES).check_rows()) == cells(P.check_rows(empty, RULES))
    with pytest.raises(ValueError):
        add_batch(empty.withColumn("n", F.col("n").cast("string")), path, "1")
    times = spark.createDataFrame([("2024-01-01 00:00:00.000001",), ("2024-01-01 00:00:00.000002",)], "s string").select(F.col("s").cast("timestamp").alias("at"))
    add_batch(times, str(tmp_path / "times"), "0")
    assert StoredProfile(spark, str(tmp_path / "times")).measure().first()["duplicates"] == 0
