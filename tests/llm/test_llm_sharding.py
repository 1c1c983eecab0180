import zlib

from pyspark.sql import functions as F

from tidewater.llm import sharding


def brute(rows, shards):
    ordered = sorted(
        ((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    total, at, out, counts = sum(r[2] for r in ordered), 0, [], {}
    for identifier, checksum, size in ordered:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((identifier, size, checksum, shard, counts.get(shard, 0)))
        counts[shard] = counts.get(shard, 0) + 1
        at += size
    return sorted(out, key=repr)


def check(df, shards):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sharding.shard_by_bytes(df, shards).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, shards)


def test_brute_force(spark):
    df = spark.range(2000).select(
        ((F.col("id") * 7919) % 2003).alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 37).cast("int")).alias("text")
    )
    check(df, 16)
    check(df.repartition(5), 7)
    sizes = [r["n"] for r in sharding.shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 73


def test_odd_rows(odd, empty):
    check(odd, 4)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_texts_do_not_move(spark, odd):
    plan = sharding.shard_by_bytes(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text#" not in plan
