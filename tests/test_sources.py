import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.plans import ingest as I
from tidewater.sources import catalog, files, quoted, sql, versioned


@pytest.mark.parametrize("suffix", ["csv", "json", "jsonl", "parquet"])
def test_read_by_suffix(spark, tmp_path, suffix):
    frame = pd.DataFrame({"text": ['a "quoted", value', "two\nlines", "ü"], "n": [1, 2, 3]})
    path = tmp_path / f"data.{suffix}"
    {"csv": lambda: frame.to_csv(path, index=False), "json": lambda: frame.to_json(path, orient="records"),
     "jsonl": lambda: frame.to_json(path, orient="records", lines=True), "parquet": lambda: frame.to_parquet(path)}[suffix]()
    got = files.read_file(spark, str(path)).orderBy("n").select("text", "n").collect()
    assert [(r["text"], r["n"]) for r in got] == list(frame.itertuples(index=False, name=None))


def random_csv(seed):
    """Fields with quotes, commas and line breaks; also unquoted quotes inside a value."""
    chance = random.Random(seed)
    end = chance.choice(["\n", "\r\n"])
    parts = ["a", "b,", '"', '""', "\n", "\r\n", "x y", "ü", "\n\n", "1", "\ue000n", " "]

    def field():
        if chance.random() < 0.3:
            return chance.choice(["plain", "", "7", 'in"side', " 'q'"])
        text = "".join(chance.choice(parts) for _ in range(chance.randrange(6)))
        return '"' + text.replace('"', '""') + '"'

    rows = [",".join([str(n), field(), field()]) for n in range(chance.randrange(1, 25))]
    return end.join([chance.choice(["n,t,u", 'n,"t\nt",u']), *rows]) + chance.choice(["", end])


def plain_breaks(df):
    """Rows with plain line breaks: the other reader makes those of a file whose lines end in both characters plain."""
    return sorted(repr(tuple(r)).replace("\\r\\n", "\\n") for r in df.collect())


@pytest.mark.parametrize("size", [5, 17, 64, 1 << 20])
def test_quoted_line_breaks_under_any_split(spark, tmp_path, size):
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(name, str(size))
    try:
        for seed in range(4):
            path = tmp_path / f"{seed}.csv"
            path.write_bytes(random_csv(seed).encode())
            wanted = files.read_file(spark, str(path), multi_line=True)
            got = files.read_file(spark, str(path))
            assert got.dtypes == wanted.dtypes, seed
            assert plain_breaks(got) == plain_breaks(wanted), seed
        if size == 17:
            whole = files.read_file(spark, str(tmp_path / "*.csv"), "n string, t string, u string")
            wanted = files.read_file(spark, str(tmp_path / "*.csv"), "n string, t string, u string", multi_line=True)
            assert plain_breaks(whole) == plain_breaks(wanted)
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)


def test_states_compose():
    """Ranges of any lines, from either state: the end of the whole is the end of its parts."""
    chance = random.Random(3)
    for _ in range(2000):
        line = "".join(chance.choice('ab",,""') for _ in range(chance.randrange(8)))
        for inside in (False, True):
            state, field_start, k = inside, not inside, 0
            while k < len(line):  # the plain automaton, a character at a time
                c = line[k]
                if state:
                    if c == '"' and line[k + 1 : k + 2] == '"':
                        k += 1
                    elif c == '"':
                        state, field_start = False, False
                elif c == '"' and field_start:
                    state = True
                else:
                    field_start = c == ","
                k += 1
            assert quoted.ends_inside(line, inside) == state, (line, inside)


def test_ingest_of_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('text,label\n"good\nday, all",positive\n"bad ""day""",negative\n')
    got = files.read_file(spark, str(tmp_path / "in.csv")).collect()
    assert sorted(map(tuple, got)) == [('bad "day"', "negative"), ("good\nday, all", "positive")]


def test_other_suffix_is_an_error(spark):
    with pytest.raises(ValueError):
        files.read_file(spark, "/data/file.xlsx")


def test_list_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("12345")
    (tmp_path / "y.log").write_text("1")
    assert files.directory_size(spark, str(tmp_path)).first().asDict() == {"n_files": 2, "size_bytes": 6}
    assert files.list_files(spark, str(tmp_path), "*.txt").first()["length"] == 5


def old_and_new(folder):
    for name, days_ago in (("a/x.txt", 40), ("a/y.log", 40), ("b/z.txt", 1), ("w.txt", 40)):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
        os.utime(path, (time.time() - 86400 * days_ago,) * 2)


def test_expire_files(spark, tmp_path):
    old_and_new(tmp_path)
    cutoff = F.current_timestamp() - F.expr("INTERVAL 30 DAYS")
    plan = {"deleted_count": 2, "deleted_size_mb": 0.0, "dry_run": True}
    assert files.expire_files(spark, str(tmp_path), cutoff, "*.txt") == plan and (tmp_path / "w.txt").exists()
    assert files.expire_files(spark, str(tmp_path), cutoff, "*.txt", dry_run=False) == {**plan, "dry_run": False}
    assert sorted(p.name for p in tmp_path.rglob("*.*") if not p.name.startswith(".")) == ["y.log", "z.txt"]


def test_archive_files(spark, tmp_path):
    old_and_new(tmp_path / "in")
    cutoff = F.current_timestamp() - F.expr("INTERVAL 30 DAYS")
    archive = str(tmp_path / "archive")
    assert files.archive_files(spark, str(tmp_path / "in"), archive, cutoff, "*.txt") == {"archived_count": 2, "archive_dir": archive}
    assert (tmp_path / "archive/a/x.txt").read_text() == "12345" and (tmp_path / "archive/w.txt").exists()
    assert (tmp_path / "in/a/y.log").exists() and (tmp_path / "in/b/z.txt").exists() and not (tmp_path / "in/w.txt").exists()
    old_and_new(tmp_path / "in")
    with pytest.raises(FileExistsError):
        files.archive_files(spark, str(tmp_path / "in"), archive, cutoff, "*.txt")


def test_discover_datasets(spark, tmp_path):
    rows = spark.range(10).withColumn("kind", F.col("id") % 2)
    for name, count in (("org--set", 10), ("org/other", 4), ("ORG--SET2", 3), ("org--set2", 5), ("split/train", 6), ("split/test", 2)):
        rows.limit(count).coalesce(1).write.parquet(str(tmp_path / name))
    rows.write.partitionBy("kind").parquet(str(tmp_path / "parted"))
    got = {r["dataset_id"]: r for r in catalog.discover_datasets(spark, str(tmp_path)).collect()}
    assert {k: r["num_rows"] for k, r in got.items()} == {"org/set": 10, "org/other": 4, "ORG/SET2": 3, "split": 8, "parted": 10}
    assert got["split"]["splits"] == ["test", "train"] and got["parted"]["splits"] == ["train"] and got["parted"]["size_mb"] > 0
    assert spark.read.parquet(got["org/other"]["path"]).count() == 4


def days(n):
    return f"2024-01-{n:02d} 00:00:00"


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("kind"))
    assert versioned.write_version(rows, path, days(1), "error", partition_by=["kind"]) == 0
    with pytest.raises(ValueError):
        versioned.write_version(rows, path, days(1), "error")
    more = spark.range(10, 15).select("id", (F.col("id") % 2).alias("kind"), F.lit("new").alias("extra"))
    assert versioned.write_version(more, path, days(2), partition_by=["kind"]) == 1
    with pytest.raises(ValueError):
        versioned.write_version(rows.withColumn("id", F.col("id").cast("string")), path, days(2))
    assert versioned.write_version(rows.where("id < 3"), path, days(5), "overwrite", schema_mode="overwrite") == 2

    assert versioned.read_version(spark, path).count() == 3
    second = versioned.read_version(spark, path, version=1)
    assert second.columns == ["id", "kind", "extra"] and second.count() == 15
    assert second.where("extra is null").count() == 10
    assert versioned.read_version(spark, path, timestamp=days(1)).count() == 10
    assert versioned.read_version(spark, path, timestamp=days(4), columns=["id"]).columns == ["id"]
    for bad in ({"version": 9}, {"timestamp": "2020-01-01 00:00:00"}):
        with pytest.raises(ValueError):
            versioned.read_version(spark, path, **bad)
    assert [r["version"] for r in versioned.history(versioned.read_commits(spark, path), 2).collect()] == [2, 1]

    stats = versioned.table_statistics(spark, path).first()
    assert (stats["num_rows"], stats["num_columns"], stats["version"]) == (3, 2, 2) and stats["size_bytes"] > 0

    # Version 1 was still current a week before the 11th, so nothing may go yet.
    assert versioned.vacuum(spark, path, days(11)) == []
    assert versioned.vacuum(spark, path, days(12)) == [0, 1]
    assert versioned.read_version(spark, path, version=1).count() == 15
    assert versioned.vacuum(spark, path, days(12), dry_run=False) == [0, 1]
    assert versioned.read_version(spark, path).count() == 3
    assert not (tmp_path / "t" / "data" / "commit_version=0").exists()


def test_uncommitted_files_are_invisible(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.write_version(spark.range(4), path, days(1))
    spark.range(100).write.parquet(f"{path}/data/commit_version=1")
    assert versioned.read_version(spark, path).count() == 4
    assert versioned.write_version(spark.range(2), path, days(2)) == 1
    assert versioned.read_version(spark, path).count() == 6


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.write_version(spark.range(1000).repartition(12), path, days(1))
    versioned.write_version(spark.range(1000, 1500).repartition(5), path, days(2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    done = versioned.compact(spark, path, days(3))
    assert done == {"version": 2, "files_before": 17, "files_after": 1}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert versioned.read_version(spark, path).agg(F.count("*"), F.sum("id")).first() == (1500, 1500 * 1499 // 2)


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "root")
    source = tmp_path / "in.csv"
    source.write_text("text,label\nhello,a\n")
    path = catalog.import_file(spark, root, str(source), "org/set", days(1), label_column="label")
    assert path.endswith("org--set")
    catalog.register(spark.range(5), root, "org/set", days(2), text_column="id")
    row = catalog.read_catalog(spark, root).collect()
    assert len(row) == 1 and (row[0]["num_rows"], row[0]["columns"]) == (5, ["id"])
    with pytest.raises(ValueError):
        catalog.register(spark.range(1), root, "x", days(1), colour="red")
    assert catalog.update_quality(spark, root, "org/set", days(3), "passed", 91.5)
    assert not catalog.update_quality(spark, root, "absent", days(3), "passed", 1.0)
    row = catalog.read_catalog(spark, root).first()
    assert (row["quality_status"], row["quality_score"], row["num_rows"], row["columns"]) == ("passed", 91.5, 5, ["id"])
    assert catalog.delete_dataset(spark, root, "org/set", days(4)) and not catalog.delete_dataset(spark, root, "org/set", days(5))
    assert catalog.read_catalog(spark, root).isEmpty() and catalog.read_catalog(spark, root, deleted=True).count() == 1
    assert catalog.describe_datasets(spark, {}).isEmpty()
    described = catalog.describe_datasets(spark, {"org/set": path, "org--set": path}).collect()
    assert len(described) == 1 and described[0]["splits"] == ["train"] and described[0]["size_mb"] > 0


def test_sql_access(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    assert sql.query_path(spark, path).count() == 10
    assert sql.query_path(spark, path, "SELECT max(id) AS m FROM {{path}} WHERE id < :top", top=5).first()["m"] == 4
    sql.register_views(spark, {"numbers": spark.range(3)})
    sql.create_view(spark, "doubled", "SELECT id * 2 AS d FROM numbers")
    out = sql.export(spark, "SELECT * FROM doubled WHERE d > 0", str(tmp_path / "out"))
    assert sorted(r["d"] for r in spark.read.parquet(out).collect()) == [2, 4]
    assert [tuple(r) for r in sql.describe(spark.table("doubled")).collect()] == [(0, "d", "bigint", False)]


def test_jdbc_options():
    read = sql.jdbc_read_options("jdbc:x", "t", "id", 0, 100, 8, user="u")
    assert read == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "user": "u", "partitionColumn": "id",
                    "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    assert "partitionColumn" not in sql.jdbc_read_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        sql.jdbc_read_options("jdbc:x", "t", "id")
    assert sql.jdbc_write_options("jdbc:x", "t", 500)["batchsize"] == "500"


def test_functions(spark):
    functions = sql.Functions(spark)
    functions.register("shout", lambda s: s.upper() + "!", "string")
    assert functions.names() == ["shout"] and functions.get("none") is None
    assert spark.sql("SELECT shout('a') AS s").first()["s"] == "A!"
    assert any(f.name == "shout" for f in spark.catalog.listFunctions())
    out = sql.map_batches(spark.range(3), lambda b: pd.DataFrame({"twice": b["id"] * 2}), "twice long")
    assert sorted(r["twice"] for r in out.collect()) == [0, 2, 4]


def test_ingest_publishes_or_rejects(spark, tmp_path):
    root = str(tmp_path / "root")
    good = tmp_path / "Good Set.csv"
    good.write_text("text,label\n" + "\n".join(f"text {i},{'positive' if i % 2 else ''}" for i in range(20)) + "\ntext 1,POSITIVE\n")
    done = I.ingest_file(spark, str(good), root, days(1), name="Good Set")
    assert done.quality_passed and (done.rows, done.columns, done.quality_score) == (20, 2, 100.0)
    assert sorted(r["label"] for r in spark.read.parquet(done.path).select("label").distinct().collect()) == ["positive", "unspecified"]
    report = json.loads(spark.read.text(done.report_path).first()["value"])
    assert report["total_rows"] == 20 and report["timestamp"] == days(1)

    again = I.ingest_file(spark, str(good), root, days(1), name="Good Set")
    assert again.dataset_id == "good-set-2" and again.path != done.path
    assert spark.read.parquet(done.path).count() == spark.read.parquet(again.path).count() == 20

    repeated = spark.createDataFrame([("same", "positive")] * 5, "text string, label string")
    failed = I.ingest(repeated, root, "bad", days(2), C.SENTIMENT.with_overrides(drop_duplicates=False))
    assert not failed.quality_passed and failed.path is None
    assert {i["type"] for i in failed.issues} == {"uniqueness", "consistency"}
    assert sorted(r["dataset_id"] for r in catalog.read_catalog(spark, root).collect()) == ["good-set", "good-set-2"]
    log = {r["dataset_id"]: r["status"] for r in catalog.read_validations(spark, root).collect()}
    assert log == {"good-set": "passed", "good-set-2": "passed", "bad": "failed"}


def test_csv_line_breaks_are_an_option(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('text,label\n"one\ntwo",a\n')
    assert files.read_file(spark, str(path), multi_line=True).first()["text"] == "one\ntwo"
    assert files.read_file(spark, str(path)).count() == 2


def test_append_records(spark, tmp_path):
    path = str(tmp_path / "log")
    catalog.append_records(spark.range(3), path)
    catalog.append_records(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
