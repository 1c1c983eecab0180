import pytest
from pyspark.sql import functions as F

from tidewater.operators import envelope as V

FIRST, SECOND = "0123456789abcdef", b"fedcba9876543210fedcba9876543210"
ROWS = [(1, "a", "one"), (2, "a", "one"), (3, "b", None), (4, None, "four"), (5, "group a", "five")]


def test_rotation_writes_the_key_table_alone(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, g string, s string")
    path, data = str(tmp_path / "keys"), tmp_path / "data"
    keys = V.add_groups(df, "g", path, FIRST, "m1")
    assert {r["key_group"] for r in keys.collect()} == {"a", "b", None, "group a"}
    V.encrypt_by_group(df, ["s"], "g", keys, FIRST).write.parquet(str(data))
    stored = spark.read.parquet(str(data))
    values = {r["id"]: r["s"] for r in stored.collect()}
    assert values[1] != values[2] and values[3] is None
    files = {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in data.iterdir()}
    turned = V.rotate_master(spark, path, FIRST, SECOND, "m2")
    assert {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in data.iterdir()} == files
    read = lambda master: {r["id"]: r["s"] for r in V.decrypt_by_group(stored, ["s"], "g", turned, master).collect()}
    assert read(SECOND) == {i: s for i, _, s in ROWS} and set(read(FIRST).values()) == {None}
    assert [p.name for p in (tmp_path / "keys").iterdir()] == ["generation=1"]
    with pytest.raises(Exception, match="AES"):
        V.rotate_master(spark, path, FIRST, SECOND, "m3")  # the old key opens nothing
    assert {r["master_id"] for r in V.key_table(spark, path).collect()} == {"m2"}


def test_groups_are_added_and_bound(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, g string, s string")
    path = str(tmp_path / "keys")
    first = {r["key_group"]: bytes(r["wrapped"]) for r in V.add_groups(df.where("g = 'a'"), "g", path, FIRST, "m1").collect()}
    keys = V.add_groups(df, "g", path, FIRST, "m1")
    again = {r["key_group"]: bytes(r["wrapped"]) for r in keys.collect()}
    assert len(again) == 4 and again["a"] == first["a"]
    stored = V.encrypt_by_group(df, ["s"], "g", keys, FIRST)
    swapped = keys.withColumn("key_group", F.when(F.col("key_group") == "a", "b").when(F.col("key_group") == "b", "a").otherwise(F.col("key_group")))
    opened = {r["id"]: r["s"] for r in V.decrypt_by_group(stored, ["s"], "g", swapped, FIRST).collect()}
    assert opened == {1: None, 2: None, 3: None, 4: "four", 5: "five"}
    with pytest.raises(Exception, match="without a data key"):
        V.encrypt_by_group(df, ["s"], "g", keys.where("key_group = 'a'"), FIRST).collect()
    with pytest.raises(ValueError):
        V.rotate_master(spark, str(tmp_path / "none"), FIRST, SECOND, "m2")
