import pytest
from pyspark.sql import functions as F

from tidewater.operators import prepare as P


def test_split_is_stable_and_about_the_fraction(spark):
    df = spark.range(20_000)
    one = P.with_split(df.repartition(1), "id", 0.1, 42)
    many = P.with_split(df.repartition(16), "id", 0.1, 42)
    assert one.exceptAll(many).isEmpty()
    share = one.where("split = 'validation'").count() / 20_000
    assert 0.09 < share < 0.11
    assert not P.with_split(df, "id", 0.1, 43).exceptAll(one).isEmpty()
    with pytest.raises(ValueError):
        P.with_split(df, "id", 1.0)


def test_choose_split(spark):
    df = spark.createDataFrame([(1, "test"), (2, "dev"), (3, "dev")], "id int, split string")
    assert sorted(r["id"] for r in P.choose_split(df).collect()) == [2, 3]
    trained = df.union(spark.createDataFrame([(4, "train")], df.schema))
    assert [r["id"] for r in P.choose_split(trained).collect()] == [4]


def test_tokenize(spark):
    df = spark.createDataFrame([("a b  c",), ("",), ("x y z u v",)], "text string")
    got = [(r["tokens"], r["n_tokens"], r["n_kept"]) for r in P.tokenize(df, max_length=4, pad="_").collect()]
    assert got == [(["a", "b", "c", "_"], 3, 3), (["_"] * 4, 0, 0), (["x", "y", "z", "u"], 5, 4)]
    assert P.tokenize(df, max_length=4, pad=None).first()["tokens"] == ["a", "b", "c"]


@pytest.mark.parametrize("batch,steps", [(1, 32), (4, 8), (5, 7), (64, 1), (0, 32)])
def test_accumulation_steps(batch, steps):
    assert P.accumulation_steps(batch) == steps


@pytest.mark.parametrize("turns", [1, 3, 1024])
def test_pairs_cross_slice_borders(spark, turns):
    talk = [(1, 0, "system", "s"), (1, 2, "user", "q1"), (1, 5, "assistant", "a1"), (1, 6, "user", "q2"), (1, 7, "user", "q3"),
            (1, 9, "assistant", "a3"), (2, 0, "user", "only")]
    df = spark.createDataFrame(talk, "conv_id int, turn int, role string, text string").repartition(4)
    out = P.prompt_responses(df, turns_per_slice=turns)
    assert sorted((r["prompt"], r["response"], r["text"]) for r in out.collect()) == [("q1", "a1", "q1a1"), ("q3", "a3", "q3a3")]


def test_long_conversations_come_in_parts(spark):
    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                F.col("id").cast("string").alias("text")).repartition(5)
    whole = P.chat_messages(df.withColumn("turn", F.col("turn") + 1015)).collect()
    assert [len(r["messages"]) for r in whole] == [25]
    parts = P.chat_messages(df.withColumn("turn", F.col("turn") * 500), messages_per_part=10).orderBy("part").collect()
    assert [len(p["messages"]) for p in parts] == [10, 10, 5]
    assert [m["content"] for p in parts for m in p["messages"]] == [str(i) for i in range(25)]


def test_reward(spark):
    texts = ["", "one two two", "I HATEful thing", "A a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def expected(text):
        words = text.split()
        toxic = any(w in text.lower() for w in ("hate", "violence", "offensive"))
        return len(words) / 100 + len(set(words)) / max(len(words), 1) - (2.0 if toxic else 0.0)

    for row in P.with_reward(df).collect():
        assert row["reward"] == pytest.approx(expected(row["text"]))


def test_preference_pairs_skip_groups_without_difference(spark):
    data = [("p", 1, "x", 0.5), ("p", 2, "y", 0.9), ("p", 3, "z", 0.9), ("q", 4, "same", 0.1), ("q", 5, "same", 0.3)]
    df = spark.createDataFrame(data, "prompt string, id int, response string, reward double")
    out = P.preference_pairs(df, ["prompt"], "response").collect()
    assert [(r["prompt"], r["chosen"], r["rejected"]) for r in out] == [("p", "z", "x")]
