import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import clean as C

TEXTS = ["  a good day ", "\t a \n", "  ", "", None, "badge of GREAT hope", "bad but lovely", "plain"]


def frame(spark, partitions=3):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, text string, label string").repartition(partitions)


def test_strip_is_unicode_aware(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for row in df.select("t", X.strip(F.col("t")).alias("s"), X.words(F.col("t")).alias("w")).collect():
        assert row["s"] == row["t"].strip()
        assert row["w"] == row["t"].split()


def test_missing_text_is_dropped(spark):
    out = C.drop_missing_text(C.strip_text(frame(spark), "text"), "text")
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 5, 6, 7]


@pytest.mark.parametrize("partitions", [1, 16])
def test_first_rule_wins_and_matches_inside_words(spark, partitions):
    out = C.clean(frame(spark, partitions), C.SENTIMENT, keep=("id",))
    got = {r["id"]: r["label"] for r in out.collect()}
    assert got == {0: "positive", 1: "unspecified", 5: "positive", 6: "positive", 7: "unspecified"}


def test_one_changed_keyword_changes_the_answer(spark):
    rules = [C.LabelRule("Neg", ("bad",)), C.LabelRule("pos", ("good", "love"))]
    out = C.clean(frame(spark), C.SENTIMENT.with_overrides(label_rules=rules), keep=("id",))
    assert {r["id"]: r["label"] for r in out.collect()}[6] == "neg"


def test_many_keywords_find_what_a_few_do(spark, monkeypatch):
    chance = random.Random(1)
    letters = "abÉ ."
    word = lambda n: "".join(chance.choice(letters) for _ in range(n))
    rules = tuple(C.LabelRule(f"L{i}", tuple(word(chance.randrange(1, 5)) for _ in range(chance.randrange(4)))) for i in range(30))
    rows = [(i, chance.choice([None, "", word(chance.randrange(1, 12))]), chance.choice([None, None, "kept"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    answer = lambda given: {r["id"]: r["label"] for r in C.auto_label(df, "text", "label", given, "none").collect()}
    for given in (rules, (*rules[:5], C.LabelRule("any", ("",)), *rules[5:])):
        monkeypatch.setattr(X, "COMPARED_KEYWORDS", 10**6)
        compared = answer(given)
        monkeypatch.setattr(X, "COMPARED_KEYWORDS", 0)
        assert answer(given) == compared
    thousands = (C.LabelRule("far", tuple(f"word{i}x" for i in range(10_000))), C.LabelRule("near", ("a",)))
    assert set(answer(thousands).values()) == {"kept", "near", "none"}


def test_keywords_are_literal_and_an_empty_rule_matches_nothing(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "text string")
    config = C.CleanConfig().with_overrides(label_rules=[C.LabelRule("none", ()), C.LabelRule("dot", ("a.c",))])
    assert {r["text"]: r["label"] for r in C.clean(df, config).collect()} == {"a.c": "dot", "abc": "unspecified"}


@pytest.mark.parametrize(
    "value,expected",
    [(None, None), ("None", None), ("NaN", None), ("", None), ("Positive", "positive"), ("other", None)],
)
def test_label_normalisation(spark, value, expected):
    df = spark.createDataFrame([(value,)], "label string")
    out = C.normalise_labels(df, "label", allowed=("Positive", "negative"))
    assert out.first()["label"] == expected


def test_label_case_is_kept_without_lowercasing(spark):
    df = spark.createDataFrame([("None",), ("none",)], "label string")
    out = C.normalise_labels(df, "label", lowercase=False)
    assert sorted(str(r["label"]) for r in out.collect()) == ["None", "None"]
    assert out.where("label = 'None'").count() == 1


def test_integer_and_boolean_labels(spark):
    ints = spark.createDataFrame([("a", 1), ("b", None)], "text string, label int")
    config = C.CleanConfig(drop_missing_label=False)
    assert {r["text"]: r["label"] for r in C.clean(ints, config).collect()} == {"a": "1", "b": None}
    flags = spark.createDataFrame([("a", True)], "text string, label boolean")
    assert C.clean(flags, config).first()["label"] == "true"


@pytest.mark.parametrize("name", ["target", "Class", "my_label"])
def test_label_column_is_found_by_name(spark, name):
    df = spark.createDataFrame([(1, "x", "y")], f"n int, body string, `{name}` string")
    assert C.resolve_label_column(df) == name
    assert C.resolve_text_column(df) == "body"
    assert tuple(C.clean(df, C.CleanConfig()).first()) == ("x", "y")


def test_override_columns(spark):
    df = spark.createDataFrame([("t", "l", "other")], "text string, label string, more string")
    assert C.resolve_text_column(df, "more") == "more"
    assert C.resolve_text_column(df, "absent") == "text"
    assert C.resolve_label_column(df.drop("label"), None) is None


def test_no_text_column_is_an_error(spark):
    with pytest.raises(ValueError):
        C.clean(spark.createDataFrame([(1,)], "n int"))


def test_duplicates_compare_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x")], "text string, label string")
    assert C.clean(df, C.CleanConfig(drop_missing_label=False)).count() == 2
    assert C.clean(df, C.CleanConfig(drop_missing_label=False, drop_duplicates=False)).count() == 3


def test_config_from_json():
    config = C.CleanConfig.from_json('{"label_rules": [{"label": "x", "keywords": ["y"]}], "drop_duplicates": false}')
    assert config.label_rules == (C.LabelRule("x", ("y",)),)
    assert not config.drop_duplicates and config.quality_threshold == 80.0


def test_dataset_ids_are_unique_and_stable(spark):
    names = ["A b", "a-B", "!!", "a b!", "a-b-2", "??"]
    df = spark.createDataFrame(list(enumerate(names)), "n long, name string")
    one = {r["n"]: r["dataset_id"] for r in C.build_dataset_ids(df, "name", "n", rows_per_slice=2).collect()}
    assert len(set(one.values())) == len(names)
    assert one == {0: "a-b", 1: "a-b-3", 2: "dataset", 3: "a-b-4", 4: "a-b-2", 5: "dataset-2"}
    many = {r["n"]: r["dataset_id"] for r in C.build_dataset_ids(df.repartition(16), "name", "n").collect()}
    assert one == many


def test_dataset_ids_skip_what_is_taken(spark):
    def ids(names, taken=()):
        df = spark.createDataFrame(list(enumerate(names)), "n long, name string")
        held = spark.createDataFrame([(t,) for t in taken], "dataset_id string") if taken else None
        return [r["dataset_id"] for r in C.build_dataset_ids(df, "name", "n", taken=held).orderBy("n").collect()]

    assert ids(["a", "a-2", "a"]) == ["a", "a-2", "a-3"]
    assert ids(["a"], ["a"]) == ["a-2"]
    assert ids(["a"], ["a", "a-2", "a-4"]) == ["a-3"]
    assert ids(["a", "a"], ["a", "a-2", "a-4"]) == ["a-3", "a-5"]
    assert ids(["a-2", "a", "a"], ["a-2"]) == ["a-2-2", "a", "a-3"]


def test_directory_names(spark):
    df = spark.createDataFrame([("org/set",)], "a string").select(X.safe_dir_name(F.col("a")).alias("d"), "a")
    assert df.select("d", X.from_safe_dir_name(F.col("d")).alias("back")).first() == ("org--set", "org/set")
    unnamed = spark.createDataFrame([("",), (None,)], "a string").select(X.safe_dir_name(F.col("a")).alias("d"))
    assert {r["d"] for r in unnamed.collect()} == {"unnamed_dataset"}


def test_keep_columns_come_from_the_first_row_of_a_group(spark):
    df = spark.createDataFrame([(2, "z", "t", "l"), (1, "y", "t", "l"), (3, "x", "u", "l")], "k int, m string, text string, label string")
    one = C.clean(df, C.CleanConfig(), keep=("k",))
    assert one.columns == ["k", "text", "label"] and sorted(r["k"] for r in one.collect()) == [1, 3]
    two = C.clean(df, C.CleanConfig(), keep=("k", "m"))
    assert sorted((r["k"], r["m"]) for r in two.collect()) == [(1, "y"), (3, "x")]


def test_numbers_of_a_popular_name(spark):
    """Rows of one slug beside many numbers in use, of the batch and taken: the k-th row gets the k-th free one."""
    chance = random.Random(7)
    names = ["a"] * 40 + [f"a-{n}" for n in chance.sample(range(2, 60), 20)] + ["b"] * 3 + ["b-1"]
    chance.shuffle(names)
    taken = ["a", "a-5", "a-61", "a-2", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "n long, name string").repartition(3)
    held = spark.createDataFrame([(t,) for t in taken], "dataset_id string")
    got = {r["n"]: r["dataset_id"] for r in C.build_dataset_ids(df, "name", "n", rows_per_slice=16, taken=held).collect()}
    used, seen = set(names) | set(taken), {}
    expected = {}
    for n, name in enumerate(names):
        if name not in seen and name not in taken:
            seen[name] = 1
            expected[n] = name
            continue
        number = seen.get(name, 1) + 1
        while f"{name}-{number}" in used:
            number += 1
        seen[name] = number
        expected[n] = f"{name}-{number}"
    assert got == expected
