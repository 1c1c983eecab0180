import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, row string, kept boolean, keep_id string, size string, key string,"
    " rank int, block int, draws string, shard string, fingerprint string, component_id string, label string, score string,"
    " _text string, _id string, range string"
)


def odd_rows():
    """Null and empty texts, ties, repeated rows, a very long text, null keys; the other columns have clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    texts = [
        (1, "alpha beta gamma delta", "en", "a"),
        (2, "alpha beta gamma delta", "en", "a"),
        (2, "alpha beta gamma delta", "en", "a"),
        (3, "", "en", None),
        (4, None, None, "b"),
        (5, " \t\n", "de", "b"),
        (6, long, "en", "a"),
        (7, long + " x", "en", "a"),
        (8, "one", None, None),
        (None, "alpha beta gamma delta", "fr", "c"),
        (None, "only here", "fr", "c"),
        (9, "ÄÖÜ é́ 日本語 <|endoftext|> 😀", "de", "c"),
        (10, "1234 !!! ###", "de", "c"),
    ]
    return [(*t, "x", True, "k", "s", "key", 1, 2, "d", "h", "f", "c", "l", "s", "t", "i", "r") for t in texts]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
