import re
from collections import Counter

import pytest

from tidewater.llm import quality
from tidewater.llm.quality import Fences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(inside)


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t", "a b c d e f", "a b c d e a b c d e x", "l\nl\n\n l\nl", "x # * $ % & | < >", "é́ 日本  x",
        "a a a a a a a", "q w e r t " * 50, "a\x0bb\x0cc\rd\x1ce",
    ],
)
def test_counts(text):
    assert quality.count_words(text.encode(), len(text)) == brute_counts(text)


def brute_fences(rows, fences):
    """Tenths of whole groups over exact values; rows are (group key, values)."""
    out = {}
    for key in {k for k, _ in rows}:
        own = [v for k, v in rows if k == key]
        limits = []
        for m, name in enumerate(quality.MEASURES):
            values = sorted(v[m] for v in own)
            low, middle, high = (values[-(-len(values) * tenths // 10) - 1] for tenths in (1, 5, 9))
            most = high + fences.spread * (high - middle) + fences.room[m]
            limits.append((low - fences.spread * (middle - low) - fences.room[m] if name in quality.TWO_SIDED else 0, most))
        out[key] = limits
    return out


WORDS = "the quick brown fox jumps over that lazy dog and runs far away from here again".split()


def plain(k, length=20):
    return " ".join(WORDS[(k + j * (1 + k % 5)) % len(WORDS)] + str(j) for j in range(length))


def repetitive(k):
    """110 words of which 20 are repeated: 18 %, below the base rule's 20 %."""
    words = plain(k, 100).split()
    return " ".join(words + words[5:15])


def test_kept_by_group_limits(spark):
    rows = []
    for k in range(900):
        lang, source = ("en", "a") if k % 2 else ("de", None)
        text = plain(k)
        if k % 50 == 3:
            text = " ".join(w + "###" for w in text.split())
        if k % 50 == 7:
            text = "\n".join(["x", "x", "x", text])
        if k % 50 == 9:
            text = " ".join(w * 5 for w in text.split())
        rows.append((k, text, lang, source))
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (1002, " ".join(map(str, range(12))), "xx", "z")]
    rows += [(1003, repetitive(1), "en", "a")]
    # A source of 20 odd documents, in a language of plain ones, and one that is odd even there.
    rows += [(2000 + k, " ".join(w + "#" for w in plain(k).split()), "en", "code") for k in range(20)]
    rows += [(2020, " ".join(w + "#" * 9 for w in plain(3).split()), "en", "code")]
    fences = Fences(bits=40)  # so many bits keep every value as it is
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df, fences).collect()}
    measured, failed = {}, {}
    for k, text, lang, source in rows:
        counts = brute_counts(text)
        failed[k] = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        measured[k] = ((lang, source), [1000 * counts[c] // max(1, counts[0]) for c in (2, 3, 4, 1)])
        assert tuple(got[k][c] for c in quality.COUNTS) == counts
    passed = [k for k in measured if not failed[k]]
    limits = brute_fences([measured[k] for k in passed], fences)
    for k, (group, values) in measured.items():
        assert got[k]["base_failed"] == failed[k]
        kept = not failed[k] and all(low <= v <= high for v, (low, high) in zip(values, limits[group], strict=True))
        assert got[k]["kept"] == kept, k
    dropped = {k for k in passed if not got[k]["kept"]}
    assert {3, 7, 9} <= {k % 50 for k in dropped if k < 900} and got[1002]["kept"]
    assert 1003 in dropped and {k for k in dropped if k >= 2000} == {2020}


def test_equal_values_of_a_group_are_kept(spark):
    """Wide buckets hold values above their bottom: a document that is its own group stays within its own fences."""
    rows = [(k, " ".join("w" * (3 + k % 7) + "#" * (k % 11) for _ in range(40 + k)), "l", f"s{k}") for k in range(60)]
    rows = [(k, " ".join(f"{w}{i}" for i, w in enumerate(t.split())), lang, s) for k, t, lang, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r["kept"] for r in quality.judge(df).collect())


def test_buckets_merge_and_are_near(spark):
    from pyspark.sql import functions as F

    for r in spark.range(0, 200_000, 37).select("id", quality.bucket(F.col("id"), 7).alias("b")).collect():
        assert r["b"] <= r["id"] <= r["b"] * (1 + 2**-6) and (r["id"] >= 128 or r["b"] == r["id"])


def test_odd_rows(odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count() and all(not r["kept"] for r in got if r["n_words"] < 10)
    assert quality.judge(empty).count() == 0


def test_small_sources_are_judged_by_what_larger_sets_lend(spark):
    """The outer tenth of fewer than ten documents is empty: alone they would all be kept, however odd."""
    odd_text = lambda k: " ".join(w + "###" for w in plain(k).split())
    rows = [(k, plain(k), "en", f"s{k % 80}") for k in range(640)]
    rows += [(1000, odd_text(1), "en", "s1"), (1001, odd_text(2), "en", "alone"), (1002, odd_text(3), "xx", "alone"), (1003, odd_text(4), None, None)]
    rows += [(1004, plain(5), "en", "plain"), (1005, repetitive(2), "en", "s2")]
    rows += [(2000 + k, odd_text(k), "en", "code") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dropped = lambda fences: {r["doc_id"] for r in quality.judge(df, fences).collect() if not r["kept"]}
    assert dropped(Fences()) == set()
    assert dropped(Fences(lent=20)) == {1000, 1001, 1002, 1003, 1005}


def test_lent_documents_are_the_middles_of_equal_parts(spark):
    values = [1, 1, 1, 2, 5, 8, 8, 9, 9, 9, 12]
    cells = spark.createDataFrame([("g", 0, v, 1) for v in values], "group string, measure int, bucket long, n long")
    for lent in (1, 2, 4, 20):
        got = sorted(v for r in quality.lent_cells(cells, ["group"], lent).collect() for v in [r["bucket"]] * r["n"])
        places = [-(-len(values) * (2 * k + 1) // (2 * lent)) - 1 for k in range(lent)]
        assert got == [values[p] for p in places]
