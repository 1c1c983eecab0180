import random
import re
from fractions import Fraction

import pytest

from tidewater.llm import licenses, queries
from tidewater.llm.licenses import Templates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, templates):
    """Every block beside every notice."""
    words = WORD.findall(lower(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(own)] == own:
                places.append(k)
                base.add(label)
    labels, score, spans, start = set(base), 0.0, [], 0
    m = templates.longest
    for sentence in re.split(licenses.SENTENCE_END, lower(text)):
        own = WORD.findall(sentence)
        cuts = [(0, len(own))] if len(own) <= 2 * m else [(s, min(len(own), s + 2 * m)) for s in range(0, len(own) - m, m)]
        for a, b in cuts:
            for k, (label, notice) in enumerate(templates.notices):
                wanted = set(WORD.findall(lower(notice)))
                shared = len(wanted & set(own[a:b]))
                if shared >= templates.share * len(wanted):
                    labels.add(label)
                    score = max(score, shared / len(wanted))
                    spans.append((k, start + a, b - a, shared / len(wanted)))
        start += len(own)
    edge = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *edge, sorted(base), sorted(labels), score, sorted(spans))


def found(df, templates=Templates()):
    return [
        (r["doc_id"], (*(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")), sorted(map(tuple, r["spans"]))))
        for r in licenses.scan(df, templates).collect()
    ]


TEXTS = [
    "Released under the MIT License.", "released\nunder the  mit license", "Released under the license. MIT",
    "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 3", "cc by cc by", "CC-BY-NC 4.0 licensed under",
    "All rights reserved", "all rights.\n\nReserved", "General Public License", "wörd all rights reserved é", "", None, " \n.\n",
    "x " * 5000 + licenses.NOTICES[2][1] + " y" * 5000, licenses.NOTICES[12][1].replace("free of charge, ", ""),
    "permission is hereby granted " * 400, "\x00all\x7frights\x01reserved", "A.b! c? d.\te",
]


def test_equals_brute_force(spark):
    templates = Templates()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(found(df)) == [(k, brute(text, templates)) for k, text in enumerate(TEXTS)]


@pytest.mark.parametrize("share", [Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_random_sets(spark, share):
    """Few different words, so that prefixes, lengths and positions all decide."""
    chance = random.Random(int(share * 10))
    alphabet = [f"w{k}" for k in range(12)]
    weights = [1 / (k + 1) for k in range(12)]
    notices = tuple((f"n{k}", " ".join(chance.sample(alphabet, chance.randrange(1, 9)))) for k in range(10))
    templates = Templates(notices, share)
    texts = [". ".join(" ".join(chance.choices([*alphabet, "zz"], [*weights, 1], k=chance.randrange(30))) for _ in range(4)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(found(df, templates)) == [(k, brute(text, templates)) for k, text in enumerate(texts)]


def test_odd_rows(spark, odd, empty):
    templates = Templates()
    expected = sorted(((r["doc_id"], brute(r["text"], templates)) for r in odd.collect()), key=repr)
    assert sorted(found(odd), key=repr) == expected
    assert found(empty) == []
    assert licenses.scan(odd, Templates(())).where("size(labels) > 0").count() == 0


def test_query_finds_planted_lines(spark, tmp_path):
    rows = [(1, "Some words here.\nReleased under the MIT License."), (2, "clean text about a license and the mit of things"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in queries.license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
