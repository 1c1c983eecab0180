import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import bpe, queries, tokenfile
from tidewater.llm.common import shared_folder, vocabulary

ALPHABET = [
    *"abcABC'sΣσİıßéeé́ \t\n\r\x1c\x1f\x0b\u0085\xa0　﻿123½①日本語한국aaaalllee😀‍.!<|>",
    "<|endoftext|>", "<|startoftext|>", "ﬁ", "Å", "\x00", " 's", "'re", "''s", "  ", "×", "÷", "ª", "µ",
]


@pytest.fixture(scope="module")
def specification():
    with open(vocabulary(), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(specification):
    return Tokenizer.from_str(specification)


def samples(count, seed, letters=ALPHABET, longest=60):
    chance = random.Random(seed)
    return ["".join(chance.choice(letters) for _ in range(chance.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize("kind", [bpe.WordBpe, tokenfile.LibraryBpe])
def test_encodes_like_the_library(specification, library, kind):
    model = kind(specification)
    texts = ["", *samples(3000, 1), *samples(500, 2, "aeinthrosl", 300), "a" * 5000, "anan" * 1000]
    for text, got in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_decodes_like_the_library(specification, library):
    model = bpe.WordBpe(specification)
    for text in samples(500, 3):
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert model.decode([5, 10**6, 6]) == library.decode([5, 6], skip_special_tokens=False)


def test_pair_index_merges_overlaps_from_the_left():
    merges = bpe.Merges([(0, 0, 1), (1, 1, 2), (1, 0, 3)])
    words = [[0] * n for n in range(1, 9)]
    symbols = np.concatenate([np.array(w, dtype=np.int64) for w in words])
    ids, counts = bpe.PairIndex(symbols, np.array([len(w) for w in words]), merges).merge()
    got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[0], [1], [3], [2], [2, 0], [2, 1], [2, 3], [2, 2]]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges([(2, 0, 3), (0, 0, 2)])


def test_memory_is_bounded(specification, library, monkeypatch):
    monkeypatch.setattr(bpe.WordBpe, "remembered", 5)
    model = bpe.WordBpe(specification)
    for text in samples(200, 4):
        assert np.frombuffer(model.encode([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(model.earlier) < 200


def test_digests(spark, odd, empty, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.digests(spark, odd).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == expected
    assert queries.digests(spark, empty).count() == 0


@pytest.mark.parametrize("count", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_round_trip(count, top):
    chance = np.random.default_rng(count)
    ids = chance.integers(0, top, count, dtype=np.uint32)
    outliers = np.where(chance.random(count) < 0.03, np.uint32(2**32 - 1), ids // np.uint32(max(1, top // 50)))
    for values in (ids, outliers.astype(np.uint32)):
        packed = tokenfile.pack(values)
        assert (tokenfile.unpack(packed) == values).all()
        for first, last in ((0, count // 2), (count // 3, count), (count // 2, count // 2 + 1)):
            assert (tokenfile.unpack(packed, first, last) == values[first:last]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype=np.uint32) % 16 + 1000
    plain = len(tokenfile.pack(ids))
    ids[7] = 40_000
    assert len(tokenfile.pack(ids)) == plain + 5


def written(spark, df, width):
    path = shared_folder(spark, "test-tokens")
    ids = tokenfile.token_ids(spark, vocabulary(), F.col("text"), 2, width)
    tokenfile.write_token_files(df.select("doc_id", ids.alias("ids")), path, width=width)
    return path, tokenfile.read_token_files(spark, path).collect()


@pytest.mark.parametrize("width", [2, 4])
def test_files(spark, odd, empty, library, width):
    path, got = written(spark, odd, width)
    expected, start = [], 0
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got.sort(key=lambda r: r["start"])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and ids[-1] == 2
        start += len(ids)
        expected.append((r["doc_id"], zlib.crc32(r["ids"])))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    own = [(r["doc_id"], zlib.crc32(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows]
    assert sorted(map(repr, own)) == sorted(map(repr, expected))
    assert written(spark, empty, width)[1] == []


def test_narrow_identifiers_are_refused(specification):
    with pytest.raises(ValueError):
        tokenfile.LibraryBpe(specification, 1)


def test_segments_close(spark):
    batch = [
        {"doc_id": k, "ids": np.arange(k % 7, dtype="<u4").tobytes(), "part": 3} for k in range(100)
    ]
    import pyarrow as pa

    out = list(tokenfile._segments(iter([pa.RecordBatch.from_pylist(batch)])))
    assert sum(b.num_rows for b in out) == 1 and out[0]["n_ids"][0].as_py() == sum(k % 7 for k in range(100))


def test_ranges_of_identifiers(spark):
    df = spark.createDataFrame([(k,) for k in (-5, 0, 1, 2, 7, 8, 100)] + [(None,)], "i long")
    got = {r["i"]: r["p"] for r in df.select("i", tokenfile.range_of(F.col("i"), [0, 2, 7]).alias("p")).collect()}
    assert got == {None: 0, -5: 0, 0: 0, 1: 1, 2: 1, 7: 2, 8: 3, 100: 3}
