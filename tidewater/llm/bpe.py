"""Byte-pair encoding by an index of pair occurrences, and decoding, with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewater.llm.common import bound_batches

#: Bytes of text that a task tokenises at a time, words it remembers, in two generations, and how long one may be.
SLICE_BYTES = 1 << 22
REMEMBERED_WORDS = 120_000
REMEMBERED_CHARS = 64
#: Stand for "no symbol": beyond a word's end, and merged into the symbol on the left.
END, GONE = (1 << 20) - 1, (1 << 20) - 2
#: Text that any Unicode version lower-cases and splits alike: printable ASCII, line ends, Latin-1 letters. The pattern
#: is the vocabulary's own over these characters, plus the strings of added tokens.
OTHER = re.compile("[^\n\t -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
OTHER_RE2 = "[^\\n\\t -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
LATIN_MARK = "'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
LATIN_WORD = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """The merges of a vocabulary as sorted arrays: a pair's key, rank and merged symbol."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.left, self.right, self.merged = left, right, merged
        lowest = np.full(int(max(left.max(), right.max(), merged.max())) + 1, len(pairs))
        for side in (left, right):
            np.minimum.at(lowest, side, np.arange(len(pairs)))
        if (lowest[merged] < np.arange(len(pairs))).any():
            raise ValueError("the merges must be in the order of training: a symbol is made before it is merged further")
        keys = left << 20 | right
        self.rank_order = np.argsort(keys)
        self.keys = keys[self.rank_order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        wanted = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_order[at], -1)


class PairIndex:
    """Symbols of many words at once, and for each pair (by its rank) the places where it stands.

    Ranks with places are active. The lowest active rank is merged at all its places, and the neighbours' places move to
    the lists of the pairs they now form. A merged symbol only forms pairs of higher rank (Merges sees to that), and
    words do not touch, so this is what merging each word on its own, lowest rank first, gives.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, merges: Merges):
        self.merges = merges
        self.lengths = lengths
        self.count = len(symbols)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self.symbols = np.append(symbols, END).astype(np.int64)
        self.after = np.arange(1, self.count + 2)
        self.before = np.arange(-1, self.count)
        self.after[ends[lengths > 0] - 1] = self.count
        self.before[starts[lengths > 0]] = self.count
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._note(np.arange(self.count))

    def _note(self, at: np.ndarray) -> None:
        """Add the pairs that start at these places to their lists."""
        ranks = self.merges.ranks(self.symbols[at], self.symbols[self.after[at]])
        known = ranks >= 0
        if not known.any():
            return
        at, ranks = at[known], ranks[known]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            rank = int(ranks[first])
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(at[first:last])

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols after all merges, word after word, and how many each word has."""
        symbols, before, after = self.symbols, self.before, self.after
        while self.active:
            rank = heapq.heappop(self.active)
            left, right, merged = (int(x[rank]) for x in (self.merges.left, self.merges.right, self.merges.merged))
            at = np.unique(np.concatenate(self.places.pop(rank)))
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # of places that overlap, every other one, from the left
                fresh = np.append(True, after[at[:-1]] != at[1:])
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = merged, GONE
            after[at] = after[gone]
            before[after[at]] = at
            behind = before[at]
            self._note(np.concatenate([behind[behind < self.count], at]))
        stays = symbols[: self.count] != GONE
        return symbols[: self.count][stays], np.diff(np.append(0, np.cumsum(stays))[np.append(0, np.cumsum(self.lengths))])


class WordBpe:
    """Encoder and decoder of one vocabulary file: the text of a tokenizers JSON file, a byte-level BPE over words.

    Text splits into words by the file's own normaliser and pre-tokeniser; Latin text, where their rules are plain, by
    the same pattern here, for a whole batch at a time: marks get spaces around them, and what stands between spaces is
    a word. Each different word of a batch is looked up once. Words that were met before are remembered, if they are
    short; others go to one index of pair occurrences.
    """

    remembered = REMEMBERED_WORDS
    kind = np.dtype("<i4")

    def __init__(self, specification: str):
        parsed = json.loads(specification)
        model = parsed["model"]
        odd = [k for k in ("unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "dropout") if model.get(k)]
        first, second = parsed["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or odd or parsed.get("decoder") or first["pattern"] != {"Regex": FILE_PATTERN} or second["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary over lower-case words, without a decoder, is needed")
        library = Tokenizer.from_str(specification)
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.letter_bytes = {letter: byte for byte, letter in enumerate(letters)}
        self.inner = np.array([vocabulary[letter] for letter in letters], dtype=np.int64)
        self.last = np.array([vocabulary[letter + suffix] for letter in letters], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        named = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.added_pattern = re.compile(f"({named})" if named else "(?!)")
        self.latin = re.compile(LATIN_WORD)
        self.names: list[str | None] = [None] * (1 + max([*vocabulary.values(), *self.added.values()]))
        for name, number in {**vocabulary, **self.added}.items():
            self.names[number] = name
        self.name_array = pa.array(self.names, pa.string())
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text in order, and the added tokens that it names."""
        if self.added_pattern.search(text):
            found: list[str] = []
            for part in self.added_pattern.split(text):
                found += [part] if part in self.added else self._plain_words(part)
            return found
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return self.latin.findall(text.lower())
        found: list[str] = []
        for piece in text.split(" "):  # white space is dropped, so no word and no composed character crosses a space
            if OTHER.search(piece):
                for word, _ in self.split(self.normalise(piece)):
                    found.append(bytes(map(self.letter_bytes.__getitem__, word)).decode())
            else:
                found += self.latin.findall(piece.lower())
        return found

    def learn(self, words: list[str]) -> None:
        """Merge these words in one index of pair occurrences and remember them."""
        spelled = [word.encode() for word in words]
        lengths = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        joined = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        symbols = self.inner[joined]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[joined[ends]]
        ids, counts = PairIndex(symbols, lengths, self.merges).merge()
        data = ids.astype("<i4").tobytes()
        cuts = (np.append(0, np.cumsum(counts)) * 4).tolist()
        self.recent.update(zip(words, (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Identifiers of each text, as little-endian integers of this encoder's kind; null is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, OTHER_RE2))
        for name in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, name)))
        plain = plain.to_numpy(zero_copy_only=False)
        found: list[bytes] = [b""] * len(texts)
        if plain.any():
            own = texts if plain.all() else texts.filter(pa.array(plain))
            spaced = pc.replace_substring_regex(pc.utf8_lower(own), pattern=LATIN_MARK, replacement=r" \0 ")
            lists = pc.ascii_split_whitespace(spaced)
            self._fill(found, np.flatnonzero(plain), lists.flatten(), lists.value_lengths().to_numpy())
        if not plain.all():
            split = [self.words(text) for text in texts.filter(pa.array(~plain)).to_pylist()]
            words = pa.array([word for own in split for word in own], pa.string())
            self._fill(found, np.flatnonzero(~plain), words, np.array([len(own) for own in split], dtype=np.int64))
        return found

    def _fill(self, found: list[bytes], rows: np.ndarray, words: pa.Array, counts: np.ndarray) -> None:
        """Set `found` at these rows, whose words follow each other in `words`, `counts` of them each."""
        coded = words.dictionary_encode()
        spelled = self.identifiers(coded.dictionary.to_pylist())
        size = self.kind.itemsize
        lengths = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)) // size
        flat = np.frombuffer(b"".join(spelled), dtype=self.kind)
        codes = coded.indices.to_numpy()
        here = lengths[codes]
        ends = np.append(0, np.cumsum(here))
        data = flat[np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], here) + np.arange(ends[-1])].tobytes()
        cuts = (ends[np.append(0, np.cumsum(counts))] * size).tolist()
        for row, a, b in zip(rows.tolist(), cuts[:-1], cuts[1:], strict=True):
            found[row] = data[a:b]

    def identifiers(self, words: list[str]) -> list[bytes]:
        """Identifiers of different words; an empty one has none."""
        if len(self.recent) > self.remembered:
            self.earlier, self.recent = self.recent, {}
        recent, earlier = self.recent, self.earlier
        recent[""] = b""
        unseen = [word for word in words if word not in recent]
        for word in unseen:
            if word in earlier:
                recent[word] = earlier[word]
            elif word in self.added:
                recent[word] = np.array([self.added[word]], dtype=self.kind).tobytes()
        if new := sorted(word for word in unseen if word not in recent):
            self.learn(new)
        found = [recent[word] for word in words]
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del recent[word]
        return found

    def decode(self, ids: list[int]) -> str:
        """Token names joined by spaces, as a vocabulary without a decoder does; unknown identifiers are left out."""
        names = self.names
        try:
            return " ".join([names[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([names[i] for i in ids if 0 <= i < len(names) and names[i] is not None])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte) if byte in printable else chr(next(spare)) for byte in range(256)]


@lru_cache(maxsize=1)
def model_of(specification: str) -> WordBpe:
    return WordBpe(specification)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts, about `limit` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield texts.slice(a, b - a)


def list_array(chunks: list[bytes], kind: np.dtype, arrow: pa.DataType) -> pa.Array:
    lengths = np.fromiter((len(c) for c in chunks), dtype=np.int64, count=len(chunks)) // kind.itemsize
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(chunks), dtype=kind), arrow)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Bpe:
    """Columns that encode and decode with the vocabulary at `path`, which only the driver needs to read.

    `encode` gives array<int> for each whole text: null and empty texts, and texts of white space alone, give an empty
    array. The names of added tokens in a text are those tokens, as the file says. `decode` gives a string, empty for an
    empty or null array. Long texts and repeated rows need no care; there is no cap on either.
    """

    def __init__(self, spark: SparkSession, path: str):
        bound_batches(spark)
        self.specification = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def encode(self, text: Column) -> Column:
        specification = self.specification

        @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
        def per_batch(texts: pa.Array) -> pa.Array:
            model = model_of(specification.value)
            chunks = [ids for some in slices(texts) for ids in model.encode(some)]
            return list_array(chunks, np.dtype("<i4"), pa.int32())

        return per_batch(F.coalesce(text, F.lit("")))

    def round_trip(self, text: Column) -> Column:
        """struct<ids, decoded>: what `encode` gives, and what `decode` makes of it, by one Python worker instead of two."""
        specification = self.specification

        @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]))
        def per_batch(texts: pa.Array) -> pa.Array:
            model = model_of(specification.value)
            chunks = [ids for some in slices(texts) for ids in model.encode(some)]
            ids = list_array(chunks, np.dtype("<i4"), pa.int32())
            names = pa.ListArray.from_arrays(ids.offsets, model.name_array.take(ids.values))
            return pa.StructArray.from_arrays([ids, pc.binary_join(names, " ")], names=["ids", "decoded"])

        return per_batch(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        specification = self.specification

        @F.arrow_udf(T.StringType())
        def per_batch(lists: pa.Array) -> pa.Array:
            model = model_of(specification.value)
            values = lists.values.to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            names = (model.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            return pa.array(names, pa.string(), size=len(lists))

        return per_batch(F.coalesce(ids, F.array().cast("array<int>")))
