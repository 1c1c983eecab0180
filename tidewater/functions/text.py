"""Text expressions that stay in the JVM."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as white space, and the same set as a
# pattern: a Unicode property is several times faster than a class that lists them.
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WHITESPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


def strip(col: Column) -> Column:
    """Unicode-aware strip; `trim` alone removes spaces only."""
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def words(col: Column) -> Column:
    """Split on runs of Unicode white space, no empty strings."""
    return F.array_remove(F.split(col, WHITESPACE_RUN), "")


def terms(col: Column) -> Column:
    """Lower-cased runs of letters and digits, the unit of full-text search."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


# The characters an id may not have, what stands for a run of them, and the id of a name without any other.
UNSAFE, SAFE, NAMELESS = r"[^a-zA-Z0-9_-]+", "-", "dataset"


def slug(col: Column) -> Column:
    """Id-safe form of a name; a name without any safe character becomes `dataset`."""
    cleaned = F.btrim(F.regexp_replace(F.lower(col), UNSAFE, SAFE), F.lit(SAFE))
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit(NAMELESS))


# Fixed value: the folder of a dataset without an id.
UNNAMED = "unnamed_dataset"


def safe_dir_name(col: Column) -> Column:
    """Folder name of a dataset id; a missing or empty id has a name of its own."""
    return F.when(F.length(col) > 0, F.replace(col, F.lit("/"), F.lit("--"))).otherwise(F.lit(UNNAMED))


def from_safe_dir_name(col: Column) -> Column:
    return F.replace(col, F.lit("--"), F.lit("/"))


def contains_any(lowered: Column, keywords: list[str]) -> Column:
    """True when any keyword occurs, also inside a word; `lowered` is already lower case."""
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | lowered.contains(keyword.lower())
    return hit


# So many keywords are compared one by one in the JVM; more go to an automaton.
COMPARED_KEYWORDS = 64


@lru_cache(maxsize=2)
def _automaton(sent: Broadcast):
    """All keywords of all rules in one automaton with failure links, each with its first rule."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for keyword, rule in sent.value:
        found.add_word(keyword, rule)
    found.make_automaton()
    return found


def first_rule(spark: SparkSession, lowered: Column, rules: list[list[str]]) -> Column:
    """Number of the first rule of which a keyword occurs in the text, also inside a word; null if there is none.

    A few keywords are compared one by one. More are sent to the tasks as one list, from which each builds an automaton
    that reads a text once, however many keywords there are. A null text has no rule, an empty keyword is in any other.
    """
    if sum(map(len, rules)) <= COMPARED_KEYWORDS:
        return F.coalesce(F.lit(None).cast("int"), *(F.when(contains_any(lowered, own), number) for number, own in enumerate(rules)))
    first: dict[str, int] = {}
    for number, own in enumerate(rules):
        for keyword in own:
            first.setdefault(keyword.lower(), number)
    anywhere = first.pop("", None)
    sent = spark.sparkContext.broadcast(sorted(first.items()))

    @F.arrow_udf("int")
    def search(texts: pa.Array) -> pa.Array:
        automaton = _automaton(sent)
        out = []
        for text in texts.to_pylist():
            best = anywhere if text is not None else None
            for _, rule in automaton.iter(text or ""):
                if best is None or rule < best:
                    best = rule
                    if best == 0:
                        break
            out.append(best)
        return pa.array(out, pa.int32())

    return search(lowered)
