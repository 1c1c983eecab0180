"""SimHash near-duplicates: every fingerprint emits a ball of half the radius, and fingerprints that share a point link."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewater.llm.common import components, partitions
from tidewater.session import checkpointed

#: Shingle hashes whose bits are summed at a time.
SUM_BLOCK = 1 << 15


def fingerprint(text: bytes, width: int) -> int:
    """Sign bits of the summed XXH64 hashes of the `width`-word shingles of A-Z lower-cased words, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[start : end - 1], 42) for start, end in zip([0, *ends], ends[width - 1 :], strict=False)]
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), SUM_BLOCK):
        counts += np.unpackbits(values[at : at + SUM_BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, width: int) -> Column:
    """Column of fingerprints; null or wordless text has fingerprint zero."""

    @F.arrow_udf(T.LongType())
    def per_batch(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in texts.cast(pa.binary())], pa.int64())

    return per_batch(F.coalesce(text, F.lit("")))


def ball(radius: int) -> list[int]:
    """Signed masks of all sets of at most `radius` bits out of 64."""
    masks = [sum(1 << bit for bit in bits) for size in range(radius + 1) for bits in combinations(range(64), size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) that connect all of `distinct` (fingerprint) within `radius` bits of each other.

    Two fingerprints within the radius share a point that lies within half of it from the one and, for an odd radius,
    the larger half from the other. All that reach a point from the near side are within the radius of each other and of
    those on the far side, so linking each with the smallest near one loses no connection: a point with n fingerprints
    gives n - 1 pairs, and n is at most the size of a ball. Colliding pairs are verified and made distinct.
    """
    reach = F.array(*(F.lit(mask) for mask in ball((radius + 1) // 2)))
    # By number: adaptive execution would put the few narrow rows into a task or two, before each becomes a ball.
    spread = distinct.repartition(partitions(distinct.sparkSession), "fingerprint")
    points = spread.select(
        "fingerprint", F.explode(F.transform(reach, lambda mask: F.col("fingerprint").bitwiseXOR(mask))).alias("point")
    )
    near = F.bit_count(F.col("point").bitwiseXOR(F.col("fingerprint"))) <= radius // 2
    first = F.min(F.when(near, F.col("fingerprint"))).over(Window.partitionBy("point"))
    paired = points.select("fingerprint", first.alias("first"))
    return (
        paired.where("first <> fingerprint")
        .where(F.bit_count(F.col("first").bitwiseXOR(F.col("fingerprint"))) <= radius)
        .select(F.greatest("first", "fingerprint").alias("a"), F.least("first", "fingerprint").alias("b"))
        .distinct()
    )


def near_duplicates(
    df: DataFrame, text: str = "text", identifier: str = "doc_id", width: int = 3, radius: int = 2
) -> DataFrame:
    """One row per input row: (identifier, fingerprint long, component_id).

    Rows with equal fingerprints collapse before anything is emitted, so a group of copies costs one ball however large
    it is. Links between fingerprints, never between rows, go to `components`; the smallest identifier of each component
    comes back by joins on the fingerprint. Nothing but counts reaches the driver.

    Null text counts as empty; wordless texts have fingerprint zero and link like any other. Texts of fewer words than
    `width` are one shingle. Rows with a null identifier take part but name no component: a component of such rows alone
    has a null component_id. Repeated rows repeat in the result. A very long text is summed block by block. Ties do not
    arise: a component is named by its smallest identifier, whatever the order. An empty table gives no rows. Other
    columns are not read.
    """
    rows = checkpointed(df.select(F.col(identifier).alias("identifier"), fingerprints(F.col(text), width).alias("fingerprint")))
    smallest = rows.groupBy("fingerprint").agg(F.min("identifier").alias("smallest"))
    roots = components(links(smallest.select("fingerprint"), radius))
    rooted = smallest.join(roots, smallest["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    named = rooted.where("linked").groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = rooted.join(named, "root", "left").select(
        "fingerprint", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("smallest")).alias("component_id")
    )
    return rows.join(classes, "fingerprint").select(F.col("identifier").alias(identifier), "fingerprint", "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def drop_near_duplicates(df: DataFrame, text: str = "text", identifier: str = "doc_id", **options) -> DataFrame:
    """The rows of `df` that carry the smallest identifier of their component, with the columns of the input.

    Rows with a null identifier stay, as no other row can stand for them. Rows that share an identifier share their
    fate, and stay if one of them is to stay.
    """
    found = near_duplicates(df, text, identifier, **options)
    fate = found.groupBy(identifier).agg(F.bool_or(F.col(identifier) == F.col("component_id")).alias("stays"))
    dropped = fate.where("not stays").select(F.col(identifier).alias("_dropped"))
    return df.join(dropped, df[identifier] == dropped["_dropped"], "left_anti")
