"""The trie of shared conversation prefixes, from fingerprints that compose; rebuilt texts are never made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions.ordering import running_sum
from tidewater.llm.common import partitions
from tidewater.session import checkpointed

#: Primes below 2**31, so that a product of two residues fits a long, and a base for each; further bases are tried when
#: a verification fails.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = ((1103515245, 1664525, 69069), (22695477, 134775813, 1566083941), (48271, 69621, 630360016))
#: Depths in a slice of ordered work, so that a very long conversation is not one group.
SLICE = 4096
#: Identifiers in a piece of a node's list.
PIECE = 4096
HASHES = [f"p{k}" for k in range(len(PRIMES))]
DIGESTS = [f"d{k}" for k in range(len(PRIMES))]


@dataclass(frozen=True)
class Rebuild:
    """A conversation takes the head of the one with the largest multiple of `family` up to its own identifier: as many
    turns as the crc32 of its own identifier leaves modulo `heads`.
    """

    family: int = 5
    heads: int = 9

    def base(self, conversation: Column) -> Column:
        return conversation - F.pmod(conversation, F.lit(self.family))

    def head(self, conversation: Column) -> Column:
        return (F.crc32(conversation.cast("string").cast("binary")) % self.heads).cast("int")


def power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent modulo a prime, by squaring over the exponent's binary digits."""
    digits = F.split(F.bin(exponent), "")
    return F.aggregate(
        digits, F.lit(1).cast("long"), lambda x, digit: x * x % prime * F.when(digit == "1", F.lit(base)).otherwise(F.lit(1)) % prime
    )


def digests(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add `d0`, `d1`, `d2`: 180 bits of the sha256 of role and text, null as empty, the role's length before it."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)), 256)
    hashed = turns.withColumn("_sha", whole)
    piece = lambda k: F.conv(F.substr("_sha", F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("long")
    return hashed.withColumns({name: piece(k) for k, name in enumerate(DIGESTS)}).drop("_sha")


def positions(turns: DataFrame, identifier: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns as (part, conv, pos_here, bytes, digests) in ranges of (conversation, turn): a range is one task's sorted rows.

    A conversation with a third of all turns covers many ranges. Texts stay behind; a digest and a length go on.
    """
    # Names of the input are left behind first, as they may clash with those added here.
    named = turns.select(F.col(identifier).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    narrow = digests(named.where("conv IS NOT NULL")).select(
        "conv", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), *DIGESTS
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *(F.col(d) for d in DIGESTS)]
    ranged = narrow.repartitionByRange(partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "conv").orderBy(*order[1:])
    return checkpointed(ranged.withColumn("here", F.row_number().over(here).cast("long") - 1).drop("turn"))


def prefixed(ordered: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Turns (conv, pos, bytes, digests) with `p0`, `p1`, `p2`, the fingerprint of all turns up to this one, and the
    terms `t0`, `t1`, `t2` by which it grew.

    A fingerprint is the sum of digest times base ** position. Two of them compose: that of u followed by v is
    fp(u) + base ** len(u) * fp(v). So each range of a conversation is summed alone, one row a range carries length and
    sum, these are composed in order, and the rows of a range are shifted by what comes before it.
    """
    here = Window.partitionBy("part", "conv").orderBy("here").rowsBetween(Window.unboundedPreceding, 0)
    terms = {f"t{k}": F.col(d) % p * power(b, F.col("here"), p) % p for k, (d, p, b) in enumerate(zip(DIGESTS, PRIMES, bases, strict=True))}
    local = ordered.withColumns(terms).withColumns({h: F.sum(f"t{k}").over(here) % PRIMES[k] for k, h in enumerate(HASHES)})
    parts = ordered.withColumns(terms).groupBy("part", "conv").agg(
        F.count("*").alias("length"), *((F.sum(f"t{k}") % p).alias(f"s{k}") for k, p in enumerate(PRIMES))
    )
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offset = parts.withColumn("offset", F.coalesce(F.sum("length").over(before), zero))
    shifted = offset.withColumns({f"shift{k}": power(b, F.col("offset"), p) for k, (p, b) in enumerate(zip(PRIMES, bases, strict=True))})
    composed = shifted.select(
        "part",
        "conv",
        "offset",
        *(f"shift{k}" for k in range(len(PRIMES))),
        *(
            F.coalesce(F.sum(F.col(f"s{k}") * F.col(f"shift{k}") % p).over(before) % p, zero).alias(f"sum{k}")
            for k, p in enumerate(PRIMES)
        ),
    )
    moved = lambda name, k: F.col(name) * F.col(f"shift{k}") % PRIMES[k]
    return local.join(composed, ["part", "conv"]).select(
        "conv",
        (F.col("offset") + F.col("here")).alias("pos"),
        "bytes",
        *DIGESTS,
        *(((F.col(f"sum{k}") + moved(h, k)) % PRIMES[k]).alias(h) for k, h in enumerate(HASHES)),
        *(moved(f"t{k}", k).alias(f"t{k}") for k in range(len(PRIMES))),
    )


def occurrences(turns: DataFrame, rule: Rebuild, bases: tuple[int, ...]) -> DataFrame:
    """A row for each rebuilt conversation and depth: (conv, node, parent, ends, bytes, digests), root included.

    `node` is (depth, fingerprint of the prefix). It is composed from the base's head and the conversation's own turns
    after its own head, by sums and a shift; the turns stay where they are and are referred to by their digests.
    """
    zero = F.lit(0).cast("long")
    entry = F.struct("pos", *HASHES, *(f"t{k}" for k in range(len(PRIMES))), "bytes", *DIGESTS)
    heads = turns.groupBy("conv").agg(
        F.count("*").alias("length"), F.sort_array(F.collect_list(F.when(F.col("pos") < rule.heads - 1, entry))).alias("head")
    )
    bases_of = heads.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    rebuilt = heads.withColumn("base", rule.base(F.col("conv"))).withColumn("cut", rule.head(F.col("conv"))).join(bases_of, "base", "left")
    taken = F.least("cut", F.coalesce(F.size("base_head"), F.lit(0)))
    whole = rebuilt.withColumn("taken", taken).withColumn("size", F.col("taken") + F.greatest(F.col("length") - F.col("cut"), zero))
    at = lambda head, count, name: F.coalesce(F.try_element_at(F.col(head), F.col(count))[name], zero)
    ready = whole.withColumn("own_cut", F.least(F.col("cut").cast("long"), F.col("length")).cast("int"))
    known = ready.select(
        "conv",
        "cut",
        "taken",
        "size",
        "base_head",
        *(F.when(F.col("taken") > 0, at("base_head", "taken", h)).otherwise(zero).alias(f"base{k}") for k, h in enumerate(HASHES)),
        *(F.when(F.col("own_cut") > 0, at("head", "own_cut", h)).otherwise(zero).alias(f"own{k}") for k, h in enumerate(HASHES)),
    )
    known = checkpointed(known)
    node = lambda depth, hashes: F.struct(depth.cast("long").alias("depth"), *(x.alias(h) for x, h in zip(hashes, HASHES, strict=True)))
    no_digest = [zero.alias(d) for d in DIGESTS]
    nothing = node(zero, [zero] * len(HASHES))
    root = known.select("conv", nothing.alias("node"), F.lit(None).cast(_NODE).alias("parent"), (F.col("size") == 0).alias("ends"), zero.alias("bytes"), *no_digest)
    opened = known.select("conv", "size", F.explode(F.slice("base_head", 1, F.col("taken"))).alias("e"))
    reduced = lambda x, k: F.pmod(x, F.lit(PRIMES[k]))
    depth = F.col("e.pos") + 1
    head = opened.select(
        "conv",
        node(depth, [F.col(f"e.{h}") for h in HASHES]).alias("node"),
        node(depth - 1, [reduced(F.col(f"e.{h}") - F.col(f"e.t{k}"), k) for k, h in enumerate(HASHES)]).alias("parent"),
        (depth == F.col("size")).alias("ends"),
        "e.bytes",
        *(f"e.{d}" for d in DIGESTS),
    )
    # A head shorter than the cut, or none, moves the own turns left by up to heads - 1 places: a table of inverse powers.
    factors = []
    for prime, base in zip(PRIMES, bases, strict=True):
        inverse = pow(base, -1, prime)
        factors.append(F.array(*(F.lit(pow(inverse, k, prime)) for k in range(rule.heads))))
    moved = F.col("cut") - F.col("taken") + 1
    tail = turns.join(known.drop("base_head"), "conv").where("pos >= cut")
    depth = F.col("taken") + F.col("pos") - F.col("cut") + 1
    through = lambda value, k: reduced(F.col(f"base{k}") + reduced(value - F.col(f"own{k}"), k) * F.element_at(factors[k], moved), k)
    own = tail.select(
        "conv",
        node(depth, [through(F.col(h), k) for k, h in enumerate(HASHES)]).alias("node"),
        node(depth - 1, [through(F.col(h) - F.col(f"t{k}"), k) for k, h in enumerate(HASHES)]).alias("parent"),
        (depth == F.col("size")).alias("ends"),
        "bytes",
        *DIGESTS,
    )
    return root.unionByName(head).unionByName(own)


_NODE = "struct<depth:bigint," + ",".join(f"{h}:bigint" for h in HASHES) + ">"


def nodes_of(found: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes (node, parent, conv, n_convs, bytes), and whether all members of each agree.

    Members agree if their last turns have equal digests and their parents are one node; by induction from the root, the
    whole prefixes are then equal turn by turn.
    """
    same = F.lit(True)
    checked = [*DIGESTS, *(f"parent.{h}" for h in HASHES)]
    extremes = []
    for k, column in enumerate(checked):
        extremes += [F.min(column).alias(f"_low{k}"), F.max(column).alias(f"_high{k}")]
        same = same & F.col(f"_low{k}").eqNullSafe(F.col(f"_high{k}"))
    first = len(DIGESTS)
    parent = F.struct((F.col("node.depth") - 1).alias("depth"), *(F.col(f"_low{first + k}").alias(h) for k, h in enumerate(HASHES)))
    grouped = found.groupBy("node").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), *extremes)
    nodes = checkpointed(
        grouped.select("node", F.when(F.col("node.depth") > 0, parent).alias("parent"), "conv", "n_convs", "bytes", same.alias("same"))
    )
    return nodes.drop("same"), nodes.where("not same").isEmpty()


def verify_turns(turns: DataFrame, role: str, text: str) -> None:
    """Compare in full the turns that share a digest: the smallest and the largest of each must be one text.

    Turns whose digest stands alone are not read again. Extremes merge before the shuffle, so a turn that a third of all
    conversations open with costs a row a task.
    """
    named = turns.select(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    hashed = digests(named)
    repeated = hashed.groupBy(*DIGESTS).count().where("count > 1").drop("count")
    both = F.struct("role", "text")
    pairs = hashed.join(repeated, DIGESTS, "left_semi").groupBy(*DIGESTS).agg(F.min(both).alias("low"), F.max(both).alias("high"))
    if not pairs.where("low <> high").isEmpty():
        raise ValueError("two different turns share a digest")


def trie(
    turns: DataFrame, rule: Rebuild = Rebuild(), identifier: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each node: (conv, depth, parent_conv, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    The smallest member of a node owns it. The nodes a conversation owns are the lower end of its path, so what a node's
    subtree holds is: what its owner owns from here down, and all that its other members own. That makes the sums over
    subtrees two sums over rows of (conversation, depth), whatever the depth of the trie.

    Work is linear in the rebuilt turns. Groups of copies meet in counts that are added before the shuffle; a long
    conversation is cut into ranges and slices. Only the root's owner reaches the driver. Fingerprints that collide are
    noticed (`nodes_of`) and other bases are tried; digests are verified against the texts.

    Null role and null text are empty. Rows without an identifier belong to no conversation and are left out. Turns
    without a number come first; turns that share a number stand in the order of their digests, so repeated rows repeat.
    Long texts are read twice, for their digest and to verify it. An empty table gives no rows, not even a root.
    """
    ordered = positions(turns, identifier, turn, role, text)
    for bases in BASES:
        found = checkpointed(occurrences(checkpointed(prefixed(ordered, bases)), rule, bases))
        nodes, agree = nodes_of(found)
        if agree:
            break
    else:
        raise ValueError("fingerprints collide under all bases")
    verify_turns(turns.where(F.col(identifier).isNotNull()), role, text)
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").select(
        "node", "parent", "conv", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    counted = checkpointed(counted)
    owned = counted.groupBy("conv").agg(
        F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.min("node.depth").alias("top")
    )
    others = (
        found.join(owned, "conv")
        .groupBy("node")
        .agg(
            F.sum("leaves").alias("n_leaves"),
            F.sum(F.when(F.col("node.depth") < F.col("top"), F.col("saved")).otherwise(0)).alias("saved_by_others"),
        )
    )
    upward = counted.withColumn("up", -F.col("node.depth"))
    own = running_sum(upward, ["conv"], ["up"], F.floor(F.col("up") / SLICE), F.col("saved"), "saved_by_owner")
    owner = counted.where("node.depth = 0").select("conv").first()
    tops = counted.join(owned.select("conv", "top"), "conv").where("node.depth = top AND node.depth > 1").select("node", "parent")
    above = tops.join(counted.select(F.col("node").alias("parent"), F.col("conv").alias("above")), "parent").select("node", "above")
    parent = (
        F.when(F.col("node.depth") == 0, F.lit(None))
        .when(F.col("node.depth") == 1, F.lit(owner["conv"] if owner else None))
        .otherwise(F.coalesce("above", "conv"))
    )
    return (
        own.join(others, "node")
        .join(above, "node", "left")
        .join(ends(found.where("ends").select("node", "conv")), "node", "left")
        .select(
            "conv",
            F.col("node.depth").alias("depth"),
            parent.cast("long").alias("parent_conv"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("saved_by_owner") + F.col("saved_by_others")).alias("saved_tokens"),
            F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def ends(members: DataFrame) -> DataFrame:
    """(node, sha256) of each node's members (node, conv): their identifiers, ascending, joined by commas.

    Ranges of (node, identifier) are sorted and joined to pieces in parallel. The hash itself must run over the pieces in
    order, so a node's pieces meet in one task, which reads them one after the other and holds none.
    """
    spark = members.sparkSession
    key = F.to_json("node")
    flat = members.select(key.alias("node"), "conv")
    sorted_rows = flat.repartitionByRange(partitions(spark), "node", "conv").sortWithinPartitions("node", "conv")
    pieces = sorted_rows.mapInArrow(_pieces, "node string, first long, piece string")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node string, sha256 string")
    return hashed.select(F.from_json("node", _NODE).alias("node"), "sha256")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, held = None, []
    done: list[tuple] = []
    for batch in batches:
        for name, conv in zip(batch["node"].to_pylist(), batch["conv"].to_pylist(), strict=True):
            if held and (name != node or len(held) == PIECE):
                done.append((node, held[0], ",".join(map(str, held))))
                held = []
            node = name
            held.append(conv)
        if done:
            yield _batch(done, ("node", "first", "piece"))
            done = []
    if held:
        yield _batch([(node, held[0], ",".join(map(str, held)))], ("node", "first", "piece"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        done = []
        for name, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist(), strict=True):
            if name == node:
                state.update(b",")
            else:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            state.update(piece.encode())
        if done:
            yield _batch(done, ("node", "sha256"))
    if state:
        yield _batch([(node, state.hexdigest())], ("node", "sha256"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"node": pa.string(), "first": pa.int64(), "piece": pa.string(), "sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], list(names))
