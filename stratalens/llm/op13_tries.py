"""Operator 13, the prefix trie of conversations, families first.

A family is a conversation and its branches: conversations that repeat its
first turns.  Families are cogrouped with what their branches need of the base
conversation, rebuilt, and each becomes a small trie; only the nodes of these
tries are shuffled, to meet equal nodes of other families.

Rows lie in ranges of (base, conversation, turn), so a long conversation, or a
large family, spans ranges and no task holds more than one of them.  A family's
rows in one range are its *part*.  The name of a node is the exclusive-or of a
hash of each turn and its depth (128 bits), so what a part needs to know of the
ranges before it is one number a conversation.

Most nodes lie in one part; their subtree does, too, and is summed there.  For
the others each node counts in one part that holds it, and sums of parts add
up.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, lean, materialize, mix64, shuffle_partitions, table, text_bytes
from .native import spaced_words

#: Bytes of listed ids in one row, about, on their way to a digest.
LIST_BYTES = 1 << 20

_NODE = "a long, b long, pa long, pb long, depth long, words long, conv long, parent_conv long, n long, children long, leaves long, saved long, enter long, tail long, open boolean, ends string"
_FAMILY = f"base long, part int, {_NODE}"
_SUMS = "a long, b long, leaves long, saved long, conv long, part int"


def shared_turns(conv: int, most: int = 4) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % most


def steps(h1: np.ndarray, h2: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each turn at its depth adds to the name of a path, in two halves."""
    salted = ((h1, 0x9E3779B97F4A7C15), (h2, 0xC2B2AE3D27D4EB4F))
    one, two = (mix64(h.view(np.uint64) + depth.astype(np.uint64) * np.uint64(salt)).view(np.int64) for h, salt in salted)
    return one, two


def names(h1: np.ndarray, h2: np.ndarray, depth: np.ndarray, start: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """The names of the nodes of a path, that of its start first."""
    one, two = (np.bitwise_xor.accumulate(np.r_[np.int64(s), x]) for s, x in zip(start, steps(h1, h2, depth)))
    return one, two


def ordered_turns(turns: DataFrame, family: int) -> DataFrame:
    """base, conv, part, seq, h1, h2, words: each turn as hashes, in ranges of the order of turns; equal rows are kept apart by their place in the input."""
    spark = turns.sparkSession
    text = turns.select(F.col("conv_id").alias("conv"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("tie")).where("conv is not null")
    order = ["base", F.col("base") != F.col("conv"), "conv", F.asc_nulls_first("turn"), "role", "text", "tie"]
    wanted = math.ceil(text_bytes(turns) / BUCKET_BYTES)
    ranged = text.repartitionByRange(*([wanted] if wanted > shuffle_partitions(spark) else []), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq")
    return materialize(ranged.select("base", "conv", F.spark_partition_id().alias("part"), place, F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("other"), "text", "role").alias("h2"), F.size(spaced_words(F.col("text"))).cast("long").alias("words")))


def conversation_parts(turns: DataFrame, most: int) -> DataFrame:
    """What a part must know of each of its conversations: where it begins, the base's first turns, and the exclusive-or of what lies before.

    One row a conversation and range.  Conversations that span ranges are no
    more than twice as many as ranges, so they may be broadcast.
    """
    along = Window.partitionBy("conv").orderBy("part")
    whole = Window.partitionBy("conv")
    parts = turns.groupBy("base", "conv", "part").agg(F.count("*").alias("n"), F.min("seq").alias("s0"))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    parts = materialize(parts.select("base", "conv", "part", "s0", before, F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("ranges"), (F.row_number().over(along) == F.count("*").over(whole)).alias("last")))
    of_base = turns.where("conv = base").drop("base").join(parts.where("conv = base").select("base", "conv", "part", "s0", "before"), ["conv", "part"])
    of_base = of_base.withColumn("pos", F.col("seq") - F.col("s0") + F.col("before")).where(F.col("pos") < most - 1)
    heads = of_base.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("heads"))  # most - 1 of them
    parts = parts.join(heads, "base", "left").withColumn("heads", F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)))
    spanning = F.broadcast(parts.where("ranges > 1").drop("base"))
    long_turns = turns.join(spanning, ["conv", "part"]).select("base", "conv", "part", "h1", "h2", (F.col("seq") - F.col("s0") + F.col("before")).alias("pos"), F.size("heads").cast("long").alias("heads"))

    def mixed(batches):
        for batch in batches:
            base, conv, part, h1, h2, pos, heads = (c.to_numpy() for c in batch.columns)
            each, place = np.unique(conv, return_inverse=True)
            taken = np.where(conv == base, 0, np.array([shared_turns(c, most) for c in each.tolist()], np.int64)[place])
            keep = np.flatnonzero(pos >= taken)
            depth = (pos - taken + np.minimum(taken, heads) + 1)[keep]
            one, two = steps(h1[keep], h2[keep], depth)
            yield pa.record_batch([pa.array(x) for x in (conv[keep], part[keep], one, two)], names=["conv", "part", "a", "b"])

    held = long_turns.mapInArrow(lean(mixed), "conv long, part int, a long, b long").groupBy("conv", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    held = parts.where("ranges > 1").select("conv", "part").join(held, ["conv", "part"], "left")
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("conv", "part", *[F.coalesce(F.bit_xor(x).over(upto), F.lit(0)).alias(f"x{x}") for x in "ab"])
    return parts.join(F.broadcast(carried), ["conv", "part"], "left").na.fill(0, ["xa", "xb"])


def family_trie(rows: pa.Table, facts: pa.Table, most: int) -> Iterator[tuple]:
    """The nodes of a family's part, with what lies below each of them here."""
    rows = rows.sort_by("seq")
    conv, seq, h1, h2, words = (rows.column(c).to_numpy() for c in ("conv", "seq", "h1", "h2", "words"))
    start = dict(zip(*[x.tolist() for x in np.unique(conv, return_index=True)])) if conv.size else {}
    size = dict(zip(*[x.tolist() for x in np.unique(conv, return_counts=True)])) if conv.size else {}
    nodes: dict[tuple[int, int], list] = {}

    def visit(name, parent, depth, n_words, c, enter, tail, spans):
        held = nodes.get(name)
        if held is None:
            nodes[name] = [parent, depth, n_words, c, 1, enter, tail, spans, []]
        else:
            held[3] = min(held[3], c)
            held[4] += 1
            held[5], held[6], held[7] = held[5] if enter is None else enter, held[6] if tail is None else tail, held[7] or spans

    for f in facts.sort_by("conv").to_pylist():
        c, before, i, k = f["conv"], f["before"], start[f["conv"]], size[f["conv"]]
        heads, h = f["heads"], shared_turns(c, most)
        if c == f["base"]:
            heads, h = [], 0
        heads = heads[:h]
        spans, tail = f["ranges"] > 1, c if not f["last"] else None
        pos = np.arange(before, before + k)
        keep = pos >= h
        own = [x[i : i + k][keep] for x in (h1, h2, words)]
        depth = pos[keep] - h + len(heads) + 1
        first = [np.array([x[y] for x in heads], np.int64) for y in ("h1", "h2", "words")]
        top = np.arange(1, len(heads) + 1)
        if before == 0:
            visit((0, 0), None, 0, 0, c, None, tail, spans)
            path = [np.concatenate(x) for x in zip(first, own)]
            depth = np.concatenate([top, depth])
            a, b = names(path[0], path[1], depth)
        else:
            path = own
            ha, hb = names(first[0], first[1], top)
            a, b = names(path[0], path[1], depth, (int(ha[-1]) ^ f["xa"], int(hb[-1]) ^ f["xb"]))
        named = list(zip(a.tolist(), b.tolist()))
        for at, (d, w) in enumerate(zip(depth.tolist(), path[2].tolist())):
            visit(named[at + 1], named[at], d, w, c, c if before and at == 0 else None, tail, spans)
        if (f["last"] if f["total"] > h else before == 0):
            nodes[named[-1]][8].append(c)

    below = {name: [0, 0, (x[4] - 1) * x[2]] for name, x in nodes.items()}  # children, leaves, saved
    for name, x in sorted(nodes.items(), key=lambda y: -y[1][1]):
        mine = below[name]
        mine[1] = mine[1] or 1
        if x[0] in below:
            up = below[x[0]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + mine[1], up[2] + mine[2]
    for name, (parent, d, w, c, n, enter, tail, spans, ends) in nodes.items():
        over = nodes[parent][3] if parent in nodes else None
        yield (*name, *(parent or (None, None)), d, w, c, over, n, *below[name], enter, tail, spans, ",".join(map(str, sorted(ends))))


def family_nodes(turns: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    fields = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]]) for x in _FAMILY.split(", ")]

    def build(rows: pa.Table, facts: pa.Table) -> pa.Table:
        base, part = facts.column("base")[0].as_py(), facts.column("part")[0].as_py()
        made = list(zip(*family_trie(rows, facts, most))) or [()] * (len(fields) - 2)  # a part of first turns that aren't kept has no nodes
        return pa.table([pa.array([base] * len(made[0]), pa.int64()), pa.array([part] * len(made[0]), pa.int32()), *[pa.array(x, t) for x, (_, t) in zip(made, fields[2:])]], schema=pa.schema(fields))

    return turns.groupBy("base", "part").cogroup(parts.groupBy("base", "part")).applyInArrow(build, _FAMILY)


def sums_of_part(rows: pa.Table) -> pa.Table:
    """What nodes of several parts have below them, as far as it counts in this one; with what goes to earlier ranges."""
    a, b, up_a, up_b, depth, leaves, saved, enter, part = (rows.column(c).to_pylist() for c in ("a", "b", "pa", "pb", "depth", "own_leaves", "own_saved", "enter", "part"))
    place = {name: i for i, name in enumerate(zip(a, b))}
    out: list[tuple] = []
    for i in sorted(range(len(a)), key=depth.__getitem__, reverse=True):
        up = place.get((up_a[i], up_b[i]))
        if up is not None:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
        elif enter[i] is not None:
            out.append((None, None, leaves[i], saved[i], enter[i], part[i]))
        out.append((a[i], b[i], leaves[i], saved[i], None, None))
    kinds = [pa.int64()] * 5 + [pa.int32()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _SUMS.split(", ")])


def _listed(batches):
    """Ids of one node that follow each other, as one row."""
    name, first, ids, size = None, None, [], 0
    made: list[tuple] = []
    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            if name is not None and ((a, b) != name or size >= LIST_BYTES):
                made.append((*name, first, ",".join(ids)))
                ids, size, name = [], 0, None
            if name is None:
                name, first = (a, b), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if made:
            yield pa.record_batch([pa.array(x) for x in zip(*made)], names=["a", "b", "first", "ids"])
            made = []
    if name is not None:
        yield pa.record_batch([pa.array([x]) for x in (*name, first, ",".join(ids))], names=["a", "b", "first", "ids"])


def _digests(batches):
    """The digest of each node's rows, in order; a digest is taken as rows pass."""
    name, digest = None, None
    for batch in batches:
        made = []
        for a, b, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b) != name:
                if name is not None:
                    made.append((*name, digest.hexdigest()))
                name, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if made:
            yield pa.record_batch([pa.array(x) for x in zip(*made)], names=["a", "b", "ends"])
    if name is not None:
        yield pa.record_batch([pa.array([x]) for x in (*name, digest.hexdigest())], names=["a", "b", "ends"])


def conversation_trie(turns: DataFrame, *, family: int = 20, most: int = 4) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and node and parent, their names.
    Conversation c begins with the first crc32(c) % ``most`` turns of
    conversation c - c % ``family``.  Turns stand in the order of turn (null
    first), then role, then text; equal rows are turns of their own.  A null
    role or text is empty.  Rows without a conversation's id belong to none.
    A conversation whose base is absent begins with its own turns that are
    left, and may have none: it is a member of the root only.  An empty table
    gives no rows; other columns are ignored.
    """
    turns = ordered_turns(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), family)
    parts = materialize(conversation_parts(turns, most))
    nodes = materialize(family_nodes(turns, parts, most))

    # equal nodes of all parts; a node of one part has its whole subtree there
    one = ["depth", "words", "pa", "pb", "children", "leaves", "saved", "ends", "parent_conv"]
    owner = F.min(F.struct("conv", "part")).alias("owner")
    merged = nodes.groupBy("a", "b").agg(owner, F.sum("n").alias("n"), ((F.count("*") > 1) | F.max("open")).alias("shared"), *[F.max(c).alias(c) for c in one])
    merged = materialize(merged)
    above = merged.where("shared").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner.conv").alias("over"))
    merged = materialize(merged.join(above, ["pa", "pb"], "left"))
    below = merged.where("over is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("all_children"), *[F.sum(F.when(~F.col("shared"), F.col(c)).otherwise(0)).alias(f"more_{c}") for c in ("leaves", "saved")])
    facts = merged.where("shared").select("a", "b", "owner", "n", "words").join(below, ["a", "b"], "left").na.fill(0, ["all_children", "more_leaves", "more_saved"])
    facts = materialize(facts.select("a", "b", "owner", "all_children", (F.when(F.col("all_children") == 0, 1).otherwise(0) + F.col("more_leaves")).alias("all_leaves"), ((F.col("n") - 1) * F.col("words") + F.col("more_saved")).alias("all_saved")))
    spread = nodes.select("base", "part", "a", "b", "pa", "pb", "depth", "enter", "tail", "ends").join(facts.drop("all_children"), ["a", "b"])
    counts_here = (F.col("owner.part") == F.col("part")) & (F.col("owner.conv") - F.col("owner.conv") % family == F.col("base"))
    spread = materialize(spread.select("base", "part", "a", "b", "pa", "pb", "depth", "enter", "tail", "ends", *[F.when(counts_here, F.col(f"all_{c}")).otherwise(0).cast("long").alias(f"own_{c}") for c in ("leaves", "saved")]))
    sums = materialize(spread.groupBy("base", "part").applyInArrow(sums_of_part, _SUMS))

    # a conversation over several ranges: what later ranges hold counts for its nodes in the earlier ones
    later = Window.partitionBy("conv").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    carried = parts.where("ranges > 1").select("conv", "part").join(sums.where("a is null").select("conv", "part", "leaves", "saved"), ["conv", "part"], "left")
    carried = carried.select(F.col("conv").alias("tail"), "part", *[F.sum(c).over(later).alias(c) for c in ("leaves", "saved")]).where("leaves is not null")
    carried = spread.where("tail is not null").select("tail", "part", "a", "b").join(F.broadcast(carried), ["tail", "part"])  # no more rows than ranges

    ends = spread.where("ends <> ''").select("a", "b", F.explode(F.split("ends", ",").cast("array<bigint>")).alias("c"))
    lists = ends.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(lean(_listed), "a long, b long, first long, ids string")
    digests = lists.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(lean(_digests), "a long, b long, ends string")
    nothing = F.lit(0).cast("long")
    found = sums.where("a is not null").select("a", "b", "leaves", "saved", nothing.alias("children"), F.lit(None).cast("string").alias("digest"))
    found = found.unionByName(carried.select("a", "b", "leaves", "saved", nothing.alias("children"), F.lit(None).cast("string").alias("digest")))
    found = found.unionByName(facts.select("a", "b", nothing.alias("leaves"), nothing.alias("saved"), F.col("all_children").alias("children"), F.lit(None).cast("string").alias("digest")))
    found = found.unionByName(digests.select("a", "b", nothing.alias("leaves"), nothing.alias("saved"), nothing.alias("children"), F.col("ends").alias("digest")))
    found = found.groupBy("a", "b").agg(*[F.sum(c).alias(f"all_{c}") for c in ("children", "leaves", "saved")], F.max("digest").alias("digest"))
    both = merged.join(found, ["a", "b"], "left")
    whole = lambda c: F.when(F.col("shared"), F.col(f"all_{c}")).otherwise(F.col(c))
    name = lambda a, b: F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)])
    digest = F.when(F.col("shared"), F.coalesce("digest", F.sha2(F.lit(""), 256))).otherwise(F.sha2("ends", 256))
    return both.select(
        F.col("owner.conv").alias("conv_id"), "depth", F.coalesce("over", "parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        whole("children").alias("n_children"), whole("leaves").alias("n_leaves"), whole("saved").alias("saved_tokens"), digest.alias("ends_sha256"), name("a", "b").alias("node"), name("pa", "pb").alias("parent"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")
