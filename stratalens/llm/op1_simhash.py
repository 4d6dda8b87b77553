"""Operator 1, SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid out in tiles by the population counts of their
four quarters.  Two fingerprints within the radius differ by no more than the
radius in the sum of those counts, so only tiles whose counts are that near
are paired; a pair is compared whole with exclusive-or and bit counts.  From
each pair comes a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, clash_free, collect_garbage, give_back, lean, materialize, narrow, pack, release, runs, table, text_bytes, unpack
from .components import connected_components

#: Fingerprints that a tile holds, about.
TILE = 2048
#: Rows of a side that is broadcast, at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles that share a counter, about, and bits that tell counters apart: 64 MB of counters at most, whatever the corpus.
SHARED, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Members of a group at one shingle from which it is met as a whole.
CROWD = 16
#: Parts that counters are summed in, each by itself.
PARTS = 64
#: Texts that may share a shingle in one task.
HOT = 4096
#: Shingles of the texts that one block of a verification holds, about.
BLOCK_SHINGLES = 2_000_000
SEED = 42


def shingles(body: bytes, k: int) -> list[bytes]:
    """Shingles of k lower-cased words, repeats included; the whole sequence if there are fewer words."""
    words = body.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    return [joined[s:e] for s, e in zip(start[: len(words) - k + 1].tolist(), (start[k:] - 1).tolist())]


def shingle_hashes(body: bytes, k: int) -> np.ndarray:
    own = shingles(body, k)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; zero for none.  As a signed 64-bit number."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long) and n (shingles) of every row; a null text is empty."""

    def run(batches):
        for batch in batches:
            fps, n = [], []
            for body in batch.column(1):
                h = shingle_hashes(body.as_py() or b"", shingle)
                fps.append(simhash(h))
                n.append(h.size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "fp", "n"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("body")).mapInArrow(lean(run), "doc_id long, fp long, n long")


def quarters(fp: str = "fp") -> Column:
    """The population counts of the four quarters in one number, five bits each; 4 is added so that no step borrows."""
    count = lambda i: (F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF))) + 4).cast("int")
    return count(0) + count(1) * 32 + count(2) * 1024 + count(3) * 32768


def quarter_steps(radius: int) -> list[int]:
    """Steps between quarters' codes whose counts differ by ``radius`` in all, one of each pair of opposites."""
    if radius > 4:
        raise ValueError("quarters tell tiles apart for a radius up to 4")
    reach = range(-radius, radius + 1)
    near = (d for d in itertools.product(reach, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0))
    return [d[3] + d[2] * 32 + d[1] * 1024 + d[0] * 32768 for d in near]


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a matrix of rows against columns."""
    if np.count_nonzero(near) <= sum(near.shape):
        return np.nonzero(near)
    free_r, free_c = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    out: list[tuple[int, int]] = []
    for top in np.flatnonzero(near.any(axis=1)).tolist():
        if not free_r[top]:
            continue
        free_r[top] = False
        rows = [top]
        while rows:
            r = rows.pop()
            cols = np.flatnonzero(near[r] & free_c)
            free_c[cols] = False
            for c in cols.tolist():
                out.append((r, c))
                more = np.flatnonzero(near[:, c] & free_r)
                free_r[more] = False
                out += [(m, c) for m in more.tolist()]
                rows += more.tolist()
    i, j = np.array(out).T
    return i, j


def nearest(apart: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The link of least distance of every row and of every column that has one."""
    masked = np.where(near, apart, 255)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    return np.r_[rows, masked.argmin(axis=0)[cols]], np.r_[masked.argmin(axis=1)[rows], cols]


def compare_tiles(radius: int, ratio: float) -> object:
    """Links of pairs of tiles; each tile is four lists (fp, node, n, root).

    With a ratio links are candidates yet to be verified, between nodes of
    different roots: those of least distance, the likeliest, come beside the
    forest.
    """

    def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
        flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
        return (flat[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist()))

    def run(batches):
        for batch in batches:
            a_out, b_out = [], []
            same = batch.column(0).to_pylist()
            for own, fa, na, sa, ra, fb, nb, sb, rb in zip(same, *(lists(batch.column(i)) for i in range(1, 9))):
                fa, fb = fa.view(np.uint64), fb.view(np.uint64)  # bits of signed numbers are those of their absolute value
                near, apart = np.empty((fa.size, fb.size), bool), np.empty((fa.size, fb.size), np.uint8)
                for at in range(0, fa.size, 256):
                    part = slice(at, at + 256)
                    apart[part] = np.bitwise_count(fa[part, None] ^ fb[None, :])
                    near[part] = apart[part] <= radius
                    if ratio:
                        near[part] &= np.minimum(sa[part, None], sb[None, :]) >= ratio * np.maximum(sa[part, None], sb[None, :])
                        near[part] &= ra[part, None] != rb[None, :]
                if own:
                    near = np.triu(near, 1)
                i, j = forest(near)
                if ratio and i.size:
                    more = nearest(apart, near)
                    i, j = np.r_[i, more[0]], np.r_[j, more[1]]
                if i.size:
                    a_out.append(na[i])
                    b_out.append(nb[j])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    return run


def tile_links(nodes: DataFrame, cell: Column, steps: list[int], radius: int, *, ratio: float = 0.0) -> DataFrame:
    """Links (a, b) between nodes (fp, node, n, root) within the radius, by pairs of tiles whose cells are a step apart.

    A cell is split into tiles by hash, as many as its count asks for.
    """
    celled = nodes.select("fp", "node", "n", "root", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    # one row a cell, 21 ** 4 cells at most: a bound for the broadcast
    tiles = celled.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("node"), F.col("parts")).alias("tile"))
    listed = F.sort_array(F.collect_list(F.struct("node", "fp", "n", "root")))
    tiles = tiles.agg(listed.alias("x")).select("cell", "tile", *[F.col(f"x.{c}").alias(c) for c in ("fp", "node", "n", "root")])
    tiles = materialize(tiles)
    left = tiles.select("cell", "tile", "fp", "node", "n", "root", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step")).withColumn("other", F.col("cell") + F.col("step"))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("tile2"), F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    pairs = left.join(right, "other").where("step <> 0 or tile <= tile2")
    pairs = pairs.select(((F.col("step") == 0) & (F.col("tile") == F.col("tile2"))).alias("same"), "fp", "node", "n", "root", "fp2", "node2", "n2", "root2")
    return pairs.mapInArrow(lean(compare_tiles(radius, ratio)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is
    the smallest doc_id that can be reached, null only if all of them are
    null.  Texts without words (null, empty) have fingerprint zero and link
    like any other; repeated rows each come back.
    """
    own = materialize(fingerprints(docs, shingle, id_column=id_column, text_column=text_column).select("doc_id", "fp"))
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = distinct.select("fp", F.col("fp").alias("node"), F.lit(0).cast("long").alias("n"), F.col("fp").alias("root"))
    found = connected_components(tile_links(nodes, quarters(), quarter_steps(radius), radius))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(rooted.join(least, "root").select("fp", "component_id"))
    release(distinct, found)
    collect_garbage(docs.sparkSession)
    out = own.join(labels, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """node and its distinct shingle hashes."""

    def run(batches):
        for batch in batches:
            rows = [np.unique(shingle_hashes(body.as_py() or b"", k)).view(np.int64) for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(lean(run), "node long, hashes array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar enough; two texts without words are."""
    pairs = materialize(pairs.distinct())
    involved = materialize(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    some = bounded_broadcast(involved, involved.count(), BROADCAST_ROWS)
    sets = materialize(_sets(texts.join(some, "node").dropDuplicates(["node"]), k))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))


def counter_bits(total_bytes: int) -> int:
    """Bits of a counter's number for a corpus of so many bytes (six to a shingle, about)."""
    return min(MOST_BITS, max(LEAST_BITS, (total_bytes // (6 * SHARED)).bit_length()))


def counted_cells(cells: list[np.ndarray], bits: int) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """What a task adds to the counters, by part: steps between the counters met and how often, compressed."""
    at, many = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    start, length = runs(at >> np.uint32(bits - 6))
    for s, n in zip(start.tolist(), length.tolist()):
        own = at[s : s + n].astype(np.int64)
        body = pack(own[:1], narrow(np.diff(own)), narrow(many[s : s + n]))
        yield int(own[0] >> (bits - 6)), (len(body), pa.compress(body, "zstd", asbytes=True))


def summed_cells(bits: int) -> object:
    """Counters of each part over all tasks, as a byte each: sixteen steps to a doubling."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, size, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first, step, many = unpack(pa.decompress(blob, size, "zstd", asbytes=True))
                at = (np.cumsum(np.r_[first, step.astype(np.int64)]) - (part << (bits - 6))).astype(np.int64)
                sums.setdefault(part, np.zeros(1 << (bits - 6), np.uint32))[at] += many.astype(np.uint32)
        for part, total in sums.items():
            scaled = np.minimum(255, np.round(16 * np.log2(1.0 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([scaled.tobytes()], pa.binary())], ["part", "counts"])

    return run


def prefix(hashes: np.ndarray, counters: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order of all shingles, rare ones first.

    Of n shingles at least similarity * n stand in any set that is similar
    enough, so two such sets share one of their first n - similarity * n + 1.
    Counters are shared by several shingles, which disturbs the order alike for
    all sets and loses nothing.
    """
    seen = counters[hashes >> np.uint64(65 - counters.size.bit_length())]
    return hashes[np.lexsort((hashes, seen))][: hashes.size - int(np.ceil(similarity * hashes.size - 1e-9)) + 1]


class HotShingle:
    """The texts of one group at a hot shingle: rows of their own, or one row of bounds once there are ``CROWD``.

    Rows are (h, root, node, crowd, least, most, left): sizes lie from least to
    most, no text has more than ``left`` shingles left.  Texts come one after
    another, in any number of batches; no more than ``CROWD`` are held.
    """

    def __init__(self, h: int, root: int):
        self.h, self.root, self.last, self.some = h, root, None, []
        self.bounds: tuple[int, int, int] | None = None

    def add(self, node: np.ndarray, size: np.ndarray, after: np.ndarray) -> None:
        fresh = np.r_[self.last is None or node[0] != self.last, node[1:] != node[:-1]]
        node, size, after, self.last = node[fresh], size[fresh], after[fresh], node[-1]
        if not node.size:
            return
        if self.bounds is None and len(self.some) + node.size < CROWD:
            self.some += zip(node.tolist(), size.tolist(), after.tolist())
            return
        held = self.bounds and [self.bounds] or [(n, n, left) for _, n, left in self.some]
        held.append((int(size.min()), int(size.max()), int(after.max())))
        least, most, left = zip(*held)
        self.bounds, self.some = (min(least), max(most), max(left)), []

    def rows(self) -> list[tuple]:
        if self.bounds:
            return [(self.h, self.root, self.root, True, *self.bounds)]
        return [(self.h, self.root, node, False, size, size, left) for node, size, left in self.some]


#: Links, or (where h isn't null) what a hot shingle's groups are reduced to.
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("wide", pa.int32()), ("h", pa.int64()), ("root", pa.int64()), ("node", pa.int64()), ("crowd", pa.bool_()), ("least", pa.int64()), ("most", pa.int64()), ("left", pa.int64())])


def meet(similarity: float) -> object:
    """Pairs (a, b) of texts of different groups that share a shingle of their prefixes and may reach the similarity.

    Rows (h, node, root, size << 32 | place, salt) come in order of h, salt and
    node.  A group with ``CROWD`` members at a shingle is met as a whole: where
    wide is 1, b is the root of a group that a may belong to; where it is 2, so
    is a.  Rows with a salt are those of hot shingles, a group each; they are
    reduced here and meet in blocks (``hot_links``).
    """
    share = similarity / (1 + similarity)

    def near(size: np.ndarray, after: np.ndarray, one: int, left: int) -> np.ndarray:
        """Which texts, by size and shingles left, may reach the similarity with one of such a size and as many left."""
        return (np.minimum(after, left) >= share * (size + one) - 1e-6) & (np.minimum(size, one) >= similarity * np.maximum(size, one) - 1e-6)

    def crowds(node: np.ndarray, root: np.ndarray, size: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Pairs with large groups; what is left are pairs among ``few``."""
        roots, which, many = np.unique(root, return_inverse=True, return_counts=True)
        large = np.flatnonzero(many >= CROWD)
        bounds = []
        for g in large.tolist():
            own = which == g
            bounds.append((roots[g], int(size[own].min()), int(size[own].max()), int(after[own].max())))
        few = ~np.isin(which, large)
        for i, (r, least, most, left) in enumerate(bounds):
            ok = few & (np.minimum(after, left) >= share * (size + least) - 1e-6) & (size >= similarity * least - 1e-6) & (most >= similarity * size - 1e-6)
            if ok.any():
                yield node[ok], np.full(int(ok.sum()), r), 1
            for q, least2, most2, left2 in bounds[:i]:
                if min(left, left2) >= share * (least + least2) - 1e-6 and most >= similarity * least2 - 1e-6 and most2 >= similarity * least - 1e-6:
                    yield np.array([q]), np.array([r]), 2

    def pairs(h: np.ndarray, node: np.ndarray, root: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        fresh = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
        h, node, root, where = h[fresh], node[fresh], root[fresh], where[fresh]
        size, after = where >> 32, (where >> 32) - (where & 0xFFFFFFFF)
        start, length = runs(h)
        for s, n in zip(start[length > 1].tolist(), length[length > 1].tolist()):
            at = np.arange(s, s + n)
            if n >= CROWD:
                yield from crowds(node[at], root[at], size[at], after[at])
                _, which, many = np.unique(root[at], return_inverse=True, return_counts=True)
                at = at[many[which] < CROWD]
            for k in range(at.size - 1):
                i, j = at[k], at[k + 1 :]
                found = node[j[(root[j] != root[i]) & near(size[j], after[j], size[i], after[i])]]
                if found.size:
                    yield np.minimum(found, node[i]), np.maximum(found, node[i]), 0

    def batch_of(out: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        rows = np.unique(np.concatenate([np.c_[a, b, np.full(a.size, wide)] for a, b, wide in out]), axis=0)
        links = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*links, *[pa.nulls(len(rows), f.type) for f in MET][3:]], schema=MET)

    def reduced(rows: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(MET)[3:])]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), f.type) for f in MET][:3], *own], schema=MET)

    def run(batches):
        held, group, ready = None, None, []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.column(4).null_count < batch.num_rows:
                mixed = batch.column(4).is_null().to_numpy(zero_copy_only=False)
                h, node, root, where = (batch.column(i).to_numpy()[~mixed] for i in range(4))
                size, after = where >> 32, (where >> 32) - (where & 0xFFFFFFFF)
                ends = np.r_[np.flatnonzero((h[1:] != h[:-1]) | (root[1:] != root[:-1])) + 1, h.size].tolist()
                for s, e in zip([0, *ends], ends):
                    if group is None or (group.h, group.root) != (h[s], root[s]):
                        ready += group.rows() if group else []
                        group = HotShingle(int(h[s]), int(root[s]))
                    group.add(node[s:e], size[s:e], after[s:e])
                    if len(ready) > 10_000:
                        yield reduced(ready)
                        ready = []
                batch = batch.filter(pa.array(mixed))
                if not batch.num_rows:
                    continue
            if batch is not None:
                new = [batch.column(i).to_numpy() for i in range(4)]
                held = new if held is None else [np.r_[a, b] for a, b in zip(held, new)]
                cut = int(np.searchsorted(held[0], held[0][-1])) if held[0].size else 0  # the last shingle may go on
            else:
                cut = held[0].size if held else 0
            if cut:
                out, many = [], 0
                for pair in pairs(*[x[:cut] for x in held]):
                    out.append(pair)
                    many += pair[0].size
                    if many > 100_000:
                        yield batch_of(out)
                        out, many = [], 0
                if out:
                    yield batch_of(out)
                held = [x[cut:] for x in held]
        ready += group.rows() if group else []
        if ready:
            yield reduced(ready)

    return run


def met(similarity: float) -> object:
    """Links between the rows of two blocks of a hot shingle, or within one."""
    share = similarity / (1 + similarity)
    names = ["root", "node", "crowd", "least", "most", "left", "block"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        root, node, crowd, least, most, left, block = (rows[n].combine_chunks().to_numpy(zero_copy_only=False) for n in names)
        x, y = key[1].as_py(), key[2].as_py()
        ones, others = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out = [np.empty((0, 3), np.int64)]
        for k, i in enumerate(ones.tolist()):
            j = others[k + 1 :] if x == y else others
            j = j[(root[j] != root[i]) & (np.minimum(left[j], left[i]) >= share * (least[j] + least[i]) - 1e-6) & (most[j] >= similarity * least[i] - 1e-6) & (most[i] >= similarity * least[j] - 1e-6)]
            wide = crowd[j].astype(np.int64) + bool(crowd[i])
            # of a text and a crowd the crowd stands last, else the larger number
            swap = np.where(wide == 1, bool(crowd[i]), node[j] < node[i])
            out.append(np.c_[np.where(swap, node[j], node[i]), np.where(swap, node[i], node[j]), wide])
        links = np.concatenate(out)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1]), "wide": pa.array(links[:, 2].astype(np.int32))})

    return run


def hot_links(rows: DataFrame, hot: int, similarity: float) -> DataFrame:
    """Links (a, b, wide) at hot shingles: their rows are dealt to blocks of about ``hot``, and a pair of blocks is a task's work."""
    many = rows.groupBy("h").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
    placed = rows.join(many, "h").withColumn("block", F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "root", "node", "crowd", "least", "most", "left", "block")
    return sent.groupBy("h", "x", "y").applyInArrow(met(similarity), "a long, b long, wide int")


def _joined(key: tuple, nodes: pa.Table, pairs: pa.Table) -> pa.Table:
    """Verified links of a pair of blocks, none between texts that are together already."""
    own = dict(zip(nodes["node"].to_pylist(), range(nodes.num_rows)))
    column = nodes["hashes"].combine_chunks()
    flat, at = column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())].tolist()
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    root, out = nodes["root"].to_pylist(), []
    similarity = nodes["similarity"][0].as_py() if nodes.num_rows else 1.0
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
        i, j = own[a], own[b]
        x, y = top(root[i]), top(root[j])
        if x != y:
            p, q = flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]]
            both = np.sort(np.concatenate([p, q]))
            common = np.count_nonzero(both[1:] == both[:-1])
            if common >= similarity * (p.size + q.size - common) - 1e-9:
                above[x] = y
                out.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def nearby(similarity: float) -> object:
    """Links of texts to members of a group: one for each text, to the most similar member, if it reaches the similarity."""

    def sets(rows: pa.Table, of: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = rows[f"{of}hashes"].combine_chunks()
        return rows[f"{of}node"].to_numpy(), column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]

    def run(key: tuple, texts: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if texts.num_rows and members.num_rows:
            node, flat, at = sets(texts, "of_")
            own, all_hashes, ends = sets(members)
            size, held = np.diff(ends), ends[:-1]
            kept = size > 0  # texts with shingles only: others are alike by their hash
            for i in range(node.size):
                p = np.sort(flat[at[i] : at[i + 1]])
                if not p.size or not all_hashes.size:
                    continue
                hit = p[np.minimum(np.searchsorted(p, all_hashes), p.size - 1)] == all_hashes
                common = np.add.reduceat(hit, np.minimum(held, all_hashes.size - 1), dtype=np.int64) * kept
                alike = common / (p.size + size - common)
                j = int(alike.argmax())
                if common[j] >= similarity * (p.size + size[j] - common[j]) - 1e-9:
                    a.append(node[i])
                    b.append(own[j])
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def group_links(wide: DataFrame, base: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) of texts to the groups they may belong to: every such text meets every member, block by block.

    A group's members and the texts it is compared with are rows each, never
    pairs; blocks hold so many shingles, and a pair of blocks is one task.
    """
    known = texts.select("node", "root", "n").dropDuplicates(["node"])
    roots = wide.select(F.col("b").alias("root")).unionAll(wide.where("wide = 2").select("a")).distinct()
    members = known.join(roots, "root")
    single = wide.where("wide = 1").select(F.col("b").alias("root"), F.col("a").alias("node"))
    whole = wide.where("wide = 2").select(F.col("b").alias("root"), F.col("a").alias("other")).join(members.select(F.col("root").alias("other"), "node"), "other")
    guests = single.unionAll(whole.select("root", "node")).distinct().join(known.select("node", "n"), "node")
    some = members.select("node").unionAll(guests.select("node")).distinct()
    sets = materialize(_sets(base.join(bounded_broadcast(some, some.count(), BROADCAST_ROWS), "node").dropDuplicates(["node"]), k))
    blocks = lambda df, name: df.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))
    parts = materialize(blocks(members, "blocks_of_members").join(blocks(guests, "blocks_of_guests"), "root"))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = rows.select("root", "node").join(parts, "root").withColumn(mine, F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).join(sets, "node").select("root", "x", "y", "node", "hashes")

    left = dealt(guests, "blocks_of_guests", "blocks_of_members", "x", "y")
    left = left.select(*[F.col(c).alias(f"of_{c}") for c in left.columns])
    right = dealt(members, "blocks_of_members", "blocks_of_guests", "y", "x")
    return left.groupBy("of_root", "of_x", "of_y").cogroup(right.groupBy("root", "x", "y")).applyInArrow(nearby(similarity), "a long, b long")


def exact_links(base: DataFrame, texts: DataFrame, counters: np.ndarray, k: int, similarity: float, hot: int = HOT) -> DataFrame:
    """Links (a, b) that, with those within groups (node, root), connect all texts that are similar enough: no pair is missed.

    Candidates share a rare shingle.  They are verified by pairs of blocks of
    the texts they connect, so that a text is not sent once a candidate; large
    groups are met as groups.  A shingle that more than ``hot`` texts may hold,
    by the counters, is no task's own: its groups are reduced one by one and
    meet block by block.
    """
    warm = 16 * np.log2(1.0 + hot)
    shift = np.uint64(65 - counters.size.bit_length())
    moved = texts.where("node <> root").select("node", "root")
    grouped = base.join(bounded_broadcast(moved, moved.count(), BROADCAST_ROWS), "node", "left")
    grouped = grouped.select("node", F.coalesce("root", "node").alias("root"), F.col("text").cast("binary").alias("body"))

    def firsts(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(body.as_py() or b"", k)) for body in batch.column(2)]
            own = [prefix(s, counters, similarity) if s.size else s for s in sets]
            many = [x.size for x in own]
            node, root = (np.repeat(batch.column(i).to_numpy(), many) for i in range(2))
            where = [(s.size << 32) + np.arange(x.size) for s, x in zip(sets, own)]
            names = ["h", "node", "root", "place", "salt"]
            if not own:
                yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names)
                continue
            h = np.concatenate(own)
            salt = pa.array(root, mask=counters[h >> shift] < warm)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(root), pa.array(np.concatenate(where).astype(np.int64)), salt], names)

    rows = grouped.mapInArrow(lean(firsts), "h long, node long, root long, place long, salt long").repartition("h", "salt").sortWithinPartitions("h", "salt", "node")
    found = materialize(rows.mapInArrow(lean(meet(similarity)), "a long, b long, wide int, h long, root long, node long, crowd boolean, least long, most long, left long").distinct())
    crowded = found.where("h is not null").drop("a", "b", "wide")
    found = found.where("h is null").select("a", "b", "wide")
    if not crowded.isEmpty():
        found = materialize(found.unionAll(hot_links(crowded, hot, similarity)).distinct())
    wide, pairs = found.where("wide > 0"), found.where("wide = 0").select("a", "b")
    clusters = connected_components(pairs)
    own = materialize(clusters.join(texts.select("node", F.col("root").alias("group"), "n").dropDuplicates(["node"]), "node"))
    parts = own.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    blocks = materialize(own.join(parts, "root").select("node", "group", "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block")))
    ends = [blocks.select(F.col("node").alias(c), "root", F.col("block").alias(f"block_{c}")) for c in "ab"]
    placed = pairs.join(ends[0], "a").join(ends[1].drop("root"), "b")
    placed = materialize(placed.select("a", "b", "root", F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y")))
    some = bounded_broadcast(blocks.select("node"), blocks.count(), BROADCAST_ROWS)
    sets = materialize(_sets(base.join(some, "node").dropDuplicates(["node"]), k))
    needed = placed.select(F.col("a").alias("node"), "root", "x", "y").unionAll(placed.select("b", "root", "x", "y")).distinct().withColumnRenamed("root", "cluster")
    nodes = needed.join(blocks.select("node", "group"), "node").join(sets, "node").select("cluster", "x", "y", "node", F.col("group").alias("root"), "hashes", F.lit(similarity).alias("similarity"))
    held = placed.select("a", "b", *[F.col(c).alias(f"of_{c}") for c in ("root", "x", "y")])
    links = nodes.groupBy("cluster", "x", "y").cogroup(held.groupBy("of_root", "of_x", "of_y"))
    return links.applyInArrow(_joined, "a long, b long").unionAll(group_links(wide, base, texts, k, similarity))


def _merged(texts: DataFrame, links: DataFrame) -> DataFrame:
    """texts with the groups that the links between any of their members make of their groups."""
    root = texts.select("node", "root")
    ends = links.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    found = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = texts.join(found.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").withColumn("group", F.coalesce("next", "root"))
    heads = moved.groupBy("group").agg(F.min(F.struct("least", "node")).alias("head"))
    return materialize(moved.join(heads, "group").select("node", "fp", "n", "least", F.col("head.node").alias("root")))


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 13, *, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, node, kept, copies): every distinct row and the text that stands for its group.

    Texts meet by fingerprints within the radius, in tiles of like numbers of
    shingles (the similarity bounds their ratio), and are verified by the exact
    similarity of their sets of shingles.  Large groups shrink first by the
    verified links of spanning forests; then every text, head or not, meets
    those of other groups by the rare shingles that similar sets must share.
    ``kept`` is true for the row with the smallest id of a group (null ids
    last), ``copies`` how often that very row stands in docs.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("node"), F.col(text_column).alias("text"))

    bits = counter_bits(text_bytes(docs, text_column))
    shift = np.uint64(64 - bits)
    row = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        cells: list[np.ndarray] = []
        for batch in batches:
            hashes = [np.unique(shingle_hashes(body.as_py() or b"", shingle)) for body in batch.column(2)]  # the similarity is one of sets
            cells += [(h >> shift).astype(np.uint32) for h in hashes]
            columns = [batch.column(0), batch.column(1), pa.array([simhash(h) for h in hashes], pa.int64()), pa.array([h.size for h in hashes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(batch.num_rows, f.type) for f in row][4:]], schema=row)
        for part, (size, blob) in counted_cells(cells, bits):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in row][:4], pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], schema=row)

    seen = materialize(base.select("doc_id", "node", F.col("text").cast("binary").alias("body")).mapInArrow(lean(run), "doc_id long, node long, fp long, n long, part int, size long, blob binary"))
    parts = seen.where("part is not null").select("part", "size", "blob").repartition(PARTS, "part").mapInArrow(lean(summed_cells(bits)), "part int, counts binary")
    counters = np.zeros(1 << bits, np.uint8)
    for r in parts.toLocalIterator():  # 64 parts, 64 MB at most together
        counters[r["part"] << (bits - 6) : (r["part"] + 1) << (bits - 6)] = np.frombuffer(r["counts"], np.uint8)
    own = materialize(seen.where("part is null").groupBy("doc_id", "node", "fp", "n").agg(F.count("*").alias("copies")))
    release(seen)
    texts = materialize(own.groupBy("node", "fp", "n").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("least")).withColumn("root", F.col("node")))
    size = F.when(F.col("n") == 0, -1).otherwise(F.floor(F.log(F.col("n").cast("double")) / float(-np.log(similarity)) + 1e-9)).cast("int")
    texts = _merged(texts, _verified(tile_links(texts.select("fp", "node", "n", "root"), size, [0, 1], radius, ratio=similarity), base.select("node", "text"), shingle, similarity))
    texts = _merged(texts, exact_links(base.select("node", "text"), texts, counters, shingle, similarity, hot))
    kept = (F.col("node") == F.col("root")) & F.coalesce("doc_id", F.lit((1 << 63) - 1)).eqNullSafe(F.col("least"))
    return materialize(own.join(texts.select("node", "least", "root"), "node").select("doc_id", F.col("node").alias("text_hash"), "root", kept.alias("kept"), "copies"))


@clash_free
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more."""
    found = similar_texts(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2"))
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.xxhash64("text") == F.col("hash2"))
    out = docs.join(bounded_broadcast(gone, gone.count(), BROADCAST_ROWS), same, "left_anti")
    repeated = found.where("kept and copies > 1").select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2"))
    if repeated.isEmpty():
        return out.select(*docs.columns)
    once = docs.join(bounded_broadcast(repeated, repeated.count(), BROADCAST_ROWS), same).dropDuplicates(["id2", "hash2"])
    out = out.join(bounded_broadcast(repeated, repeated.count(), BROADCAST_ROWS), same, "left_anti")
    return out.select(*docs.columns).unionAll(once.select(*docs.columns))
