"""Exact repeats over whole corpora: the exchange that operators 6 and 8 share.

Three passes over the texts, each with work and memory in proportion to them:

A. Every document yields *anchors* (a name and a position).  Names meet in
   buckets; an anchor is a candidate if its name occurs twice anywhere.
B. Windows whose anchors are all candidates get a 64-bit name; names meet in
   buckets again and decide which windows repeat.
C. The repeated windows go back to their documents, which are cut.

Texts that are equal as a whole are settled by their hash: of such a group one
document takes part, the others follow from it.

Names that a batch holds twice are settled there and then; one marker goes on
in their stead.  So what a hot passage sends to its bucket is one entry for
each batch, never one for each copy.  A document is (doc_id, hash of the
text): rows that repeat both are one document, and each gets its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, collect_garbage, lean, materialize, mix64, narrow, pack, release, runs, text_bytes, unpack

U = np.uint64
#: Entries that a task gathers before it settles and sends them: some 60 bytes each at the peak.
FLUSH = 1_000_000
LAST = (1 << 63) - 1
#: Kinds of rows that meet the documents, in this order: copies of an earlier document, the first of such, replies, documents.
COPY, COPIED, REPLY, DOCUMENT = -2, -1, 0, 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, 0 to n - 1."""
    if _POWERS[0].size < n:
        size = max(n, 2 * _POWERS[0].size)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, U)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Names of all substrings of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = symbols.size
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(symbols * up[: self.n], out=self.sums[1:])

    def names(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        return mix64((self.sums[length:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, U)


class WordWindows:
    """Windows of consecutive words; all but the first occurrence go.

    Reference blocks of half a window stand one after another, from an offset
    that varies by document; every window holds one whole block, so a window
    can only repeat if its blocks are met by rolling probes elsewhere.
    """

    earliest = True

    def __init__(self, window: int = 20):
        self.window, self.block = window, window // 2

    def symbols(self, body: bytes) -> np.ndarray:
        words = body.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))

    def anchors(self, body: bytes, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of all rolling blocks, and the positions of the reference blocks among them."""
        s = self.symbols(body)
        if s.size < self.window:
            return np.zeros(0, U), np.zeros(0, np.int64)
        names = Rolling(s).names(self.block)
        return names, np.arange(key % self.block, names.size, self.block)

    def windows(self, body: bytes, key: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the windows all of whose reference blocks are candidates."""
        s = self.symbols(body)
        m = s.size - self.window + 1
        if m <= 0 or not found.size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        hit = np.zeros(s.size, bool)
        hit[found] = True
        p = np.arange(m)
        first = p + (key - p) % self.block
        ok = hit[first]
        both = (first == p) & (first + 2 * self.block <= p + self.window)
        ok &= ~both | hit[first + self.block]
        p = p[ok]
        return p, Rolling(s).names(self.window)[p]

    def cut(self, body: bytes, starts: np.ndarray, whole: bool) -> dict:
        words = body.split()
        starts = np.arange(max(0, len(words) - self.window + 1)) if whole else starts
        gone = covered(starts, self.window, len(words))
        kept = b" ".join(words if not starts.size else [w for w, g in zip(words, gone.tolist()) if not g])
        return {"n": len(words), "n_removed": int(gone.sum()), "n_spans": n_runs(gone), "kept": kept}


class ByteStrings:
    """Strings of a fixed number of bytes; every occurrence of a repeated one goes.

    Bucket-pointer refinement on suffixes: the initial buckets hold equal
    q-grams, taken at the minima of a sliding window, of which each string has
    one at least.  Suffixes whose bucket is shared are refined by the pair
    (bucket here, bucket at the offset that is already sorted); each round
    doubles the depth and uses the identifiers of the one before, down to the
    depth of the whole string.  Identifiers are names made from content, so
    workers agree on them without a common ranking.
    """

    earliest = False
    _symbols = mix64(np.arange(1, 257, dtype=U) * U(_BASE))

    def __init__(self, window: int = 400):
        self.window, self.q = window, min(48, max(1, window // 4))
        self.grams = window - self.q + 1

    def buckets(self, body: bytes) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
        """Names of all q-grams, the least of each window, and the places of those that are least somewhere."""
        roll = Rolling(self._symbols[np.frombuffer(body, np.uint8)])
        names = roll.names(self.q)
        least = sliding(np.minimum, names, self.grams)
        pad = np.zeros(self.grams - 1, U)
        return roll, names, least, np.flatnonzero(sliding(np.maximum, np.concatenate([pad, least, pad]), self.grams) == names)

    def anchors(self, body: bytes, key: int) -> tuple[np.ndarray, np.ndarray]:
        if len(body) < self.window:
            return np.zeros(0, U), np.zeros(0, np.int64)
        _, names, _, at = self.buckets(body)
        return mix64(names[at] + U(_BASE)), at  # minima are small numbers; mixed again, they spread evenly

    def windows(self, body: bytes, key: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(body) - self.window + 1
        if m <= 0 or not found.size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        roll, names, least, _ = self.buckets(body)
        start, count = runs(least)  # the gram that stands for a window must be a candidate
        p = np.flatnonzero(np.repeat(np.isin(least[start], names[found]), count))
        return p, self.refined(roll)[p] if p.size else np.zeros(0, U)

    def refined(self, roll: Rolling) -> np.ndarray:
        """Names of depth ``window``: a hash of halves, then of pairs of their names at doubling offsets; nothing is sorted."""
        depths = [self.window]
        while depths[-1] > self.q:
            depths.append((depths[-1] + 1) // 2)
        depth = depths.pop()
        name = roll.names(depth)
        for deeper in reversed(depths):
            later = deeper - depth  # the offset of the second pointer: the two strings cover the deeper one
            m = roll.n - deeper + 1
            name = mix64(name[:m] * U(_BASE) + name[later : later + m])
            depth = deeper
        return name

    def cut(self, body: bytes, starts: np.ndarray, whole: bool) -> dict:
        starts = np.arange(max(0, len(body) - self.window + 1)) if whole else starts
        gone = covered(starts, self.window, len(body))
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes() if starts.size else body
        return {"n": len(body), "n_removed": int(gone.sum()), "n_spans": n_runs(gone), "kept": kept}


def sliding(op: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """op over each window of ``width`` values: running values inside blocks, from both sides."""
    m = a.size - width + 1
    if m <= 0:
        return np.zeros(0, a.dtype)
    rows = -(-a.size // width)
    block = np.empty(rows * width, a.dtype)
    block[: a.size], block[a.size :] = a, a[-1]
    block = block.reshape(rows, width)
    ahead = op.accumulate(block, axis=1).ravel()
    behind = op.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:m], ahead[width - 1 : width - 1 + m])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def n_runs(mask: np.ndarray) -> int:
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_SQL = "bucket int, kind tinyint, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of packed rows, at most about 16 MB each."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[2])
        if size > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*part), _ROWS)], schema=_ROWS)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*part), _ROWS)], schema=_ROWS)


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a name, from its upper half; it grows with the name."""
    return ((names >> U(32)) * U(n)) >> U(32)


def _slices(sorted_ids: np.ndarray) -> Iterator[tuple[int, slice]]:
    start, count = runs(sorted_ids)
    for s, c, b in zip(start.tolist(), count.tolist(), sorted_ids[start].tolist()):
        yield int(b), slice(s, s + c)


def _replies(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Positions on their way back to the documents (k1, k2), by the documents' group."""
    if not pos.size:
        return []
    order = np.lexsort((pos, k2, k1, np.mod(k1 ^ k2, n)))
    k1, k2, pos = k1[order], k2[order], pos[order]
    out = []
    for g, s in _slices(np.mod(k1 ^ k2, n)):
        a, b, p = k1[s], k2[s], pos[s]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        step = np.diff(p, prepend=0)
        step[start] = p[start]
        out.append((g, 1, pack(a[start], b[start], narrow(np.diff(np.r_[start, p.size])), narrow(step))))
    return out


def squeeze(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as the first one and their steps, in as few bytes each as the largest needs."""
    if not ordered.size:
        return ordered, np.zeros(0, np.uint8)
    step = np.diff(ordered, prepend=ordered[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return ordered[:1], np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).ravel()


def unsqueeze(first: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U)
    step = np.zeros((n, 8), np.uint8)
    step[:, : data.size // n] = data.reshape(n, -1)
    return np.cumsum(step.view(U).ravel()) + first[0]


def by_document(own: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by document and position; the documents, how many each, and steps between positions."""
    order = np.argsort((own.astype(np.int64) << 40) | pos)
    own, pos = own[order], pos[order]
    start, count = runs(own)
    step = np.diff(pos, prepend=0)
    step[start] = pos[start]
    return order, own[start], narrow(count), narrow(step)


def places(count: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undo by_document: which document, and the position."""
    count, total = count.astype(np.int64), np.cumsum(step.astype(np.int64))
    start = np.cumsum(count) - count
    base = total[start] - step[start].astype(np.int64) if start.size else total
    return np.repeat(np.arange(count.size), count), total - np.repeat(base, count)


class _Found:
    """Replies of one group of documents: (k1, k2) to sorted positions."""

    def __init__(self) -> None:
        self.by: dict[tuple[int, int], list[np.ndarray]] = {}

    def add(self, blob: bytes) -> None:
        a, b, count, step = unpack(blob)
        ends = np.cumsum(count.astype(np.int64))
        for k1, k2, s, e in zip(a.tolist(), b.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            self.by.setdefault((k1, k2), []).append(np.cumsum(step[s:e].astype(np.int64)))

    def of(self, key: tuple[int, int]) -> np.ndarray:
        got = self.by.get(key)
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)


def _docs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    col = batch.schema.get_field_index
    bodies = batch.column(col("body"))
    for k1, k2, body in zip(batch.column(col("k1")).to_pylist(), batch.column(col("k2")).to_pylist(), bodies):
        yield k1, k2, body.as_py() or b""


def anchor_step(plan, n: int) -> Callable:
    def settle(names: list, held: list, keys: list[int]) -> list[tuple[int, int, bytes]]:
        h = np.concatenate(names)
        at = np.full(h.size, -1, np.int32)
        whose = np.zeros(h.size, np.int32)
        base = 0
        for k, (part, pos) in enumerate(zip(names, held)):
            where = pos if plan.earliest else np.arange(part.size)
            at[base + where] = pos
            whose[base + where] = k
            base += part.size
        names.clear()
        held.clear()
        order = np.argsort(h)
        h, at, whose = h[order], at[order].astype(np.int64), whose[order]
        del order
        start, count = runs(h)
        aligned = at >= 0
        some = np.add.reduceat(aligned, start, dtype=np.int64)
        many = count > 1
        key = np.array(keys, np.int64)
        settled = np.repeat(many, count) & aligned
        zero = np.zeros(int(settled.sum()), np.int64)
        rows = _replies(key[whose[settled]], zero, at[settled], n)
        marks = h[start[many | (some == 0)]]
        lone = start[~many & (some > 0)]
        single, pos, own = h[lone], at[lone], whose[lone]
        cut_m, cut_s = _bucket(marks, n), _bucket(single, n)
        parts: dict[int, list] = {}
        for b, s in _slices(cut_m):
            parts.setdefault(b, [slice(0, 0), slice(0, 0)])[0] = s
        for b, s in _slices(cut_s):
            parts.setdefault(b, [slice(0, 0), slice(0, 0)])[1] = s
        for b, (m, s) in parts.items():
            docs, which = np.unique(own[s], return_inverse=True)
            rows.append((b, 0, pack(marks[m].astype(np.uint32), single[s].astype(np.uint32), key[docs], narrow(which), narrow(pos[s]))))
        return rows

    def run(batches):
        names, held, keys, size, seen = [], [], [], 0, set()
        for batch in batches:
            for k1, k2, body in _docs(batch):
                if (k1, k2) in seen:
                    continue
                key = k1 ^ k2
                h, pos = plan.anchors(body, key)
                if h.size:
                    seen.add((k1, k2))
                    names.append(h)
                    held.append(pos)
                    keys.append(key)
                    size += h.size
                if size > FLUSH:
                    yield from _rows(settle(names, held, keys))
                    names, held, keys, size, seen = [], [], [], 0, set()
        if names:
            yield from _rows(settle(names, held, keys))

    return run


def anchor_meet(n: int) -> Callable:
    def run(batches):
        marks, single, key, pos = [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    g = unpack(blob)
                    yield from _rows([(int(np.mod(g[0][0], n)), 1, blob)])
                    continue
                m, s, docs, which, p = unpack(blob)
                marks.append(np.unique(m))
                single.append(s)
                key.append(docs[which])
                pos.append(p.astype(np.int64))
        if single:
            m, s, key, pos = np.unique(np.concatenate(marks)), np.concatenate(single), np.concatenate(key), np.concatenate(pos)
            order = np.lexsort((pos, key, s))
            s, key, pos = s[order], key[order], pos[order]
            again = np.zeros(s.size, bool)  # the same name at another place; a row met twice is no other place
            other = (s[1:] == s[:-1]) & ((key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))
            start, count = runs(s)
            if s.size:
                again = np.repeat(np.add.reduceat(np.r_[False, other], start, dtype=np.int64) > 0, count)
            if m.size:
                again |= m[np.minimum(np.searchsorted(m, s), m.size - 1)] == s
            yield from _rows(_replies(key[again], np.zeros(int(again.sum()), np.int64), pos[again], n))

    return run


def window_step(plan, n: int) -> Callable:
    def settle(names: list, held: list, keys: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
        h, pos = np.concatenate(names), np.concatenate(held)
        rank = np.empty(len(keys), np.int64)
        by_order = sorted(range(len(keys)), key=keys.__getitem__)
        rank[by_order] = np.arange(len(keys))
        k1, k2 = (np.array([keys[i][c] for i in by_order], np.int64) for c in (0, 1))
        own = np.repeat(rank, [x.size for x in names])
        names.clear()
        held.clear()
        order = np.lexsort((pos, own, h)) if plan.earliest else np.argsort(h)
        h, pos, own = h[order], pos[order], own[order]
        del order
        start, count = runs(h)
        many = count > 1
        gone = np.repeat(many, count)
        if plan.earliest:
            gone[start] = False
            marks, lone = h[:0], start
        else:
            marks, lone = h[start[many]], start[~many]
        rows = _replies(k1[own[gone]], k2[own[gone]], pos[gone], n)
        single, pos, own = h[lone], pos[lone], own[lone]
        parts: dict[int, list] = {}
        for b, s in _slices(_bucket(marks, n)):
            parts.setdefault(b, [slice(0, 0), slice(0, 0)])[0] = s
        for b, s in _slices(_bucket(single, n)):
            parts.setdefault(b, [slice(0, 0), slice(0, 0)])[1] = s
        for b, (m, s) in parts.items():
            order, docs, count, step = by_document(own[s], pos[s])
            rows.append((b, 0, pack(np.array([m.stop - m.start]), *squeeze(marks[m]), single[s][order], k1[docs], k2[docs], count, step)))
        return rows

    def run(batches):
        found, seen = _Found(), set()
        names, held, keys, size = [], [], [], 0
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for (k1, k2, body), kind, blob in zip(_docs(batch), kinds, batch.column(batch.schema.get_field_index("blob"))):
                if kind < 1:
                    if not kind:
                        found.add(blob.as_py())
                    elif kind == COPY:
                        seen.add((k1, k2))
                    continue
                at = found.of((k1 ^ k2, 0))
                if not at.size or (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                pos, h = plan.windows(body, k1 ^ k2, at)
                if h.size:
                    names.append(h)
                    held.append(pos)
                    keys.append((k1, k2))
                    size += h.size
                if size > FLUSH:
                    yield from _rows(settle(names, held, keys))
                    names, held, keys, size = [], [], [], 0
        if names:
            yield from _rows(settle(names, held, keys))

    return run


def window_meet(plan, n: int) -> Callable:
    def run(batches):
        marks, single, k1, k2, pos = [], [], [], [], []
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind:
                    yield from _rows([(bucket, 1, blob)])
                    continue
                many, first, m, s, a, b, count, step = unpack(blob)
                which, p = places(count, step)
                marks.append(unsqueeze(first, m, int(many[0])))
                single.append(s)
                k1.append(a[which])
                k2.append(b[which])
                pos.append(p)
        if not single:
            return
        marks, s, k1, k2, pos = np.unique(np.concatenate(marks)), *(np.concatenate(x) for x in (single, k1, k2, pos))
        order = np.argsort(s)
        start, count = runs(s[order])
        some = np.zeros(s.size, bool)
        some[order] = np.repeat(count > 1, count)
        if marks.size:
            some |= marks[np.minimum(np.searchsorted(marks, s), marks.size - 1)] == s
        s, k1, k2, pos = s[some], k1[some], k2[some], pos[some]
        if plan.earliest and s.size:
            order = np.lexsort((pos, k2, k1, s))
            s, k1, k2, pos = s[order], k1[order], k2[order], pos[order]
            later = np.r_[False, s[1:] == s[:-1]]
            k1, k2, pos = k1[later], k2[later], pos[later]
        yield from _rows(_replies(k1, k2, pos, n))

    return run


def cut_step(plan, columns: list[str], result: pa.Schema) -> Callable:
    def run(batches):
        found, whole = _Found(), set()
        for batch in batches:
            col = {x: batch.schema.get_field_index(x) for x in batch.schema.names}
            kinds = batch.column(col["kind"])
            held = pa.compute.equal(kinds, DOCUMENT)
            for (k1, k2, _), blob, kind in zip(_docs(batch), batch.column(col["blob"]), kinds.to_pylist()):
                if kind == REPLY:
                    found.add(blob.as_py())
                elif kind == COPY or kind == COPIED and not plan.earliest:
                    whole.add((k1, k2))
            part = batch.filter(held)
            if not part.num_rows:
                continue
            cuts = [plan.cut(body, found.of((k1, k2)), (k1, k2) in whole) for k1, k2, body in _docs(part)]
            own = [part.column(col[f"_{x}"]) for x in columns]
            own += [pa.array([x[k] for x in cuts], pa.int64()) for k in ("n", "n_removed", "n_spans")]
            own += [pa.array([hashlib.sha256(x["kept"]).hexdigest() for x in cuts], pa.string())]
            own += [pa.array([x["kept"] for x in cuts], pa.binary())] * ("kept" in result.names)
            yield pa.RecordBatch.from_arrays(own, schema=result)

    return run


def cut_repeats(docs: DataFrame, plan, *, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None, with_kept: bool = False) -> DataFrame:
    """Cut what repeats, as ``plan`` says, out of every text.

    Returns ``columns`` (by default the id alone) with n, n_removed, n_spans,
    kept_sha256 and, if asked for, kept (bytes).  A null text is empty; a null
    id comes after all others; rows equal in id and text are one document.
    Of ``columns``, those named like a result are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StringType, StructType

    spark = docs.sparkSession
    results = ("n", "n_words", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    columns = [id_column] if columns is None else [c for c in columns if c not in results]
    n = bucket_count(spark, text_bytes(docs, text_column))
    body = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    k1, k2 = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)), F.xxhash64(body)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), body.alias("body"), *[F.col(c).alias(f"_{c}") for c in columns])
    group = F.pmod(F.col("k1").bitwiseXOR(F.col("k2")), F.lit(n)).cast("int")

    bare = keyed.select("k1", "k2", "body")
    keys = bare.select("k1", "k2").distinct()
    groups = keys.groupBy("k2").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first <> last")
    copies = materialize(keys.join(groups, "k2").select("k1", "k2", F.when(F.col("k1") == F.col("first"), COPIED).otherwise(COPY).cast("tinyint").alias("kind")))

    def with_replies(replies: DataFrame, docs: DataFrame) -> DataFrame:
        own = docs.select(group.alias("bucket"), F.lit(DOCUMENT).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("blob"), *docs.columns)
        keyless = [F.lit(None).cast(x.dataType).alias(x.name) for x in docs.schema if x.name not in ("k1", "k2")]
        own = own.unionAll(copies.select(group.alias("bucket"), "kind", F.lit(None).cast("binary").alias("blob"), "k1", "k2", *keyless))
        none = [F.lit(0).cast("long").alias(x.name) if x.name in ("k1", "k2") else F.lit(None).cast(x.dataType).alias(x.name) for x in docs.schema]
        both = own.unionAll(replies.select("bucket", F.lit(REPLY).cast("tinyint").alias("kind"), "blob", *none))
        return both.repartitionById(n, F.col("bucket")).sortWithinPartitions("kind")

    anchors = bare.mapInArrow(lean(anchor_step(plan, n)), _SQL).repartitionById(n, F.col("bucket")).mapInArrow(lean(anchor_meet(n)), _SQL)
    windows = with_replies(anchors.select("bucket", "blob"), bare).mapInArrow(lean(window_step(plan, n)), _SQL).repartitionById(n, F.col("bucket")).mapInArrow(lean(window_meet(plan, n)), _SQL)
    # replies are small beside the texts: a task writes those of several buckets, one after another, to one file
    windows = materialize(windows.select("bucket", "blob").coalesce(-(-n // 3)))
    collect_garbage(spark)
    schema = StructType([docs.schema[c] for c in columns])
    for name, kind in (("n", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), *([("kept", BinaryType())] if with_kept else [])):
        schema = schema.add(name, kind)
    out = with_replies(windows, keyed).mapInArrow(lean(cut_step(plan, columns, to_arrow_schema(schema))), schema)
    return out if with_kept else out.coalesce(-(-n // 3))  # without texts, results are small too
