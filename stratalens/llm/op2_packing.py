"""Operator 2, harmonic packing.

The classes are the reciprocals 1/1, 1/2, 1/3 ... of the capacity.  What a
document leaves over its whole sequences has the class of the largest
reciprocal that holds it, and a bin of class 1/k takes exactly k documents.
The rest of such a bin waits for a filling: a whole document that fits, or, once
many bins wait, a part cut off the next one.  Every task fills bins of its own,
so nothing is shuffled; what is open at its end closes as bins of a power of
two.  No sequence needs padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import default_path, encoder

_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])


#: Numbers of documents that a bin takes: beyond 16 not each of them, so that bins of tiny documents fill up, too.
COUNTS = (*range(1, 17), 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Bins of a task that may wait for a document that fits.
WAITING = 64

#: A part of a document: its id, where the part starts, its ids, and how many the document has.
Piece = tuple[int | None, int, np.ndarray, int]


class Bins:
    """The bins of a task; closed ones become rows."""

    def __init__(self, capacity: int, first: int, with_ids: bool):
        self.capacity, self.next, self.with_ids = capacity, first, with_ids
        self.counts = [c for c in COUNTS if c <= capacity]
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[int] = []  # ascending, beside the bins they are in
        self.waiting: list[list[Piece]] = []
        self.rows: list[tuple] = []

    def close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, ids.size, zlib.crc32(ids), total, self.next, offset, *([ids.astype(np.int32)] if self.with_ids else [])))
            offset += ids.size
        self.next += 1

    def put(self, at: int, piece: Piece) -> None:
        """Into the waiting bin at a place of the list; it closes, or waits on with a smaller gap."""
        gap, held = self.gaps.pop(at) - piece[2].size, self.waiting.pop(at)
        held.append(piece)
        self.wait(gap, held)

    def wait(self, gap: int, held: list[Piece]) -> None:
        if gap:
            at = bisect_left(self.gaps, gap)
            self.gaps.insert(at, gap)
            self.waiting.insert(at, held)
        else:
            self.close(held)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = ids.size, 0
        while len(self.gaps) > WAITING and at < n:
            take = min(self.gaps[-1], n - at)
            self.put(len(self.gaps) - 1, (doc_id, at, ids[at : at + take].copy(), n))
            at += take
        while n - at >= self.capacity:
            self.close([(doc_id, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        if at < n:
            self.rest((doc_id, at, ids[at:].copy(), n))

    def rest(self, piece: Piece) -> None:
        fits = bisect_left(self.gaps, piece[2].size)
        if fits < len(self.gaps):
            self.put(fits, piece)
            return
        k = self.counts[bisect_right(self.counts, self.capacity // piece[2].size) - 1]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.open[k] = []
            self.wait(self.capacity - sum(x[2].size for x in held), held)

    def finish(self) -> None:
        """Fill waiting bins from open ones, and close all that is left as bins whose length is a power of two."""
        left = [x for _, held in sorted(self.open.items()) for x in held]
        while left and self.gaps:
            doc_id, start, ids, n = left.pop()
            take = min(self.gaps[-1], ids.size)
            self.put(len(self.gaps) - 1, (doc_id, start, ids[:take], n))
            if take < ids.size:
                left.append((doc_id, start + take, ids[take:], n))
        left += [x for held in self.waiting for x in held]
        total, size = sum(x[2].size for x in left), self.capacity
        while left:
            while size > total:
                size >>= 1
            room, held = size, []
            while room:
                doc_id, start, ids, n = left.pop()
                take = min(room, ids.size)
                held.append((doc_id, start, ids[:take], n))
                room -= take
                if take < ids.size:
                    left.append((doc_id, start + take, ids[take:], n))
            self.close(held)
            total -= size
        self.open, self.gaps, self.waiting = {}, [], []


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, *, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``capacity`` ids.

    A document's ids are those of its text (null: empty) and ``end_id``; each
    lies in exactly one piece.  Columns: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked for, ids.  Repeated rows are
    packed each; a null doc_id stays null; an empty table has no pieces.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA

    def run(batches):
        encode = encoder(tokenizer).many
        bins = Bins(capacity, TaskContext.get().partitionId() << 40, with_ids)
        end = np.array([end_id], "<u4")

        def drain():
            rows, bins.rows = bins.rows, []
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 20_000]), schema)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                bins.add(doc_id, np.concatenate([ids, end]))
            yield from drain()
        bins.finish()
        yield from drain()

    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(lean(run), names)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what the pipeline kept, with their ids."""
    return pack_documents(docs, default_path(), with_ids=True)
