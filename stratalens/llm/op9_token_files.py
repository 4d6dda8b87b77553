"""Operator 9, token-id output in adaptive context-mixing range-coded files.

A dataset is a folder of Parquet files whose rows are the blocks, in order:
``part`` and ``block`` number them, ``n_docs`` and ``n_tokens`` count what is
inside, and ``record`` is a self-contained binary block (see range_coder) of
ids, with the ids of its documents and their lengths before it.  Spark's
writer commits the files, so they land whole in any store that Spark writes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, lean, scratch, table, text_bytes
from .range_coder import decode_block, encode_block
from .tokens import default_path, encoder

#: Ids of a block, about; a longer document makes a longer block.
BLOCK = 2 << 20
_LAYOUT = "part int, block int, n_docs long, n_tokens long, record binary"
_ENTRY = struct.Struct("<4sII")


def seal(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: magic, number of documents, checksum of the directory, the directory, the coded ids."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    directory = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u4").tobytes()
    return _ENTRY.pack(b"TOK1", len(doc_ids), zlib.crc32(directory)) + directory + encode_block(ids, vocabulary)


def unseal(record: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block; ValueError if it is damaged."""
    magic, n, crc = _ENTRY.unpack_from(record)
    directory = record[_ENTRY.size : _ENTRY.size + 13 * n]
    if magic != b"TOK1" or zlib.crc32(directory) != crc:
        raise ValueError("not a block of token ids, or a damaged one")
    ids, known = np.frombuffer(directory, "<i8", n), np.frombuffer(directory, np.uint8, n, 8 * n)
    lengths = np.frombuffer(directory, "<u4", n, 9 * n).astype(np.int64)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], lengths, decode_block(record[_ENTRY.size + 13 * n :])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, *, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of every text (null: empty) and an end id, in ascending order of ids, null ones last.

    Rows with one id are ordered by a hash of their text; an empty table makes
    an empty dataset.
    """
    n = bucket_count(docs.sparkSession, text_bytes(docs, text_column))
    key = F.col(id_column).cast("long")
    order = [F.asc_nulls_last("doc_id"), F.asc("salt")]
    ranged = docs.select(key.alias("doc_id"), F.xxhash64(text_column).alias("salt"), F.col(text_column).alias("text"))
    ranged = ranged.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        tool = encoder(tokenizer)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0
        end = np.array([end_id], "<u4")

        def close():
            nonlocal doc_ids, held, size, block
            record = seal(doc_ids, [x.size for x in held], np.concatenate(held), max(tool.vocabulary, end_id + 1))
            row = [part, block, len(doc_ids), size, record]
            doc_ids, held, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "block", "n_docs", "n_tokens", "record"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), tool.many([x or "" for x in batch.column(2).to_pylist()])):
                ids = np.concatenate([own, end])
                doc_ids.append(doc_id)
                held.append(ids)
                size += ids.size
                if size >= BLOCK:
                    yield close()
        if doc_ids:
            yield close()

    ranged.mapInArrow(lean(run), _LAYOUT).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in a dataset.

    start counts the ids of all documents before it.  The sums run over parts
    and, within a part, over blocks; the columns beside the records are enough
    for that.
    """
    blocks = spark.read.schema(_LAYOUT).parquet(path)
    counts = blocks.select("part", "block", "n_tokens")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a part: as many as there were tasks
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "block", before.alias("inside")).join(parts.select("part", base.alias("base")), "part")
    starts = starts.select("part", "block", (F.col("base") + F.col("inside")).alias("start"))

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for batch in batches:
            for start, record in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, ids = unseal(record.as_py())
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                spans = list(zip((ends - lengths).tolist(), ends.tolist()))
                own = [doc_ids, (start + ends - lengths), lengths, [zlib.crc32(data[4 * s : 4 * e]) for s, e in spans]]
                own += [[ids[s:e].astype(np.int32) for s, e in spans]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, schema)], schema=schema)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return starts.join(blocks.select("part", "block", "record"), ["part", "block"]).select("start", "record").mapInArrow(lean(run), names)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/token_files_{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, default_path())
    return read_token_files(spark, path)
