"""What the corpus operators share: tables, shared storage, packed blobs.

Operators written with Arrow functions exchange *packed* rows: one row per
(batch, bucket) that carries numpy arrays as bytes.  A bucket is a partition
chosen by ``repartitionById``; the number of buckets follows the number of
input bytes, so that what a task holds stays the same at every size.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes that one packed bucket stands for.
BUCKET_BYTES = 16 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once, unless their path holds it already."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="stratalens-")) / "stratalens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "stratalens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


@lru_cache(maxsize=1)
def _allocator() -> object | None:
    """The C library, told to hand arrays of a megabyte or more back to the system as soon as they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; set, it no longer grows with what is freed
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):
        return None  # another C library: memory stays with the worker, nothing else changes


def give_back() -> None:
    """Return freed memory to the system; a worker lives on after its task, beside the next ones."""
    pa.default_memory_pool().release_unused()
    if _allocator():
        _allocator().malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches, for mapInArrow, that gives back its memory at its end; the session gets what such functions need."""
    session = SparkSession.getActiveSession()
    if session is not None:
        prepare(session)

    def wrapped(batches):
        _allocator()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Bytes of an Arrow batch on its way to Python, at most, where the session doesn't say: rows can be very long.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What Python operators need of a session: this package on its workers, and batches bounded by bytes."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", "268435456", "256MB", "256m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def clash_free(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose own columns can't clash with those of its documents; what it returns has the columns of docs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        known = ("doc_id", "text", "lang", "source", "n_chars")
        own = {c: c if c in known else f"extra_column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]), sf_dir)
        return out.select(*[F.col(x).alias(c) for c, x in own.items()])

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = current or tempfile.mkdtemp(prefix="stratalens-")
        if not current:
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one, deleted when the driver ends in good order."""
    own = spark.sparkContext.applicationId
    if own not in _SCRATCH:
        _SCRATCH[own] = path = f"{shared_dir(spark)}/tables/{own}"

        def tidy() -> None:
            if SparkSession.getActiveSession() is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)

        atexit.register(tidy)
    return _SCRATCH[own]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back; what is left of such tables goes with the application."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*stored: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more, and let Spark drop dead shuffles."""
    for df in stored:
        spark, path = df.sparkSession, getattr(df, "stored_at", None)
        if path:
            remove(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files live until the driver notices that their plans are gone; make it look now."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside the driver


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, total_bytes: int | None, per: int = BUCKET_BYTES) -> int:
    """Buckets for so many input bytes: at least one for each shuffle partition."""
    return max(shuffle_partitions(spark), math.ceil((total_bytes or 0) / per), 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay within the limit; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: a count, then dtype code, length and data of each."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = blob[0], 1, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", blob, at)
        at += 10
        kind = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds these values."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not sorted_values.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return start, np.diff(np.r_[start, sorted_values.size])
