"""A registry of what was ingested before, with Bloom filters beside it that say which buckets a lookup must read.

Rows lie in generations (one an append) and, within these, in buckets of their
key.  Beside a generation stands its filter: blocks of 512 bits, eight words of
64, and a key sets one bit in each word of one block.  A lookup meets the
filters first, about a byte and a half a key, and reads the rows of the buckets
only in which a key may be; what the filters let pass by chance goes at the
comparison of the keys themselves, so no answer rests on a filter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

WORDS = [f"w{i}" for i in range(8)]
#: Seeds of the three hashes of a key: its bucket, its block, its bits.
BUCKET, BLOCK, BITS = 1, 2, 3
GENERATIONS = "generation string, blocks long, n_rows long, replaces array<string>"


@dataclass
class Probe:
    """What the filters say: keys that may be there, and how many of the buckets hold any of them."""

    keys: DataFrame
    read: list[tuple[str, int]]
    buckets: int


class Registry:
    """A registry in the folder ``path``; ``create`` makes one.

    Appends don't touch each other and count from the moment they are recorded;
    one compaction may run at a time.  Rows whose key has a null are kept, and
    found by nobody.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        own = spark.read.parquet(f"{self.path}/layout").first()
        self.schema = StructType.fromJson(json.loads(own["schema"]))
        self.keys, self.buckets, self.bits = own["keys"], own["buckets"], own["bits"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], *, buckets: int = 64, bits: int = 12) -> Registry:
        """``bits`` of a filter a key: 12 let about one in two hundred foreign keys pass."""
        missing = set(keys) - set(schema.names)
        if missing or not keys:
            raise ValueError(f"keys must be columns of the registry: {sorted(missing)}")
        if buckets < 1 or bits < 1:
            raise ValueError("buckets and bits must be positive")
        path = path.rstrip("/")
        spark.createDataFrame([], GENERATIONS).write.mode("errorifexists").parquet(f"{path}/generations")
        spark.createDataFrame([(schema.json(), list(keys), buckets, bits)], "schema string, keys array<string>, buckets int, bits int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/layout")
        return cls(spark, path)

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in self.keys])

    def _bucket(self) -> Column:
        return F.pmod(self._hash(BUCKET), F.lit(self.buckets)).cast("int")

    def _bit(self, i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(self._hash(BITS), 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Keys in the registry's types, for hashes differ by type."""
        return rows.select(*[F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in self.keys])

    def generations(self) -> list:
        """Those that count: recorded, and not replaced by a compaction; one row an append since the last one."""
        every = self.spark.read.schema(GENERATIONS).parquet(f"{self.path}/generations").collect()
        gone = {g for r in every for g in r["replaces"]}
        return sorted((r for r in every if r["generation"] not in gone), key=lambda r: r["generation"])

    def append(self, rows: DataFrame) -> str:
        """Take rows in as a generation; returns its name.  A crash before the record leaves files that nothing names."""
        return self._write(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]), [])

    def compact(self) -> str | None:
        """Make one generation of all, so that a lookup asks one filter; returns its name, None where there is nothing to merge."""
        live = self.generations()
        if len(live) < 2:
            return None
        return self._write(self._rows([f"registry_generation={r['generation']}" for r in live]), [r["generation"] for r in live])

    def _write(self, rows: DataFrame, replaces: list[str]) -> str:
        name = f"g{uuid.uuid4().hex}"
        target = f"{self.path}/rows/registry_generation={name}"
        placed = rows.withColumn("registry_bucket", self._bucket()).hint("rebalance", "registry_bucket")  # a hot bucket goes to several tasks
        placed.write.mode("errorifexists").option("compression", "zstd").partitionBy("registry_bucket").parquet(target)
        own = self.spark.read.schema(rows.schema).parquet(target)
        n = own.count()
        blocks = max(1, -(-n * self.bits // (512 * self.buckets)))
        known = own.dropna(subset=list(self.keys)) if n else own
        at = known.select(self._bucket().alias("bucket"), F.pmod(self._hash(BLOCK), F.lit(blocks)).alias("block"), *[self._bit(i).alias(w) for i, w in enumerate(WORDS)])
        filters = at.groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])
        filters.write.mode("errorifexists").parquet(f"{self.path}/filters/{name}")
        self.spark.createDataFrame([(name, blocks, n, replaces)], GENERATIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
        return name

    def _rows(self, parts: Sequence[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows")
        return read.parquet(*[f"{self.path}/rows/{p}" for p in parts]).select(*[f"`{n}`" for n in self.schema.names])

    def probe(self, incoming: DataFrame) -> Probe:
        """Which keys of ``incoming`` may be in which bucket of which generation, by the filters alone."""
        live = [r for r in self.generations() if r["n_rows"]]
        asked = self._typed(incoming).dropna().distinct()
        found = None
        for r in live:
            at = asked.select("*", self._bucket().alias("bucket"), F.pmod(self._hash(BLOCK), F.lit(r["blocks"])).alias("block"))
            both = at.join(self.spark.read.parquet(f"{self.path}/filters/{r['generation']}"), ["bucket", "block"])
            for i, w in enumerate(WORDS):
                both = both.where(F.col(w).bitwiseAND(self._bit(i)) != 0)
            one = both.select(*self.keys, F.lit(r["generation"]).alias("registry_generation"), F.col("bucket").alias("registry_bucket"))
            found = one if found is None else found.unionAll(one)
        if found is None:
            found = asked.limit(0).select("*", F.lit("").alias("registry_generation"), F.lit(0).alias("registry_bucket"))
        found = materialize(found)
        held = found.select("registry_generation", "registry_bucket").distinct().collect()  # generations times buckets at most
        return Probe(found, sorted((r[0], r[1]) for r in held), len(live) * self.buckets)

    def matching(self, incoming: DataFrame) -> DataFrame:
        """The registry's rows in buckets that may hold a key of ``incoming``: all rows of equal keys, and some others."""
        return self._rows([f"registry_generation={g}/registry_bucket={b}" for g, b in self.probe(incoming).read])

    def unseen(self, incoming: DataFrame) -> DataFrame:
        """Rows of ``incoming`` whose key the registry doesn't hold; a key with a null is one of them."""
        names = {k: f"registry_{i}" for i, k in enumerate(self.keys)}
        seen = self.matching(incoming).select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()])
        same = [F.col(f"`{k}`").cast(self.schema[k].dataType) == F.col(n) for k, n in names.items()]
        return incoming.join(seen, same, "left_anti")
