"""Session settings that results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(name: str = "stratalens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder."""
    path = fresh_path(df.sparkSession, "stratalens_tables")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in the order of all rows; no task sees more than a range of them.

    Ranges are sorted and written once; their sizes, one row a range, give
    what stands before each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running(df: DataFrame, keys: list[str], order: list[Column | str], ranges: int | None = None, **measures: tuple[str, Column]) -> DataFrame:
    """df with what comes before each row of its key, in order: ("max", c) the largest c, ("sum", c) their sum; null where nothing does.

    Tasks are ranges of (keys, order), so a key may span several: what a range
    holds of a key is added up, and what the ranges before hold is carried to
    it.  Keys that span ranges are no more than twice as many as ranges.
    """
    how = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))}
    names = df.columns
    placed = df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order)
    inputs = [c.alias(f"_in_{n}") for n, (_, c) in measures.items()]
    at = materialize(placed.select("*", *inputs, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = at.groupBy(*keys, "_part").agg(*[how[kind][0](f"_in_{n}").alias(f"_all_{n}") for n, (kind, _) in measures.items()])
    along = Window.partitionBy(*keys).orderBy("_part")
    carried = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), F.count("*").over(Window.partitionBy(*keys)).alias("_many"), *[how[kind][0](f"_all_{n}").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_far_{n}") for n, (kind, _) in measures.items()])
    carried = carried.where("_many > 1").drop("_many")
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    local = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = at.join(F.broadcast(carried), same, "left")
    near = both.select("*", *[how[kind][0](f"_in_{n}").over(local).alias(f"_near_{n}") for n, (kind, _) in measures.items()])
    return near.select(*names, *[how[kind][1](F.col(f"_far_{n}"), F.col(f"_near_{n}")).alias(n) for n, (kind, _) in measures.items()])
