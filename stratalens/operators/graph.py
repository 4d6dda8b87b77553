"""Graph tables: stitching, incremental appends, manifests, compaction, collection, edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import with_rank
from ..streaming.folds import fold_by_key


def with_provenance(df: DataFrame) -> DataFrame:
    """File name and physical row position; stays right under filters."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_number"))


def stitch(core: DataFrame, *groups: DataFrame, on: tuple[str, ...] = ("group_id", "row_number")) -> DataFrame:
    """Column groups joined by position."""
    for g in groups:
        core = core.join(g, list(on))
    return core


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that takes both: text if one is, the wider of two integers, else the first."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if type(a) in order and type(b) in order:
        return max(a, b, key=lambda x: order.index(type(x)))
    return a


def append_by_name(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null, types are promoted before the union."""
    for f in base.schema:
        if f.name in fresh.columns:
            to = promoted(f.dataType, fresh.schema[f.name].dataType)
            base, fresh = base.withColumn(f.name, F.col(f.name).cast(to)), fresh.withColumn(f.name, F.col(f.name).cast(to))
    return base.unionByName(fresh, allowMissingColumns=True)


def since_latest_compaction(runs: DataFrame) -> DataFrame:
    """Runs (completed_at, is_compaction) from the latest compaction on; all if there was none."""
    cut = runs.agg(F.max(F.when(F.col("is_compaction"), F.col("completed_at"))).alias("cut"))
    return runs.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col("completed_at") >= F.col("cut"))).drop("cut")


def manifest_fingerprint(entries: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: sha256 over the digests of 4,096 buckets, each that of its sorted key:digest lines.

    A line's bucket is the beginning of its own hash, so no task sorts more
    than a bucket; the order of rows doesn't matter, any change does.
    """
    line = F.concat_ws(":", F.col(key).cast("string"), digest)
    lines = entries.select(line.alias("line")).withColumn("bucket", F.substring(F.sha2("line", 256), 1, 3))
    sums = lines.groupBy("bucket").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("line"))), 256).alias("sum"))
    return sums.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "sum"))), lambda x: x["sum"])), 256).alias("fingerprint"))


def successors(df: DataFrame, group: str, order: str, node: str) -> DataFrame:
    """Edges from each node to the next one of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("dst", F.lead(node).over(w)).where("dst is not null").select(group, F.col(node).alias("src"), "dst")


def first_fit_batches(groups: DataFrame, by: str, order: str, size: str, *, low: float, high: float, most: int, **longest: int) -> DataFrame:
    """Batches in order of runs: closed before a group that would pass ``high`` or the count, and once they reach ``low``."""

    def step(state, row):
        total, count = state or (0.0, 0)
        if count and (total + row[size] > high or count >= most):
            total, count = 0.0, 0
        opens, total = not count, total + row[size]
        return ((0.0, 0) if total >= low else (total, count + 1)), opens

    return fold_by_key(groups, by, [order], step, "batch", "long", counted=True, uses=[size], **longest)


def keep_set(manifests: DataFrame, *, since: Column, compactions: int, latest: int) -> DataFrame:
    """Manifests that a collection keeps: recent ones, the newest compactions, the newest of all."""
    newest = [F.desc("completed_at"), F.desc("run_id")]
    few = manifests.where("is_compaction").orderBy(*newest).limit(compactions).select("run_id")
    few = few.unionAll(manifests.orderBy(*newest).limit(latest).select("run_id")).distinct().withColumn("_kept", F.lit(True))
    # compactions + latest rows at most: a bound for the broadcast
    marked = manifests.join(F.broadcast(few), "run_id", "left")
    return marked.where((F.col("completed_at") >= since) | F.col("_kept")).select(*manifests.columns)


def even_positions(total: int, limit: int) -> list[int]:
    """Evenly spaced positions, rounded half to even, then the first free ones."""
    if total <= 0 or limit <= 0:
        return []
    if total <= limit or limit == 1:
        return list(range(min(total, limit)))
    spaced = list(dict.fromkeys(round(i * (total - 1) / (limit - 1)) for i in range(limit)))
    free = (i for i in range(total) if i not in set(spaced))
    return spaced + [next(free) for _ in range(limit - len(spaced))]


def rollout_stages(ids: DataFrame, key: str, percents: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """The stage of each device: cumulative shares, rounded up, of the sorted ids."""
    total = ids.agg(F.count("*").alias("_n"))
    placed = with_rank(ids, key, name="_rn").crossJoin(F.broadcast(total))  # one row
    stage = F.lit(None).cast("long")
    for i, p in reversed(list(enumerate(percents, 1))):
        stage = F.when(F.col("_rn") <= F.ceil(F.lit(p) * F.col("_n") / 100), F.lit(i).cast("long")).otherwise(stage)
    return placed.withColumn("stage", stage).drop("_rn", "_n")


def ceil_share(percent: float, total: int) -> int:
    return math.ceil(percent / 100 * total)
