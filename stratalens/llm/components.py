"""Connected components of a table of links, in rounds of large and small stars.

Each round keeps at most the rows it was given and hangs every node on a
smaller neighbour; hot centres are met by joins that Spark may split, after
sums on the side of the writers.  Nothing is collected but one row of checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    hung = both.where("v > u").join(_least(both), "u")
    return hung.select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) of longs to rows (node, root), root the smallest node of the component.

    Loops and repeated links count once; rows with a null end are no links;
    an empty table has no components.
    """
    now = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    check = None
    for _ in range(rounds):
        fresh = materialize(_small(_large(now).where("a <> b").distinct()).where("a <> b").distinct())
        release(now)
        now = fresh
        row = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == check:
            break
        check = tuple(row)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(roots)
    out.stored_at = now.stored_at
    return out
