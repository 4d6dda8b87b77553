"""Column groups of one table in matching buckets, so that they are stitched where they lie.

Each group is a bucketed table over its own folder, clustered and sorted by the
position of a row.  Groups of one layout have equal rows in equal buckets, and
Spark joins them bucket by bucket without an exchange, reading the groups that
a query names and no others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class ColumnGroups:
    """The groups under ``path``; ``create`` fixes their keys and the number of buckets.

    ``keys`` name a row (group and position); buckets are even, whatever the
    sizes of the groups.  The catalogue knows a group by the path's hash; a
    session that doesn't know it yet is told from the files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        own = spark.read.parquet(f"{self.path}/layout").first()
        self.keys, self.buckets = own["keys"], own["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: Sequence[str] = ("group_id", "row_number"), buckets: int = 64) -> ColumnGroups:
        if not keys or buckets < 1:
            raise ValueError("a layout needs keys and buckets")
        spark.createDataFrame([(list(keys), buckets)], "keys array<string>, buckets int").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/layout")
        return cls(spark, path)

    def _name(self, group: str) -> str:
        if not group.isidentifier() or group == "layout":
            raise ValueError(f"not the name of a group: {group!r}")
        return f"groups_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{group.lower()}"

    def write(self, group: str, rows: DataFrame, *, append: bool = False) -> None:
        """Write a group, or add the rows of new files to it: one file a bucket and write, each by one task."""
        name = self._name(group)
        if append:
            self._known(group)
        placed = rows.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        out = placed.write.mode("append" if append else "errorifexists").option("compression", "zstd").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        out.option("path", f"{self.path}/{group}").format("parquet").saveAsTable(name)

    def _known(self, group: str) -> str:
        name = self._name(group)
        if not self.spark.catalog.tableExists(name):
            quoted = lambda n: "`" + n.replace("`", "``") + "`"
            where = f"{self.path}/{group}"
            columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in self.spark.read.parquet(where).schema)
            by = ", ".join(quoted(k) for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def read(self, group: str) -> DataFrame:
        return self.spark.table(self._known(group))

    def stitch(self, core: str, *groups: str, how: str = "inner") -> DataFrame:
        """Rows of ``core`` with the columns of the other groups; ``left`` keeps those that a group lacks."""
        if how not in ("inner", "left"):
            raise ValueError("how must be inner or left")
        out = self.read(core)
        for g in groups:
            out = out.join(self.read(g).hint("merge"), self.keys, how)  # a merge of buckets: nothing is sent or hashed
        return out

    def drop(self, group: str) -> None:
        """Forget a group; its files stay for the collection of garbage."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(group)}")
