"""Versioned snapshots: a log of file lists, committed optimistically.

A snapshot is a set of tables.  Its data files never change; each version is
one small file of the log that says which files it adds and removes, so an
append writes its own rows and nothing else.  A commit takes the next free
number by a rename (in a local folder: a link) that refuses to overwrite; a
writer that finds it taken looks at what won: if both took in the same manifest, or removed the same file,
it fails, else it tries the number after.  Which files are live is worked out
by Spark from the last checkpoint and the versions after it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, StructField, StructType, TimestampType

#: An action of the log.
ACTION = "version long, op string, `table` string, uri string, n_rows long, n_bytes long, low map<string,long>, high map<string,long>, schema string, manifests array<string>, id string"
#: Versions between two checkpoints.
CHECKPOINT_EVERY = 10


class CommitConflict(RuntimeError):
    """Another writer took in the same manifests, or removed the same files."""


def _ordinal(name: str, kind: object) -> Column | None:
    """A whole number by which a column's files can be told apart; None for columns of other types."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return c.cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    return F.unix_micros(c) if isinstance(kind, TimestampType) else None


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """Columns by name: those of old, then what new adds; a column's type can't change."""
    fields = [StructField(f.name, f.dataType, True) for f in (old.fields if old else [])]
    known = {f.name: f.dataType for f in fields}
    for f in new.fields:
        if f.name not in known:
            fields.append(StructField(f.name, f.dataType, True))
        elif known[f.name] != f.dataType:
            raise TypeError(f"column {f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return StructType(fields)


class SnapshotLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files: dict[int, DataFrame] = {}  # of versions, which never change
        self._schemas: dict[int, dict[str, StructType]] = {}

    # --- files of the log

    def _at(self, *parts: str):
        return self._paths.Path("/".join([self.path, "_log", *parts]))

    def _names(self) -> list[str]:
        folder = self._at()
        fs = folder.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self) -> int:
        """The newest version; -1 if nothing was committed."""
        return max((int(n[:-5]) for n in self._names() if n.endswith(".json")), default=-1)

    def _put(self, version: int, actions: list[dict], commit: str) -> bool:
        """Write a version, unless there is one of that number."""
        target, draft = self._at(f"{version:020d}.json"), self._at("drafts", commit)
        fs = target.getFileSystem(self._conf)
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(json.dumps({"version": version, **a}, sort_keys=True) for a in actions).encode()))
        out.close()
        never = self.spark._sc._gateway.new_array(getattr(self._paths, "Options$Rename"), 0)
        try:
            if fs.getUri().getScheme() == "file":  # there a rename looks first and moves then, so two writers may both win; a link is made once
                local = lambda p: self.spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(local(target), local(draft))
                fs.delete(draft, False)
            else:
                self._paths.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self._conf).rename(draft, target, never)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                fs.delete(draft, False)
                return False
            raise
        return True

    def actions(self, version: int | None = None) -> DataFrame:
        """The log up to a version: the live files of the last checkpoint, then every action after it."""
        names = self._names()
        last = self.version() if version is None else version
        marks = [int(n.split(".")[0]) for n in names if n.endswith(".checkpoint")]
        mark = max((m for m in marks if m <= last and self._complete(m)), default=-1)
        files = [str(self._at(n)) for n in names if n.endswith(".json") and mark < int(n[:-5]) <= last]
        out = self.spark.read.schema(ACTION).parquet(str(self._at(f"{mark:020d}.checkpoint"))) if mark >= 0 else self.spark.createDataFrame([], ACTION)
        return out.unionByName(self.spark.read.schema(ACTION).json(files)) if files else out

    def _complete(self, mark: int) -> bool:
        done = self._at(f"{mark:020d}.checkpoint", "_SUCCESS")
        return done.getFileSystem(self._conf).exists(done)

    # --- what a version holds

    def files(self, version: int | None = None) -> DataFrame:
        """Live files: table, uri, n_rows, n_bytes, low and high of whole-number columns."""
        at = self.version() if version is None else version
        if at not in self._files:
            of_files = self.actions(at).where("uri is not null")
            last = of_files.groupBy("table", "uri").agg(F.max_by(F.struct("op", "version", "n_rows", "n_bytes", "low", "high"), "version").alias("a"))
            self._files[at] = last.where("a.op = 'add'").select("table", "uri", "a.*").drop("op").cache()
        return self._files[at]

    def manifests(self, version: int | None = None) -> DataFrame:
        """Manifests that were taken in: manifest, and the version that did."""
        return self.actions(version).where("op = 'commit'").select(F.explode("manifests").alias("manifest"), "version")

    def schema(self, table: str, version: int | None = None) -> StructType | None:
        """A table's columns; None if a version has no such table."""
        at = self.version() if version is None else version
        if at not in self._schemas:
            found = self.actions(at).where("op = 'schema'").groupBy("table").agg(F.max_by("schema", "version").alias("s")).collect()  # a row a table
            self._schemas[at] = {r["table"]: StructType.fromJson(json.loads(r["s"])) for r in found}
        return self._schemas[at].get(table)

    def pruned(self, table: str, version: int | None = None, **bounds: tuple[int | None, int | None] | Iterable[int]) -> DataFrame:
        """Live files of a table that may hold rows within bounds: a pair (low, high) or a list of values by column."""
        found = self.files(version).where(F.col("table") == table)
        for name, wanted in bounds.items():
            low, high = F.try_element_at("low", F.lit(name)), F.try_element_at("high", F.lit(name))
            if isinstance(wanted, tuple):
                least, most = wanted
                inside = (F.lit(True) if most is None else low <= most) & (F.lit(True) if least is None else high >= least)
            else:
                inside = F.exists(F.array(*[F.lit(int(x)).cast("long") for x in wanted]).cast("array<bigint>"), lambda x: (x >= low) & (x <= high))
            found = found.where(F.coalesce(inside, F.lit(True)))
        return found

    def read(self, table: str, version: int | None = None, **bounds: tuple[int | None, int | None] | Iterable[int]) -> DataFrame:
        """A table of a version, by its own files only, with nulls for columns that a file lacks; bounds leave out files, not rows."""
        schema = self.schema(table, version)
        if schema is None:
            raise ValueError(f"no table {table}")
        uris = [r["uri"] for r in self.pruned(table, version, **bounds).select("uri").collect()]  # what a reader lists anyway
        return self.spark.read.schema(schema).parquet(*uris) if uris else self.spark.createDataFrame([], schema)

    # --- commits

    def write(self, table: str, rows: DataFrame, commit: str) -> list[dict]:
        """Write data files, and the actions that add them; nothing shows before these are committed."""
        folder = f"{self.path}/data/{commit}/{table}"
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(folder)
        ordinals = {f.name: o for f in rows.schema.fields if (o := _ordinal(f.name, f.dataType)) is not None}
        by_file = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("n_bytes"))
        found = by_file.agg(F.count("*").alias("n_rows"), *[f(o).alias(f"{kind}_{i}") for i, o in enumerate(ordinals.values()) for kind, f in (("low", F.min), ("high", F.max))])
        out = []
        for r in found.collect():  # one row a file that this commit wrote
            ranges = {kind: {n: r[f"{kind}_{i}"] for i, n in enumerate(ordinals) if r[f"{kind}_{i}"] is not None} for kind in ("low", "high")}
            out.append({"op": "add", "table": table, "uri": r["uri"], "n_rows": r["n_rows"], "n_bytes": r["n_bytes"], **ranges})
        return out

    def commit(self, added: list[dict], removed: Sequence[tuple[str, str]] = (), *, manifests: Sequence[str] = (), schemas: Mapping[str, StructType] | None = None, read_version: int | None = None, commit: str | None = None) -> int:
        """Make files live, and others dead, in one version; the version's number.

        ``read_version`` is what the writer looked at.  Versions committed
        since then are compared with this one, and so is each that wins the
        number meanwhile.
        """
        commit = commit or uuid.uuid4().hex
        seen = self.version() if read_version is None else read_version
        actions = [*added, *({"op": "remove", "table": t, "uri": u} for t, u in removed), {"op": "commit", "manifests": sorted(manifests), "id": commit}]
        while True:
            newest = self.version()
            if newest > seen:
                self._check(seen, newest, {u for _, u in removed}, set(manifests))
                seen = newest
            known = {t: self.schema(t) for t in schemas or {}}
            told = [{"op": "schema", "table": t, "schema": merged_schema(known[t], s).json()} for t, s in (schemas or {}).items() if known[t] is None or merged_schema(known[t], s) != known[t]]
            if self._put(newest + 1, [*actions, *told], commit):
                if (newest + 1) % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
                    self.checkpoint(newest + 1)
                return newest + 1
            time.sleep(0.05)

    def _check(self, after: int, upto: int, removed: set[str], manifests: set[str]) -> None:
        since = self.actions(upto).where(F.col("version") > after)
        if removed and since.where((F.col("op") == "remove") & F.col("uri").isin(list(removed))).limit(1).collect():
            raise CommitConflict("another writer removed one of these files")
        if manifests and since.where(F.arrays_overlap("manifests", F.array(*[F.lit(m) for m in sorted(manifests)]))).limit(1).collect():
            raise CommitConflict("another writer took in one of these manifests")

    def checkpoint(self, version: int) -> None:
        """The live files, manifests and schemas of a version as one table, so that readers need no version before it."""
        kept = self.actions(version)
        files = self.files(version).select("table", "uri", F.lit("add").alias("op"), "version", "n_rows", "n_bytes", "low", "high")
        schemas = kept.where("op = 'schema'").groupBy("table").agg(F.max_by("schema", "version").alias("schema"), F.max("version").alias("version")).withColumn("op", F.lit("schema"))
        commits = kept.where("op = 'commit'").select("op", "version", "manifests", "id")
        empty = self.spark.createDataFrame([], ACTION)
        every = empty.unionByName(files, True).unionByName(schemas, True).unionByName(commits, True)
        every.write.mode("overwrite").parquet(str(self._at(f"{version:020d}.checkpoint")))

    def append(self, tables: Mapping[str, DataFrame], manifests: Sequence[str] = (), *, read_version: int | None = None) -> int | None:
        """Add rows to tables in one version, by name; None if every manifest was taken in before.

        Rows come with ``_manifest`` where manifests are given, and those of
        known ones are left out, so that a repeated append adds nothing.
        """
        seen = self.version() if read_version is None else read_version
        fresh = list(manifests)
        if manifests:
            asked = self.spark.createDataFrame([(m,) for m in dict.fromkeys(manifests)], "manifest string")
            fresh = sorted(r["manifest"] for r in asked.join(self.manifests(seen).select("manifest").distinct(), "manifest", "left_anti").collect())
            if not fresh:
                return None
        commit, added, schemas = uuid.uuid4().hex, [], {}
        wanted = self.spark.createDataFrame([(m,) for m in fresh], "_manifest string")
        for name, rows in tables.items():
            own = rows.join(F.broadcast(wanted), "_manifest", "left_semi").drop("_manifest") if manifests else rows
            schemas[name] = own.schema
            added += self.write(name, own, commit)
        return self.commit(added, manifests=fresh, schemas=schemas, read_version=seen, commit=commit)

    def replace(self, table: str, rows: DataFrame, files: DataFrame, *, read_version: int | None = None) -> int:
        """Rows in place of the files (uri) that they were made from, in one version; readers of older versions still see those."""
        seen = self.version() if read_version is None else read_version
        commit, gone = uuid.uuid4().hex, [(table, r["uri"]) for r in files.select("uri").collect()]
        return self.commit(self.write(table, rows, commit), gone, schemas={table: rows.schema}, read_version=seen, commit=commit)

    def dead_files(self, keep: int = 1) -> DataFrame:
        """Data files (uri, length) that no one of the last ``keep`` versions reads, for collect_files; drafts of running writers are among them."""
        last = self.version()
        live = None
        for v in range(max(0, last - keep + 1), last + 1):
            own = self.files(v).select("uri")
            live = own if live is None else live.unionAll(own)
        held = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/data").select(F.col("path").alias("uri"), "length")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        return held.join(live.select(plain("uri").alias("_live")).distinct(), plain("uri") == F.col("_live"), "left_anti") if live is not None else held
