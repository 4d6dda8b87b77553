"""Upkeep of graph tables: compaction, collection, snapshots and their reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.snapshots import SnapshotLog
from ..streaming.folds import fold_by_key
from .control import build_decision
from .graph import append_by_name, first_fit_batches

# The column groups of vertices and edges.
VERTEX_KINDS = ("core", "text", "vector")
EDGE_KINDS = ("adj_list",)


class RowCountError(RuntimeError):
    """Rows got lost or doubled on their way into another file."""


# --- compaction


def compaction_groups(files: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Files (entity, run_id, kind, uri, rows, bytes) as groups (entity, run_id) that hold all kinds of their entity.

    ``size`` is the bytes of a group's largest kind, by which batches are cut.
    """
    wanted = F.create_map(*[x for e, ks in kinds.items() for x in (F.lit(e), F.lit(len(set(ks))))])
    listed = F.lit(False)
    for entity, ks in kinds.items():
        listed = listed | ((F.col("entity") == entity) & F.col("kind").isin(list(ks)))
    per_kind = files.where(listed).groupBy("entity", "run_id", "kind").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    groups = per_kind.groupBy("entity", "run_id").agg(F.count("*").alias("n_kinds"), F.max("bytes").alias("size"))
    return groups.where(F.col("n_kinds") == F.try_element_at(wanted, F.col("entity"))).select("entity", "run_id", "size")


def plan_compaction(files: DataFrame, kinds: Mapping[str, Sequence[str]], *, low: float, high: float, most: int) -> DataFrame:
    """(entity, run_id, size, batch) of every group that takes part."""
    return first_fit_batches(compaction_groups(files, kinds), "entity", "run_id", "size", low=low, high=high, most=most)


def batch_totals(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files, bytes and rows of each batch and kind."""
    both = files.join(plan.select("entity", "run_id", "batch"), ["entity", "run_id"])
    return both.groupBy("entity", "batch", "kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def counts_by_entity(totals: DataFrame) -> DataFrame:
    """Rows of each entity, counted by its core (vertices) or adjacency (edges) files."""
    return totals.where(F.col("kind").isin("core", "adj_list")).groupBy("entity").agg(F.sum("rows").alias("rows"))


def compact(spark: SparkSession, files: DataFrame, kinds: Mapping[str, Sequence[str]], root: str, run_id: str, *, low: float, high: float, most: int) -> DataFrame:
    """Write every batch of every entity and kind as one file and return the audit: entity, kind, batch, rows_in, rows_out, uri.

    Rows keep the order of their files, so column groups still match by
    position.  One job an entity and kind, whatever the number of batches;
    strict: rows that differ in number raise RowCountError.
    """
    plan = materialize(plan_compaction(files, kinds, low=low, high=high, most=most))
    audits = None
    for entity in sorted(kinds):
        for kind in kinds[entity]:
            own = files.where((F.col("entity") == entity) & (F.col("kind") == kind)).join(plan, ["entity", "run_id"])
            placed = own.select("uri", "rows", "batch", F.dense_rank().over(Window.partitionBy("batch").orderBy("run_id", "uri")).alias("_order"))
            uris = [r["uri"] for r in placed.select("uri").collect()]  # files of one kind: what a reader lists anyway
            if not uris:
                continue
            rows = spark.read.option("mergeSchema", True).parquet(*uris)
            names = rows.columns
            at = rows.select("*", plain_uri(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
            by_file = placed.select(plain_uri(F.col("uri")).alias("_file"), "batch", "_order")
            moved = at.join(by_file, "_file").repartition("batch").sortWithinPartitions("batch", "_order", "_row")
            target = f"{root.rstrip('/')}/{'edges' if kind in EDGE_KINDS else 'vertices'}/{entity}/{kind}/{run_id}"
            moved.select("batch", *names).write.mode("errorifexists").option("compression", "zstd").partitionBy("batch").parquet(target)
            written = spark.read.parquet(target).groupBy("batch").agg(F.count("*").alias("rows_out"), F.min("_metadata.file_path").alias("uri"))
            before = placed.groupBy("batch").agg(F.sum("rows").alias("rows_in"))
            part = before.join(written, "batch", "full_outer").select(F.lit(entity).alias("entity"), F.lit(kind).alias("kind"), "batch", "rows_in", "rows_out", "uri")
            audits = part if audits is None else audits.unionAll(part)
    if audits is None:
        return spark.createDataFrame([], "entity string, kind string, batch long, rows_in long, rows_out long, uri string")
    audits = materialize(audits)
    wrong = audits.where(~F.col("rows_in").eqNullSafe(F.col("rows_out"))).limit(1).collect()
    if wrong:
        raise RowCountError(f"{wrong[0].entity}/{wrong[0].kind} batch {wrong[0].batch}: {wrong[0].rows_in} rows in, {wrong[0].rows_out} out")
    return audits


def compaction_audit(audits: DataFrame, path: str, header: dict) -> None:
    """JSON lines: a header, then one line a batch."""
    first = audits.sparkSession.createDataFrame([(0, json.dumps(header, sort_keys=True))], "_o int, value string")
    lines = first.unionAll(audits.select(F.lit(1), F.to_json(F.struct(*sorted(audits.columns)))))
    lines.orderBy("_o", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


# --- audit logs


def audit_batches(files: DataFrame, *, by: str, min_age_s: float, now: float, low: int, high: int, most_files: int, most_batches: int) -> DataFrame:
    """Batches of log files (uri, bytes, mtime in seconds) that are old enough, two files at least each.

    Files go oldest first; a batch closes before it would pass ``high`` or the
    number of files, and once it reaches ``low``.  ``by`` is the log a file
    belongs to.
    """

    def step(state, row):
        total, count = state or (0, 0)
        if count and (total + row["bytes"] > high or count >= most_files):
            total, count = 0, 0
        opens, total = not count, total + row["bytes"]
        return ((0, 0) if total >= low or count + 1 >= most_files else (total, count + 1)), opens

    if most_batches <= 0 or most_files < 2:
        return files.withColumn("batch", F.lit(None).cast("long")).where(F.lit(False))
    old = files.where(F.coalesce(F.lit(now) - F.col("mtime") >= min_age_s, F.lit(True))).withColumn("_mtime", F.coalesce("mtime", F.lit(0.0)))
    cut = fold_by_key(old, by, ["_mtime", "bytes", "uri"], step, "_batch", "long", counted=True, uses=["bytes"]).drop("_mtime")
    sizes = cut.groupBy(by, "_batch").agg(F.count("*").alias("_n")).where("_n > 1")
    placed = sizes.withColumn("batch", F.row_number().over(Window.partitionBy(by).orderBy("_batch")).cast("long") - 1).where(F.col("batch") < most_batches)
    return cut.join(placed.select(by, "_batch", "batch"), [by, "_batch"]).drop("_batch")


def compact_audit_logs(spark: SparkSession, batches: DataFrame, root: str) -> tuple[list[dict], list[dict]]:
    """Write each batch of log files as one file; (done, failed), one record a batch, so that one bad batch stops no other."""
    listed = batches.groupBy("batch").agg(F.sort_array(F.collect_list("uri")).alias("uris")).orderBy("batch").collect()  # most_batches rows at most
    done, failed = [], []
    for row in listed:
        try:
            rows = spark.read.option("mergeSchema", True).parquet(*row.uris)
            target = f"{root.rstrip('/')}/batch-{row.batch:05d}"
            rows.coalesce(1).write.mode("errorifexists").option("compression", "zstd").parquet(target)
            before, after = rows.count(), spark.read.parquet(target).count()
            if before != after:
                raise RowCountError(f"{before} rows in, {after} out")
            done.append({"batch": row.batch, "files": len(row.uris), "rows": after, "uri": target})
        except Exception as e:  # recorded, not hidden: the caller gets it back
            failed.append({"batch": row.batch, "error": str(e).splitlines()[0]})
    return done, failed


# --- collection


def plain_uri(uri: Column) -> Column:
    """A path without its file scheme, so that one file has one name."""
    return F.regexp_replace(uri, "^file:/+", "/")


def gc_candidates(listing: DataFrame, kept: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Files (uri, length) that no kept manifest (uri) names, outside the excluded prefixes."""
    files = listing.withColumn("uri", plain_uri(F.col("uri")))
    for prefix in exclude:
        files = files.where(~F.col("uri").startswith(prefix))
    return files.join(kept.select(plain_uri(F.col("uri")).alias("uri")).distinct(), "uri", "left_anti")


def collect_files(spark: SparkSession, candidates: DataFrame, *, dry_run: bool = True) -> dict:
    """Delete candidates by their file systems, a task its share; the audit record."""
    from ..sources.files import delete_files

    total = candidates.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    deleted = 0 if dry_run else delete_files(spark, candidates)
    return {"dry_run": dry_run, "candidates": total["n"], "bytes": total["bytes"], "deleted": deleted}


def gc_report(audits: DataFrame, last: int = 10) -> DataFrame:
    """The newest audit records of collections (timestamp, dry_run, candidates, deleted)."""
    return audits.orderBy(F.desc("timestamp")).limit(last)


# --- snapshots


def new_manifests(current: DataFrame, prior: DataFrame, uri: str = "uri") -> DataFrame:
    """Manifests that a prior snapshot doesn't hold."""
    return current.join(prior.select(uri).distinct(), uri, "left_anti")


def rows_added(files: DataFrame, tables: Mapping[str, str]) -> DataFrame:
    """Rows of core files by the table that their vertex type fills."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in tables.items() for x in kv]), F.col("vertex"))
    core = files.where("kind = 'core'").withColumn("table", name).where("table is not null")
    return core.groupBy("table").agg(F.sum("rows").alias("rows_added"))


def compaction_metrics(runs: DataFrame) -> DataFrame:
    """One row: how many compactions there were, and the seconds the latest took (A03); runs: run_id, is_compaction, started_at, completed_at."""
    took = F.round((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000, 2)
    at = runs.where("is_compaction")
    return at.agg(F.count("*").alias("compactions"), F.max_by(took, F.struct("completed_at", "run_id")).alias("latest_seconds"))


def change_report(tables: DataFrame) -> DataFrame:
    """Tables (table, base_rows, rows_added, vectors_added) with their totals and shares, and a row of all."""
    every = tables.rollup("table").agg(*[F.sum(c).alias(c) for c in ("base_rows", "rows_added", "vectors_added")])
    total = F.col("base_rows") + F.col("rows_added")
    changed = F.when(total > 0, F.round(F.col("rows_added") / F.when(total > 0, total) * 100, 2)).otherwise(0.0)
    return every.select(F.coalesce("table", F.lit("all")).alias("table"), total.alias("total_rows"), "rows_added", "vectors_added", changed.alias("percent_changed"))


@dataclass
class SnapshotReport:
    decision: str
    fingerprint: str
    manifests: list[str]
    new_manifests: int
    rows: dict[str, int] = field(default_factory=dict)


def build_snapshot(spark: SparkSession, sources: Mapping[str, DataFrame], manifests: DataFrame, path: str, *, fingerprint: str, base: str | None = None, least: int = 1, most: int = 1000, compacted: bool = False) -> SnapshotReport:
    """Write a snapshot of tables and its report beside it, or leave it as it is.

    ``sources`` are tables with the uri of the manifest a row came by
    (_manifest); an incremental build appends the rows of new manifests to the
    tables of ``base``.  The report's sidecar is written last, so a snapshot
    without one is not complete.
    """
    uris = sorted(r["uri"] for r in manifests.select("uri").distinct().collect())  # one row a run
    prior = read_sidecar(spark, base) if base else None
    known = set(prior.manifests) if prior else set()
    fresh = [u for u in uris if u not in known]
    decision = build_decision(same_fingerprint=bool(prior and prior.fingerprint == fingerprint), fresh=len(fresh), base_exists=prior is not None, compacted=compacted, least=least, most=most)
    if decision in ("skip", "defer"):
        return SnapshotReport(decision, prior.fingerprint, prior.manifests, len(fresh), prior.rows)
    rows: dict[str, int] = {}
    wanted = spark.createDataFrame([(u,) for u in (fresh if decision == "incremental" else uris)], "_manifest string")
    for name, source in sources.items():
        own = source.join(wanted, "_manifest", "left_semi").drop("_manifest")
        if decision == "incremental":
            own = append_by_name(spark.read.parquet(f"{base}/{name}"), own)
        own.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    report = SnapshotReport(decision, fingerprint, uris, len(fresh), rows)
    body = json.dumps(report.__dict__, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_report")
    return report


def update_snapshot(spark: SparkSession, sources: Mapping[str, DataFrame], manifests: DataFrame, path: str, *, least: int = 1, most: int = 1000, compacted: bool = False) -> SnapshotReport:
    """Bring a versioned snapshot up to the manifests (uri), writing the rows of new ones only.

    A full build, for too many new manifests or after a compaction, puts new
    files in place of all live ones, in one version; ``rows`` are those that
    were written.  The fingerprint is the version that the snapshot is at.
    """
    log = SnapshotLog(spark, path)
    seen = log.version()
    known = log.manifests(seen).select(F.col("manifest").alias("uri")).distinct()
    uris = sorted(r["uri"] for r in manifests.select("uri").distinct().collect())  # one row a run
    fresh = sorted(r["uri"] for r in new_manifests(manifests.select("uri").distinct(), known).collect())
    decision = build_decision(same_fingerprint=not fresh, fresh=len(fresh), base_exists=seen >= 0, compacted=compacted, least=least, most=most)
    if decision in ("skip", "defer"):
        return SnapshotReport(decision, str(seen), uris, len(fresh))
    if decision == "incremental" or seen < 0:
        at = log.append(sources, fresh, read_version=seen)
    else:
        wanted = spark.createDataFrame([(u,) for u in uris], "_manifest string")
        own = {name: rows.join(F.broadcast(wanted), "_manifest", "left_semi").drop("_manifest") for name, rows in sources.items()}
        commit = uuid.uuid4().hex
        added = [a for name, rows in own.items() for a in log.write(name, rows, commit)]
        gone = [(r["table"], r["uri"]) for r in log.files(seen).select("table", "uri").collect()]
        at = log.commit(added, gone, manifests=fresh, schemas={name: rows.schema for name, rows in own.items()}, read_version=seen, commit=commit)
    new = log.files(at).where(F.col("version") == at).groupBy("table").agg(F.sum("n_rows").alias("n")).collect()
    return SnapshotReport(decision, str(at), uris, len(fresh), {r["table"]: r["n"] for r in new})


def read_sidecar(spark: SparkSession, path: str) -> SnapshotReport | None:
    """The report beside a snapshot; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(f"{path}/_report", wholetext=True).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return SnapshotReport(**json.loads(found[0].value))


def sample_runs(runs: DataFrame, n: int, *, pick: str = "latest") -> DataFrame:
    """The first or the last n runs by name, for a small copy of a graph."""
    if pick not in ("first", "latest"):
        raise ValueError("pick must be first or latest")
    return runs.orderBy(F.col("run_id") if pick == "first" else F.desc("run_id")).limit(n)


# --- what was ingested before


def find_completed(incoming: DataFrame, done: DataFrame, *, digest: str = "digest", scope: str = "scope", exact: Sequence[str] = ("pipeline_version", "bucket", "name"), loose: Sequence[str] = ("size_bytes", "duration_ms"), content_type: str = "content_type", limit: int = 20) -> DataFrame:
    """For each incoming object (id, ...) the completed one (doc_id, ...) that it repeats, if any.

    Digest and scope are equal; of ``exact`` columns those that the incoming
    object has must be equal too, ``loose`` ones only where the completed
    object has them as well, content types up to the semicolon.  Of the first
    ``limit`` by doc_id, one with metrics is preferred; the limit is the
    lookup's own feature.
    """
    theirs = done.where("status = 'COMPLETED'").select(*[F.col(c).alias(f"_{c}") for c in done.columns])
    bare = lambda c: F.nullif(F.lower(F.trim(F.split(c, ";")[0])), F.lit(""))
    fits = (F.col(digest) == F.col(f"_{digest}")) & (F.col(scope).isNull() | (F.col(scope) == F.col(f"_{scope}")))
    for c in exact:
        fits = fits & (F.col(c).isNull() | F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)))
    for c in loose:
        fits = fits & (F.col(c).isNull() | F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
    kind, stored = bare(F.col(content_type)), bare(F.col(f"_{content_type}"))
    fits = fits & (kind.isNull() | stored.isNull() | (kind == stored))
    near = incoming.join(theirs, fits)
    looked = near.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_doc_id"))).where(F.col("_n") <= limit)
    best = looked.groupBy("id").agg(F.min_by(F.struct("_doc_id", "_has_metrics"), F.struct(~F.col("_has_metrics"), F.col("_doc_id"))).alias("m"))
    return incoming.join(best, "id", "left").select(*incoming.columns, F.col("m._doc_id").alias("found"), F.col("m").isNotNull().alias("cache_hit"))
