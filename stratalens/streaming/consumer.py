"""Consumers of event streams: admission, state, deduplication, processing, dead letters, buffers and ticks."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.readers import decode_batches

STATE = "key string, status string, attempts long, digest string, updated_at timestamp"


def event_key(bucket: str = "bucket", name: str = "name", generation: str = "generation") -> Column:
    """What tells one upload from another."""
    return F.sha2(F.concat(F.col(bucket), F.lit("/"), F.col(name), F.lit("#"), F.col(generation)), 256)


def rejected(backlog: int, arriving: int, most: int) -> bool:
    """Whether a batch would overfill the backlog."""
    return backlog + arriving > most


def decide(events: DataFrame, state: DataFrame, *, now: Column, ttl_s: int, attempts: int) -> DataFrame:
    """events (key, ...) with action: skip_done, skip_running, dead or start, and the number of the attempt.

    State holds one row a key; repeated deliveries within the batch are the
    caller's to drop.
    """
    held = state.select(F.col("key").alias("_key"), F.col("status").alias("_status"), F.col("attempts").alias("_n"), F.col("updated_at").alias("_at"))
    both = events.join(held, F.col("key") == F.col("_key"), "left")
    fresh = (F.unix_seconds(now) - F.unix_seconds("_at")) < ttl_s
    action = F.when(F.col("_status").isin("COMPLETED", "DLQ"), "skip_done").when((F.col("_status") == "PROCESSING") & fresh, "skip_running").when(F.coalesce("_n", F.lit(0)) >= attempts, "dead").otherwise("start")
    return both.withColumn("action", action).withColumn("attempt", F.coalesce("_n", F.lit(0)) + F.when(F.col("action") == "start", 1).otherwise(0)).drop("_key", "_status", "_n", "_at")


def consume(messages: DataFrame, batch_id: int, state_path: str, process: Callable[[DataFrame], DataFrame], *, ttl_s: int = 3600, attempts: int = 5, now: Column | None = None, compact_every: int = 20, retain_s: int | None = None) -> dict[str, int]:
    """One micro-batch of messages (value): decode, decide, claim, process, mark (T04, T06); for foreachBatch.

    ``process`` takes the events to start and returns (key, ok, digest).  What
    is started is claimed before, as PROCESSING with the number of its attempt,
    so an attempt counts even if nothing is heard of it again: a batch that is
    run again after a crash counts its earlier claims and starts anew, or gives
    up; another consumer leaves a claimed key alone while the claim is fresh.
    A batch that was marked is not run again.
    """
    spark = messages.sparkSession
    now = F.current_timestamp() if now is None else now
    done_at = f"{state_path}/changes/batch={batch_id:010d}"
    if _complete(spark, done_at):
        return {"finished": spark.read.schema(STATE).parquet(done_at).count()}
    events = decode_batches(messages).withColumn("key", event_key()).dropDuplicates(["key"])
    tries = [n for n in _numbers(spark, f"{state_path}/claims/batch={batch_id:010d}", "try") if _complete(spark, f"{state_path}/claims/batch={batch_id:010d}/try={n:04d}")]
    decided = materialize(decide(events, latest_state(spark, state_path, before=batch_id, rerun=True), now=now, ttl_s=ttl_s, attempts=attempts))
    started = decided.where("action = 'start'").drop("action")
    claims = started.select("key", F.lit("PROCESSING").alias("status"), F.col("attempt").alias("attempts"), F.lit(None).cast("string").alias("digest"), now.alias("updated_at"))
    claims.write.mode("overwrite").parquet(f"{state_path}/claims/batch={batch_id:010d}/try={max(tries, default=-1) + 1:04d}")
    results = materialize(process(started).select("key", "ok", "digest"))
    done = started.join(results, "key", "left")
    status = F.when(F.col("ok"), "COMPLETED").otherwise("FAILED")
    changes = done.select("key", status.alias("status"), F.col("attempt").alias("attempts"), "digest", now.alias("updated_at"))
    given_up = decided.where("action = 'dead'").select("key", F.lit("DLQ").alias("status"), F.col("attempt").alias("attempts"), F.lit(None).cast("string").alias("digest"), now.alias("updated_at"))
    changes.unionAll(given_up).write.mode("overwrite").parquet(done_at)
    if compact_every and batch_id % compact_every == compact_every - 1:
        compact_state(spark, state_path, batch_id, now=now, retain_s=retain_s)
    return {r["action"]: r["count"] for r in decided.groupBy("action").count().collect()}


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str) -> bool:
    target, fs = _path(spark, f"{folder}/_SUCCESS")
    return fs.exists(target)


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the folders name=n."""
    target, fs = _path(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))


def latest_state(spark: SparkSession, path: str, *, before: int | None = None, rerun: bool = False) -> DataFrame:
    """The last that is known of every key; empty if there is nothing.

    Read are the last compacted state and the batches after it, no more.  With
    ``rerun`` the claims of batch ``before`` itself count as failed attempts.
    """
    limit = before if before is not None else 1 << 62
    mark = max((n for n in _numbers(spark, f"{path}/compacted", "upto") if n < limit and _complete(spark, f"{path}/compacted/upto={n:010d}")), default=-1)
    parts = []
    if mark >= 0:
        parts.append(spark.read.schema(STATE).parquet(f"{path}/compacted/upto={mark:010d}").select("*", F.lit(mark).alias("batch"), F.lit(1 << 20).alias("step")))
    changed = [f"{path}/changes/batch={n:010d}" for n in _numbers(spark, f"{path}/changes", "batch") if mark < n < limit]
    changed = [c for c in changed if _complete(spark, c)]
    if changed:
        parts.append(spark.read.option("basePath", f"{path}/changes").schema(f"{STATE}, batch int").parquet(*changed).select("*", F.lit(1 << 20).alias("step")))
    claimed = [f"{path}/claims/batch={n:010d}/try={t:04d}" for n in _numbers(spark, f"{path}/claims", "batch") if mark < n < limit or rerun and n == limit for t in _numbers(spark, f"{path}/claims/batch={n:010d}", "try")]
    claimed = [c for c in claimed if _complete(spark, c)]
    if claimed:
        own = (F.col("batch") == limit) if rerun else F.lit(False)
        rows = spark.read.option("basePath", f"{path}/claims").schema(f"{STATE}, batch int, try int").parquet(*claimed).withColumn("status", F.when(own, "FAILED").otherwise(F.col("status")))
        parts.append(rows.withColumnRenamed("try", "step"))
    if not parts:
        return spark.createDataFrame([], STATE)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    last = every.groupBy("key").agg(F.max_by(F.struct("status", "attempts", "digest", "updated_at"), F.struct("batch", "step")).alias("s"))
    return last.select("key", "s.*")


def compact_state(spark: SparkSession, path: str, upto: int, *, now: Column | None = None, retain_s: int | None = None) -> int:
    """One row a live key in place of all changes up to a batch; older folders go. How many keys are live.

    A key is live until it has been finished, or given up, for ``retain_s``
    seconds; a delivery of it after that starts anew.  The state that this one
    replaces stays until the next time, for readers that still use it.
    """
    state = latest_state(spark, path, before=upto + 1)
    if retain_s is not None:
        age = F.unix_seconds(F.current_timestamp() if now is None else now) - F.unix_seconds("updated_at")
        state = state.where(~F.col("status").isin("COMPLETED", "DLQ") | (age < retain_s))
    before = _numbers(spark, f"{path}/compacted", "upto")
    target = f"{path}/compacted/upto={upto:010d}"
    state.write.mode("overwrite").parquet(target)
    floor = max((n for n in before if n < upto), default=-1)
    old = [f"{path}/compacted/upto={n:010d}" for n in before if n < floor]
    old += [f"{path}/{kind}/batch={n:010d}" for kind in ("changes", "claims") for n in _numbers(spark, f"{path}/{kind}", "batch") if n <= floor]
    for folder in old:
        where, fs = _path(spark, folder)
        fs.delete(where, True)
    return spark.read.schema(STATE).parquet(target).count()


def flush_wait(latency_s: float) -> float:
    """Seconds between two looks at a batch that may have become too old: half its latency, a quarter of a second at least."""
    return max(0.25, latency_s / 2)


def run_stream(messages: DataFrame, state_path: str, process: Callable[[DataFrame], DataFrame], *, checkpoint: str, latency_s: float = 2.0, once: bool = False, **limits):
    """Start the consumer on a stream of messages, woken as often as the latency asks."""
    writer = messages.writeStream.foreachBatch(lambda df, i: consume(df, i, state_path, process, **limits) and None).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{flush_wait(latency_s)} seconds")
    return writer.start()


class EdgeBuffer:
    """Store and forward on a device's own disk: payloads are kept until they are sent, in order of their time.

    The one part that works on a local folder: it runs on the device, before
    anything reaches a cluster.  ``clock`` gives seconds.
    """

    def __init__(self, folder: str, *, max_bytes: int, ttl_s: float, clock: Callable[[], float]):
        self.folder, self.max_bytes, self.ttl_s, self.clock, self.count = Path(folder), max_bytes, ttl_s, clock, 0
        self.folder.mkdir(parents=True, exist_ok=True)

    def items(self) -> list[tuple[float, Path]]:
        """Times and files, oldest first."""
        return sorted((float(p.name.split("_")[0]), p) for p in self.folder.glob("*.bin"))

    def add(self, payload: bytes, metadata: dict) -> None:
        at, self.count = self.clock(), self.count + 1
        path = self.folder / f"{at:017.6f}_{self.count:09d}.bin"
        path.with_suffix(".json").write_text(json.dumps(metadata, sort_keys=True))
        partial = path.with_suffix(".part")
        partial.write_bytes(payload)
        partial.rename(path)
        self.prune()

    def drop(self, path: Path) -> None:
        path.unlink(missing_ok=True)
        path.with_suffix(".json").unlink(missing_ok=True)

    def prune(self) -> int:
        """Drop what is too old, then the oldest until the rest fits."""
        held, gone = self.items(), 0
        total = sum(p.stat().st_size for _, p in held)
        for at, path in held:
            if self.clock() - at >= self.ttl_s or total > self.max_bytes:
                total -= path.stat().st_size
                self.drop(path)
                gone += 1
        return gone

    def replay(self, send: Callable[[bytes, dict], bool]) -> int:
        """Send what is held, oldest first, and stop at the first failure; how many were sent."""
        self.prune()
        sent = 0
        for _, path in self.items():
            if not send(path.read_bytes(), json.loads(path.with_suffix(".json").read_text())):
                break
            self.drop(path)
            sent += 1
        return sent


def due_workflows(workflows: DataFrame, runs: DataFrame, due: Callable[[str, Column, Column], Column], schedules: list[str], now: Column) -> DataFrame:
    """Workflows (workflow_id, schedule, enabled) to start now: due by their last run and not active.

    ``schedules`` are the distinct schedules, a catalogue.
    """
    last = runs.groupBy("workflow_id").agg(F.max("started_at").alias("last"), F.bool_or(F.col("status").isin("queued", "running")).alias("active"))
    both = workflows.join(last, "workflow_id", "left")
    ready = F.lit(False)
    for s in schedules:
        ready = F.when(F.col("schedule") == s, due(s, now, F.col("last"))).otherwise(ready)
    return both.where(F.col("enabled") & ~F.coalesce("active", F.lit(False)) & F.coalesce(ready, F.lit(False))).select("workflow_id", "schedule", "last")
