"""Records that are appended or delivered: audit, usage, data sets, costs, exports, webhooks, dead letters."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import running
from .writers import part_path, tags

# Columns of records.
AUDIT = "id string, org_id string, site_id string, stream_id string, api_key_id string, actor_type string, actor_id string, action string, decision string, reason string, request_id string, path string, created_at timestamp, schema_version string"
USAGE = "id string, org_id string, site_id string, stream_id string, api_key_id string, event_type string, modality string, units long, bytes long, response_time_ms long, created_at timestamp, pipeline_version string, schema_version string"
DATASET = "id string, name string, description string, tags string, size long, created_at timestamp, updated_at timestamp, schema_version string"
ANNOTATION = "id string, dataset_id string, media_asset_id string, label string, value string, annotator string, status string, created_at timestamp, updated_at timestamp, schema_version string"


class SchemaError(ValueError):
    """Rows that don't fit the table they are written to."""


def checked(df: DataFrame, schema: str | T.StructType, *, vectors: Mapping[str, int] | None = None) -> DataFrame:
    """df as the schema says: unknown columns are an error, missing ones null; vectors of another length fail the job."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    extra = set(df.columns) - set(want.names)
    if extra:
        raise SchemaError(f"unknown columns {sorted(extra)}")
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
    for name, size in (vectors or {}).items():
        wrong = F.col(name).isNotNull() & (F.size(name) != size)
        out = out.withColumn(name, F.when(wrong, F.raise_error(F.lit(f"{name}: vectors of {size} numbers are needed"))).otherwise(F.col(name)))
    return out


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """uri, bytes_written, rows and sha256 of the Parquet files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    digests = files.select(F.col("path").alias("uri"), F.col("length").alias("bytes_written"), F.sha2("content", 256).alias("sha256"))
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("_uri")).agg(F.count("*").alias("rows"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return digests.join(counts, name(F.col("uri")) == name(F.col("_uri")), "left").select("uri", "bytes_written", F.coalesce("rows", F.lit(0)).alias("rows"), "sha256")


def new_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """A random identifier for each row."""
    return df.withColumn(name, F.expr("uuid()"))


def append_records(spark: SparkSession, rows: Iterable[Mapping], schema: str, root: str, vertex: str) -> int:
    """Append records as one part of a vertex table, with ids and times where they are missing (K09-K11); how many."""
    now, made = datetime.now(UTC), []
    want = T.StructType.fromDDL(schema)
    for row in rows:
        unknown = set(row) - set(want.names)
        if unknown:
            raise SchemaError(f"unknown columns {sorted(unknown)}")
        full = {"id": str(uuid.uuid4()), **{c: now for c in ("created_at", "updated_at") if c in want.names}} | dict(row)
        made.append(tuple(full.get(c) for c in want.names))
    if made:
        spark.createDataFrame(made, want).coalesce(1).write.mode("append").option("compression", "zstd").parquet(part_path(root, vertex, "core"))
    return len(made)


@dataclass
class RecordBuffer:
    """Records held back until there are enough of them, or until the last flush is long enough ago.

    A size of 1 writes at once.  ``clock`` gives seconds.
    """

    write: Callable[[list[Mapping]], object]
    size: int = 1
    seconds: float = 5.0
    clock: Callable[[], float] = lambda: datetime.now(UTC).timestamp()
    held: list[Mapping] = field(default_factory=list)
    last: float | None = None

    def add(self, record: Mapping) -> bool:
        """Whether the record led to a flush."""
        if self.last is None:
            self.last = self.clock()
        self.held.append(record)
        if len(self.held) >= self.size or self.clock() - self.last >= self.seconds:
            self.flush()
            return True
        return False

    def flush(self) -> int:
        rows, self.held, self.last = self.held, [], self.clock()
        if rows:
            self.write(rows)
        return len(rows)


def create_dataset(spark: SparkSession, root: str, name: str, description: str | None = None, labels: Sequence[str] = (), size: int | None = None) -> int:
    return append_records(spark, [{"name": name, "description": description, "tags": tags(list(labels)), "size": size, "schema_version": "1"}], DATASET, root, "Dataset")


def add_annotation(spark: SparkSession, root: str, **values) -> int:
    return append_records(spark, [{"schema_version": "1", "status": "active"} | values], ANNOTATION, root, "Annotation")


def records(spark: SparkSession, root: str, vertex: str, schema: str) -> DataFrame:
    """All parts of a record table (S12); empty if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(part_path(root, vertex, "core"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def registry(entries: DataFrame, **wanted) -> DataFrame:
    """Entries that have every value that is asked for."""
    for name, value in wanted.items():
        if value is not None:
            entries = entries.where(F.array_contains(name, value) if isinstance(entries.schema[name].dataType, T.ArrayType) else F.col(name) == value)
    return entries


def last_entries(entries: DataFrame, position: str, limit: int, **wanted) -> DataFrame:
    """The last entries in stored order that have the values asked for, in that order."""
    return registry(entries, **wanted).orderBy(F.desc(position)).limit(max(0, limit)).orderBy(position)


def scoped_entries(entries: DataFrame, **scope) -> DataFrame:
    """Entries of a scope; null on either side fits."""
    for name, value in scope.items():
        if value is not None:
            entries = entries.where(F.col(name).isNull() | (F.col(name) == value))
    return entries


def cost_lines(costs: DataFrame, path: str) -> None:
    """One compact JSON object an asset."""
    costs.select(F.to_json(F.struct(*costs.columns)).alias("value")).write.mode("overwrite").text(path)


# --- delivery


@dataclass(frozen=True)
class Webhook:
    id: str
    url: str
    secret: str | None = None
    enabled: bool = True
    headers: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DeliveryOptions:
    attempts: int = 3
    timeout_s: float = 5.0
    wait_s: float = 0.5
    factor: float = 2.0
    retry: tuple[int, ...] = (408, 429, 500, 502, 503, 504)


Post = Callable[[str, bytes, Mapping[str, str], float], int | None]


def signature(secret: str, timestamp: str, body: bytes) -> str:
    """HMAC over the time and the body, so that neither can be changed or sent again later."""
    return hmac.new(secret.encode(), f"{timestamp}.".encode() + body, hashlib.sha256).hexdigest()


def deliver(hook: Webhook, event: Mapping, options: DeliveryOptions, post: Post, *, sleep: Callable[[float], None], now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> tuple[str, list[dict]]:
    """Post an event; the outcome (success, failed, skipped) and one record an attempt.

    Tried again after no answer or a status of the list, with growing pauses.
    """
    if not hook.enabled:
        return "skipped", []
    body, stamp = json.dumps(event, sort_keys=True).encode(), now().isoformat()
    headers = {"Content-Type": "application/json", "X-Event-Timestamp": stamp, **hook.headers}
    if hook.secret:
        headers["X-Event-Signature"] = signature(hook.secret, stamp, body)
    tried: list[dict] = []
    for n in range(1, max(1, options.attempts) + 1):
        try:
            status, error = post(hook.url, body, headers, options.timeout_s), None
        except OSError as e:
            status, error = None, str(e)
        good = status is not None and 200 <= status < 300
        tried.append({"webhook_id": hook.id, "event_id": event.get("id"), "attempt": n, "status": "success" if good else "failed", "status_code": status, "error": error})
        if good or status is not None and status not in options.retry:
            break
        if n < options.attempts:
            sleep(options.wait_s * options.factor ** (n - 1))
    return tried[-1]["status"], tried


DELIVERIES = "webhook_id string, event_id string, attempt long, status string, status_code long, error string"


def deliver_rows(events: DataFrame, hooks: Sequence[Webhook], options: DeliveryOptions, post: Post, *, sleep: Callable[[float], None]) -> DataFrame:
    """Every event (id, payload columns) to every webhook, by the tasks that hold the events; the attempts.  For foreachBatch."""
    names = events.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [r for row in batch.to_pylist() for hook in hooks for r in deliver(hook, {c: row[c] for c in names}, options, post, sleep=sleep)[1]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            cols = [x.split(" ")[0] for x in DELIVERIES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(cols, kinds)], cols)

    return events.select(*[F.col(c).cast("string").alias(c) for c in names]).mapInArrow(run, DELIVERIES)


def as_messages(events: DataFrame, batch: Column, columns: Sequence[str], most: int | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """Envelopes {"events": [...]} of the events of each batch, as a queue takes them.

    With ``most``, a batch is cut, in the order of ``columns``, wherever so many
    events or so many bytes are full, so a message holds no more than either
    and one event, and no task sees a whole batch; ``first`` is the place, from
    0, of a message's first event in its batch.
    """
    item = F.struct(*columns)
    value = F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("events"))).alias("value")
    if most is None:
        return events.groupBy(batch.alias("batch")).agg(value)
    if most < 1 or most_bytes < 1:
        raise ValueError("a message holds one event at least")
    keyed = events.select(batch.alias("batch"), *columns)
    size = F.octet_length(F.to_json(item)).cast("long")
    at = running(keyed, ["batch"], list(columns), _before=("sum", F.lit(1).cast("long")), _bytes=("sum", size))
    before, behind = (F.coalesce(c, F.lit(0).cast("long")) for c in ("_before", "_bytes"))
    cut = at.withColumn("_before", before).groupBy("batch", F.floor(F.col("_before") / most).alias("_n"), F.floor(behind / most_bytes).alias("_full"))
    return cut.agg(F.min("_before").alias("first"), value).select("batch", "first", "value")


def dead_letters(events: DataFrame, reason: Column, attempts: Column) -> DataFrame:
    """Events that are given up, as JSON with the reason and the number of attempts."""
    return events.select(F.to_json(F.struct(F.struct(*events.columns).alias("event"), reason.alias("error"), attempts.alias("attempts"))).alias("value"))
