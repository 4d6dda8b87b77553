"""Folds over ordered events of a key that have no window form, and deduplication of streams and tables."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

Step = Callable[[Any, Mapping[str, Any]], tuple[Any, Any]]


#: Rows of the longest key beyond which keys are folded in ranges.
LONGEST = 1_000_000


def fold_by_key(events: DataFrame, key: str, order: list[str], step: Step, name: str, kind: str, *, counted: bool = False, longest: int = LONGEST, uses: Sequence[str] | None = None) -> DataFrame:
    """events with a column that a fold over the rows of each key gives, in order.

    ``step(state, row)`` returns the next state and the row's value; a key's
    first state is None.  With ``counted`` values are flags, and the column
    numbers the rows by the flags of their key so far, from 0.  Keys are sorted
    within their partitions and flow through in batches: a task holds one batch
    and one state.  If a key has more than ``longest`` rows, tasks are ranges
    of (key, order) instead, see fold_in_ranges().  ``uses`` are the columns
    that a step looks at, if not all.  Events are worked out once.
    """
    events = materialize(events)
    most = events.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > longest:
        return fold_in_ranges(events, key, order, step, name, kind, counted=counted, rows=longest, uses=uses)
    uses = events.columns if uses is None else uses
    ordered = events.repartition(key).sortWithinPartitions(key, *order)
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, fresh, flags = None, None, True, 0
        for batch in batches:
            out = []
            for own, row in zip(_values(batch, key), _rows(batch, uses)):
                if fresh or own != now:
                    now, state, fresh, flags = own, None, False, 0
                state, value = step(state, row)
                flags += bool(counted and value)
                out.append(flags - 1 if counted else value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW[kind])], names=[*names, name])

    return ordered.mapInArrow(run, f"{_columns(events)}, `{name}` {kind}")


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _values(batch: pa.RecordBatch, name: str) -> list:
    column = batch.column(batch.schema.names.index(name))
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _rows(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[dict[str, Any]]:
    """Rows of a batch with some of its columns."""
    if len(names) == 1:
        (name,) = names
        return ({name: x} for x in _values(batch, name))
    return (dict(zip(names, row)) for row in zip(*(_values(batch, n) for n in names)))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@dataclass
class _Range:
    """What is known of a range: its first and last key, the state and the flags of the last key at its end, and the state it was begun with."""

    first: Any
    last: Any
    end: bytes
    flags: int
    began: bytes | None = None
    began_last: bytes | None = None  # what its end is folded from

    @property
    def single(self) -> bool:
        return self.first == self.last


def fold_in_ranges(events: DataFrame, key: str, order: list[str], step: Step, name: str, kind: str, *, counted: bool = False, rows: int = LONGEST, uses: Sequence[str] | None = None) -> DataFrame:
    """fold_by_key() by ranges of about ``rows`` rows of (key, order), so that a key may span tasks.

    All ranges are folded at once, each as if its first key began there.  Then
    each is told the state that the range before ended with, and those for
    which that is news, and whose end depends on it, are folded again, until
    nothing is news: at once where states forget what was long ago (batches
    fall into step, buckets fill up, keys are done), range after range in the
    worst case.  A range that is folded again is folded from both states until
    they meet; from there on its end is known.  The driver holds a state a
    range.
    """
    names = events.columns
    uses = names if uses is None else uses
    ranges = max(2, math.ceil(events.count() / max(1, rows)))
    placed = events.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    stored = materialize(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))

    def in_order(parts: list[int] | None) -> DataFrame:
        some = stored if parts is None else stored.where(F.col("_part").isin(parts))
        return some.repartition(min(ranges, len(parts) if parts else ranges), "_part").sortWithinPartitions("_part", "_at")

    def look(parts: list[int] | None, begin: dict[int, bytes], known: dict[int, _Range]) -> dict[int, _Range]:
        ends = {p: (r.began_last, r.end, r.flags) for p, r in known.items() if p in begin}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, first, now, state, flags = None, None, None, None, 0
            old, met, before = None, None, 0  # the fold before, from another state, and its flags; met: the end is known
            out = []

            def closed() -> tuple:
                if met is not None:
                    return part, pickle.dumps((first, now)), met[0], met[1]
                return part, pickle.dumps((first, now)), pickle.dumps(state), flags

            for batch in batches:
                of = _values(batch, "_part")
                if met is not None and of[0] == of[-1] == part:
                    continue  # such a range has one key
                for at, own, row in zip(of, _values(batch, key), _rows(batch, uses)):
                    if at != part:
                        if part is not None:
                            out.append(closed())
                        part, first, now, flags = at, own, own, 0
                        state = pickle.loads(begin[part]) if part in begin else None
                        met, before = None, 0
                        old = (pickle.loads(ends[part][0]) if ends[part][0] else None,) if part in ends else None
                    elif met is not None:
                        continue
                    elif own != now:
                        now, state, flags = own, None, 0
                    state, value = step(state, row)
                    flags += bool(counted and value)
                    if old is not None:
                        was, value = step(old[0], row)
                        before += bool(counted and value)
                        old = (was,)
                        if was == state:
                            met = ends[part][1], ends[part][2] - before + flags
            if part is not None:
                out.append(closed())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["part", "keys", "state", "flags"])

        found = in_order(parts).mapInArrow(run, "part int, keys binary, state binary, flags long").collect()  # one row a range
        return {r["part"]: _Range(*pickle.loads(r["keys"]), bytes(r["state"]), r["flags"], begin.get(r["part"]), begin.get(r["part"])) for r in found}

    known = look(None, {}, {})
    following = sorted(known)
    before = {p: q for q, p in zip(following, following[1:]) if known[p].first == known[q].last}
    while True:
        news = {p: known[q].end for p, q in before.items() if known[p].began != known[q].end}
        if not news:
            break
        again = [p for p in news if known[p].single]
        for p in news:
            known[p].began = news[p]
        if again:
            known.update(look(again, {p: news[p] for p in again}, known))
    begin = {p: known[p].began for p in before}
    flagged: dict[int, int] = {}
    for p in following:
        q = before.get(p)
        flagged[p] = 0 if q is None else known[q].flags + (flagged[q] if known[q].single else 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, state, flags = None, None, None, 0
        for batch in batches:
            out = []
            for at, own, row in zip(_values(batch, "_part"), _values(batch, key), _rows(batch, uses)):
                if at != part:
                    part, now = at, own
                    state, flags = pickle.loads(begin[part]) if part in begin else None, flagged[part]
                elif own != now:
                    now, state, flags = own, None, 0
                state, value = step(state, row)
                flags += bool(counted and value)
                out.append(flags - 1 if counted else value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, _ARROW[kind])], names=[*names, name])

    return in_order(None).mapInArrow(fold, f"{_columns(events)}, `{name}` {kind}")


def batch_step(at: str, most: int, latency_ms: int) -> Step:
    """Whether a row opens a batch; the state is the rows of the open one, and its oldest."""

    def step(state, row):
        count, oldest = state or (0, 0)
        if count and row[at] - oldest >= latency_ms:
            count = 0
        opens = not count
        oldest = row[at] if opens else oldest
        return ((0, 0) if count + 1 >= most else (count + 1, oldest)), opens

    return step


def flush_batches(events: DataFrame, key: str, at: str, *, most: int = 50, latency_ms: int = 2000, order: str = "event_id", **longest: int) -> DataFrame:
    """The batch of each event of a key (T01): closed when it is full, or when its oldest event is too old at the next arrival."""
    return fold_by_key(events, key, [at, order], batch_step(at, most, latency_ms), "batch", "long", counted=True, uses=[at], **longest)


def idempotency(events: DataFrame, key: str, at: str, outcome: str, *, ttl_ms: int, attempts: int, order: str = "event_id", **longest: int) -> DataFrame:
    """What happens to each delivery of a key (T04): start, skip_done, skip_running or dead.

    A finished key is skipped; one that started within the time to live is
    skipped too; another start counts an attempt, and beyond ``attempts`` the
    key is dead.
    """
    after = {"ok": "done", "failed": "failed"}

    def step(held, row):
        state, since, tries = held or ("new", 0, 0)
        if state in ("done", "dead"):
            return (state, since, tries), "skip_done"
        if state == "running" and row[at] - since < ttl_ms:
            return (state, since, tries), "skip_running"
        if tries >= attempts:
            return ("dead", since, tries), "dead"
        return (after.get(row[outcome], "running"), row[at], tries + 1), "start"

    return fold_by_key(events, key, [at, order], step, "action", "string", uses=[at, outcome], **longest)


def bucket_step(at: str, per_minute: int) -> Step:
    def step(state, row):
        now = row[at]
        left, last = state or (float(per_minute), now)
        left = min(float(per_minute), left + (now - last) * per_minute / 60_000)
        passed = left >= 1
        return (left - passed, now), passed

    return step


def token_bucket(events: DataFrame, key: str, at: str, *, per_minute: int, order: str = "event_id", **longest: int) -> DataFrame:
    """Whether each event passes a token bucket of its key (T07): capacity per_minute, refilled steadily."""
    return fold_by_key(events, key, [at, order], bucket_step(at, per_minute), "allowed", "boolean", uses=[at], **longest)


def tumbling_limit(events: DataFrame, keys: list[str], at: str, limit: int, *, seconds: int = 60, order: str = "event_id") -> DataFrame:
    """Whether each event is among the first ``limit`` of its key and window."""
    windowed = events.withColumn("window_start", (F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long"))
    w = Window.partitionBy(*keys, "window_start").orderBy(at, order)
    return windowed.withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.col("nth") <= limit)


def dedupe_stream(events: DataFrame, keys: list[str], at: str, watermark: str) -> DataFrame:
    """First delivery of each key within a watermark (T05); works on streams and tables."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if not events.isStreaming:
        return timed.dropDuplicates(keys)
    return timed.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def hopping(events: DataFrame, at: str, width: str, hop: str) -> DataFrame:
    """Counts by hopping windows."""
    w = F.window(F.col(at).cast("timestamp"), width, hop)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("window_start"), "n")
