"""Folds over keys of a stream, with timers: batches that close by age, buckets that refill, in event time.

Events of a key wait in its state until the watermark has passed them and then
go through the fold in order, so what a stream gives doesn't depend on how it
was cut into micro-batches: it is what the same fold gives over a table.  A
timer wakes a key whose events can be let go, or whose batch has become too
old, without waiting for another event.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, ShortType

from .folds import Step, batch_step, bucket_step

#: state, row -> state, output rows; state, watermark -> state, output rows; state -> when to wake next.
OnEvent = Callable[[Any, Mapping[str, Any]], tuple[Any, list[tuple]]]
OnTime = Callable[[Any, int], tuple[Any, list[tuple]]]
Deadline = Callable[[Any], int | None]


def keyed_process(events: DataFrame, key: str, at: str, order: str, watermark: str, out: str, on_event: OnEvent, on_time: OnTime | None = None, deadline: Deadline | None = None) -> DataFrame:
    """Output rows of a process over each key's events (``at`` in milliseconds) in the order of (at, order).

    A key's state is what the process holds and the events that the watermark
    has not passed: its delay bounds them.
    """
    timed = events.withColumn("_time", F.timestamp_millis(F.col(at))).withWatermark("_time", watermark)
    whole = [f.name for f in events.schema if isinstance(f.dataType, (LongType, IntegerType, ShortType))]
    names = events.columns
    columns = [x.strip().split()[0].strip("`") for x in out.split(",")]

    def rows_of(frame: pd.DataFrame) -> list[dict]:
        rows = frame[names].astype(object).where(frame[names].notna(), None).to_dict("records")
        for row in rows:
            for name in whole:
                row[name] = None if row[name] is None else int(row[name])
        return rows

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = pickle.loads(state.get[0]) if state.exists else ([], None)
        for frame in frames:
            waiting += rows_of(frame)
        waiting.sort(key=lambda r: (r[at], r[order]))
        passed = state.getCurrentWatermarkMs()
        made: list[tuple] = []
        ready = 0
        while ready < len(waiting) and waiting[ready][at] <= passed:  # an event that comes later is later
            held, rows = on_event(held, waiting[ready])
            made += rows
            ready += 1
        waiting = waiting[ready:]
        if on_time is not None and held is not None:
            held, rows = on_time(held, passed)
            made += rows
        state.update((pickle.dumps((waiting, held)),))
        wake = [waiting[0][at]] if waiting else []
        if deadline is not None and held is not None and deadline(held) is not None:
            wake.append(deadline(held))
        if wake:
            state.setTimeoutTimestamp(max(min(wake), passed + 1))
        yield pd.DataFrame(made, columns=columns)

    return timed.groupBy(key).applyInPandasWithState(run, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def fold_stream(events: DataFrame, key: str, at: str, step: Step, name: str, kind: str, *, watermark: str, order: str = "event_id") -> DataFrame:
    """fold_by_key() over a stream: each event with its value, once the watermark has passed it."""
    names = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def on_event(state: Any, row: Mapping[str, Any]) -> tuple[Any, list[tuple]]:
        state, value = step(state, row)
        return state, [(*(row[n] for n in names), value)]

    return keyed_process(events, key, at, order, watermark, f"{schema}, `{name}` {kind}", on_event)


def stream_token_bucket(events: DataFrame, key: str, at: str, *, per_minute: int, watermark: str, order: str = "event_id") -> DataFrame:
    """token_bucket() over a stream: what a bucket holds goes on from batch to batch."""
    return fold_stream(events, key, at, bucket_step(at, per_minute), "allowed", "boolean", watermark=watermark, order=order)


def stream_batches(events: DataFrame, key: str, at: str, *, most: int = 50, latency_ms: int = 2000, watermark: str, order: str = "event_id") -> DataFrame:
    """Closed batches of a stream's keys: key, batch, n, first_at, last_at, and whether size or age closed them.

    Batches hold what flush_batches() says; one that has become too old is
    closed by its timer, with no event after it.
    """
    step = batch_step(at, most, latency_ms)
    kind = events.schema[key].dataType.simpleString()

    def close(key_value: Any, batch: int, members: list[int], reason: str) -> tuple:
        return key_value, batch, len(members), members[0], members[-1], reason

    def on_event(state: Any, row: Mapping[str, Any]) -> tuple[Any, list[tuple]]:
        fold, key_value, batch, members = state or (None, row[key], -1, [])
        fold, opens = step(fold, row)
        out = []
        if opens:
            if members:
                out.append(close(key_value, batch, members, "age"))
            batch, members = batch + 1, []
        members = [*members, row[at]]
        if fold[0] == 0:  # that one was the last of its batch
            out.append(close(key_value, batch, members, "size"))
            members = []
        return (fold, key_value, batch, members), out

    def on_time(state: Any, passed: int) -> tuple[Any, list[tuple]]:
        fold, key_value, batch, members = state
        if not members or members[0] + latency_ms > passed:
            return state, []
        return ((0, 0), key_value, batch, []), [close(key_value, batch, members, "age")]

    return keyed_process(events, key, at, order, watermark, f"`{key}` {kind}, batch long, n long, first_at long, last_at long, reason string", on_event, on_time, lambda s: s[3][0] + latency_ms if s[3] else None)
