"""Claims and their compaction, timers on streams, keyset pages."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import fusion, graph
from stratalens.sources.snapshots import SnapshotLog
from stratalens.streaming import consumer, folds, timers


def messages(spark, *names):
    return spark.createDataFrame([(json.dumps({"events": [{"bucket": "b", "name": n, "generation": "1", "stream_id": "s"} for n in names]}),)], "value string")


def work(df):
    return df.select("key", (F.col("name") != "bad").alias("ok"), F.sha2("name", 256).alias("digest"))


def crash(df):
    raise InterruptedError


def states(spark, path):
    return {(r.status, r.attempts) for r in consumer.latest_state(spark, path).collect()}


def test_crash_between_claim_and_finish_counts(spark, tmp_path):
    path = str(tmp_path / "state")
    for _ in range(2):
        with pytest.raises(InterruptedError):
            consumer.consume(messages(spark, "a", "b"), 0, path, crash, attempts=3)
    assert states(spark, path) == {("PROCESSING", 2)}
    # another consumer's batch leaves fresh claims alone, and takes them over when they are old
    assert consumer.consume(messages(spark, "a"), 1, path, work, attempts=3) == {"skip_running": 1}
    assert consumer.consume(messages(spark, "a", "b"), 0, path, work, attempts=3) == {"start": 2}
    assert states(spark, path) == {("COMPLETED", 3)}
    assert consumer.consume(messages(spark, "a", "b"), 0, path, crash, attempts=3) == {"finished": 2}  # marked: not run again
    for _ in range(2):
        with pytest.raises(InterruptedError):
            consumer.consume(messages(spark, "c"), 2, path, crash, attempts=2)
    assert consumer.consume(messages(spark, "c"), 2, path, work, attempts=2) == {"dead": 1} and ("DLQ", 2) in states(spark, path)
    later = F.current_timestamp() + F.expr("interval 2 hours")
    with pytest.raises(InterruptedError):
        consumer.consume(messages(spark, "d"), 3, path, crash)
    assert consumer.consume(messages(spark, "d"), 4, path, work, now=later) == {"start": 1}


def test_state_read_is_bounded(spark, tmp_path):
    path = str(tmp_path / "state")
    for batch in range(7):
        consumer.consume(messages(spark, f"k{batch % 2}", "bad"), batch, path, work, attempts=4, compact_every=2)
    left = sorted(p.name for p in (tmp_path / "state/changes").iterdir())
    assert left == ["batch=0000000004", "batch=0000000005", "batch=0000000006"]  # what the compaction before the last doesn't hold
    assert sorted(p.name for p in (tmp_path / "state/compacted").iterdir()) == ["upto=0000000003", "upto=0000000005"]
    assert states(spark, path) == {("COMPLETED", 1), ("DLQ", 4)} and consumer.latest_state(spark, path).count() == 3
    much_later = F.current_timestamp() + F.expr("interval 3 days")
    assert consumer.compact_state(spark, path, 6, now=much_later, retain_s=86_400) == 0 and consumer.latest_state(spark, path).count() == 0
    assert consumer.latest_state(spark, str(tmp_path / "none")).count() == 0


def run_cut(spark, folder, rows, cuts, build):
    """Rows written as so many files, a micro-batch each, through a query to a table in memory."""
    schema = "event_id long, user string, ms long, note long"
    for i, part in enumerate(cuts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").json(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{folder}/in")
    name = "t" + folder.name.replace("-", "_")
    build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streams_equal_tables(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((i, rng.choice("ab"), rng.randint(0, 20_000), None if i % 3 else i) for i in range(80)), key=lambda r: r[2])
    rows += [(1_000, "end", 10_000_000, 1), (1_001, "end", 10_000_001, 1)]
    table = spark.createDataFrame(rows, "event_id long, user string, ms long, note long").where("user <> 'end'")
    bucket = {(r.event_id, r.note): r.allowed for r in folds.token_bucket(table, "user", "ms", per_minute=60).collect()}
    batches = folds.flush_batches(table, "user", "ms", most=6, latency_ms=1_500)
    want = {tuple(r) for r in batches.groupBy("user", "batch").agg(F.count("*"), F.min("ms"), F.max("ms")).collect()}
    shuffled = [list(range(0, 20)), *[[i] for i in range(20, 23)], list(range(40, 22, -1)), list(range(41, 80)), [80], [81]]
    for n, cuts in enumerate(([list(range(80)), [80], [81]], shuffled)):
        folder = tmp_path / f"b{n}"
        got = run_cut(spark, folder, rows, cuts, lambda s: timers.stream_token_bucket(s, "user", "ms", per_minute=60, watermark="30 seconds"))
        assert {(r.event_id, r.note): r.allowed for r in got.collect() if r.user != "end"} == bucket and len(bucket) == 80
        folder = tmp_path / f"c{n}"
        got = run_cut(spark, folder, rows, cuts, lambda s: timers.stream_batches(s, "user", "ms", most=6, latency_ms=1_500, watermark="30 seconds")).where("user <> 'end'").collect()
        assert {(r.user, r.batch, r.n, r.first_at, r.last_at) for r in got} == want and len(got) == len(want)
        assert {r.reason for r in got} == {"age", "size"}  # the last ones of a and b are closed by their timers


def in_pages(df, keys, limit, **pin):
    out, cursor = [], None
    while True:
        page = fusion.keyset_page(df, {"q": 1}, keys, limit, cursor, **pin).collect()
        out += [r["id"] for r in page]
        if len(page) < limit:
            return out
        cursor = fusion.keyset_cursor({"q": 1}, pin.get("snapshot", ""), keys, page[-1])


@pytest.mark.parametrize("limit", [1, 4, 7, 100])
def test_pages_join_under_ties_and_nulls(spark, limit):
    rng = random.Random(1)
    day = datetime.datetime(2024, 1, 1, 12, 30, 0, 123456)
    rows = [(i, rng.choice([None, 0.1, float("nan"), 0.30000000000000004, -1.5]), rng.choice([None, "a", "é", ""]), rng.choice([None, day, day + datetime.timedelta(microseconds=1)]), rng.choice([True, False, None])) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, score double, name string, seen timestamp, flag boolean").coalesce(1).cache()
    orders = [
        [fusion.SortKey("score", descending=True), fusion.SortKey("name"), fusion.SortKey("id")],
        [fusion.SortKey("seen", nulls_last=True), fusion.SortKey("score", descending=True, nulls_last=False), fusion.SortKey("id", descending=True)],
        [fusion.SortKey("flag"), fusion.SortKey("name", descending=True, nulls_last=False), fusion.SortKey("id")],
    ]
    for keys in orders if limit > 1 else orders[:1]:
        assert in_pages(df, keys, limit) == [r["id"] for r in df.orderBy(*[k.order() for k in keys]).collect()]


def test_keyset_cursors(spark, tmp_path):
    keys = [fusion.SortKey("score", descending=True), fusion.SortKey("id")]
    df = spark.range(10).select("id", (F.col("id") % 3).cast("double").alias("score"))
    first = fusion.keyset_page(df, {"q": 1}, keys, 3).collect()
    cursor = fusion.keyset_cursor({"q": 1}, "7", keys, first[-1])
    assert fusion.read_keyset(cursor, {"q": 1}, keys, "7") == ("7", ["2.0", "8"])
    for query, order, snapshot in (({"q": 2}, keys, "7"), ({"q": 1}, keys[::-1], "7"), ({"q": 1}, keys, "8")):
        with pytest.raises(fusion.CursorError):
            fusion.read_keyset(cursor, query, order, snapshot)
    with pytest.raises(fusion.CursorError):
        fusion.read_keyset("nonsense", {"q": 1}, keys)
    df.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = fusion.keyset_page(stored, {"q": 1}, keys, 3, cursor, "7")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(score,2.0)" in plan
    # pages of one snapshot, while rows are added
    log = SnapshotLog(spark, str(tmp_path / "s"))
    log.append({"t": df})
    pinned, want = log.version(), [r["id"] for r in df.orderBy(F.desc("score"), "id").collect()]
    log.append({"t": df.withColumn("id", F.col("id") + 100)})
    assert in_pages(log.read("t", pinned), keys, 4, snapshot=str(pinned)) == want


@pytest.mark.parametrize("longest", [13, 60])
def test_long_keys_in_ranges(spark, longest):
    """A key over many ranges gives what one task gives; so do short keys that share ranges."""
    rng = random.Random(longest)
    rows = [(i, rng.choice("aaaaaaaab") if i % 40 else rng.choice("cdefgh"), rng.randint(0, 60_000), rng.choice(["ok", "failed", "lost"]), rng.randint(1, 100)) for i in range(130)]
    events = spark.createDataFrame(rows, "event_id long, user string, ms long, outcome string, bytes long").repartition(3).cache()
    folded = {
        "flush": lambda **x: folds.flush_batches(events, "user", "ms", most=7, latency_ms=1_000, **x),
        "bucket": lambda **x: folds.token_bucket(events, "user", "ms", per_minute=60, **x),
        "idempotency": lambda **x: folds.idempotency(events, "user", "ms", "outcome", ttl_ms=3_000, attempts=40, **x),
        "first fit": lambda **x: graph.first_fit_batches(events, "user", "event_id", "bytes", low=150, high=220, most=5, **x),
    }
    for name, fold in folded.items():
        assert sorted(map(tuple, fold(longest=longest).collect())) == sorted(map(tuple, fold().collect())), name
    ranged = folds.flush_batches(events, "user", "ms", most=7, latency_ms=1_000, longest=longest)
    assert ranged.withColumn("_task", F.spark_partition_id()).where("user = 'a'").select("_task").distinct().count() > 1


def test_long_keys_of_little(spark):
    none = spark.createDataFrame([], "event_id long, user string, ms long")
    assert folds.flush_batches(none, "user", "ms", longest=0).count() == 0 and folds.fold_in_ranges(none, "user", ["ms"], lambda s, r: (s, True), "x", "boolean").count() == 0
    null = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", 7)], "event_id long, user string, ms long")
    assert sorted(r.batch for r in folds.flush_batches(null, "user", "ms", longest=1).collect()) == [0, 0, 0]


def test_folds_work_out_events_once(spark):
    """In ranges too, whose second look stops where both states meet; a step sees the columns it uses."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "a" if i < 380 else "b", i * 7 % 50) for i in range(400)]
    events = spark.createDataFrame(rows, "id long, key string, size long").mapInArrow(count, "id long, key string, size long")

    def step(state, row):
        assert set(row) == {"size"}
        total = (state or 0) + row["size"]
        return (0 if total >= 120 else total), not state

    got = {}
    for longest in (1000, 37):
        made.value = 0
        folded = folds.fold_by_key(events, "key", ["id"], step, "batch", "long", counted=True, longest=longest, uses=["size"])
        got[longest] = sorted(map(tuple, folded.collect()))
        assert made.value == 400
    want, state, flags = [], {}, {}
    for i, k, size in rows:
        state[k], opens = step(state.get(k), {"size": size})
        flags[k] = flags.get(k, -1) + opens
        want.append((i, k, size, flags[k]))
    assert got[1000] == got[37] == want
