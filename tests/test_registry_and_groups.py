"""Registries with Bloom filters, column groups in buckets, messages and windows of long keys and texts."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import maintenance
from stratalens.operators.registry import Registry
from stratalens.sources.files import chunk_texts
from stratalens.sources.groups import ColumnGroups
from stratalens.sources.records import as_messages


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry_reads_few_buckets(spark, tmp_path):
    rows = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id", F.lit("x").alias("bucket"))
    own = Registry.create(spark, str(tmp_path / "r"), rows.schema, ["digest"], buckets=32)
    assert own.unseen(rows).count() == 4000 and own.matching(rows).count() == 0  # nothing in it yet
    own.append(rows.where("id < 2000"))
    own.append(rows.where("id >= 2000"))
    some = rows.where("id in (7, 2007)")
    probe = own.probe(some)
    assert probe.buckets == 64 and 2 <= len(probe.read) <= 4
    read = own.matching(some)
    assert set(rows.where("id in (7, 2007)").collect()) <= set(read.collect()) and read.count() < 4000 / 8
    assert len(read.inputFiles()) <= 2 * len(probe.read)
    foreign = spark.range(10_000, 14_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    passed = own.probe(foreign).keys.count()
    assert passed < 4000 * 2 * 0.02  # two filters asked
    assert own.unseen(foreign.unionByName(rows.select("digest"))).count() == 4000  # what passes by chance is verified away


def test_registry_compaction_and_awkward_keys(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 2, 3), ("", None, 4), ("", 0, 5)], "k string, n long, v int")
    own = Registry.create(spark, path, rows.schema, ["k", "n"], buckets=4)
    assert own.compact() is None
    for _ in range(2):
        own.append(rows)
    own.append(rows.limit(0))
    asked = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("", None), ("", 0), ("a", 1)], "k string, n int")  # narrower keys are cast
    want = sorted([("a", 2), (None, 2), ("", None)], key=str)
    assert sorted((tuple(r) for r in own.unseen(asked).collect()), key=str) == want
    before = sorted(own.matching(asked).where("k = 'a'").collect())
    merged = own.compact()
    assert [r["generation"] for r in own.generations()] == [merged] and own.generations()[0]["n_rows"] == 10
    again = Registry(spark, path)
    assert sorted(again.matching(asked).where("k = 'a'").collect()) == before and len(before) == 4
    assert sorted((tuple(r) for r in again.unseen(asked).collect()), key=str) == want
    assert again.unseen(asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Registry.create(spark, str(tmp_path / "s"), rows.schema, ["other"])


def test_registry_of_one_hot_key(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    own = Registry.create(spark, str(tmp_path / "r"), rows.schema, ["k"], buckets=8)
    own.append(rows)
    assert own.matching(spark.createDataFrame([("hot",)], "k string")).where("k = 'hot'").count() == 1000


def test_groups_join_without_exchange(spark, tmp_path):
    path = str(tmp_path / "g")
    groups = ColumnGroups.create(spark, path, buckets=4)
    one = spark.range(500).select(F.lit("f0").alias("group_id"), F.col("id").alias("row_number"), F.col("id").alias("core"))
    text = one.select("group_id", "row_number", F.concat(F.lit("t"), "core").alias("the `text`"))
    groups.write("core", one)
    groups.write("body", text.where("row_number < 400"))
    both = groups.stitch("core", "body")
    assert both.count() == 400 and both.where("`the ``text``` = concat('t', core)").count() == 400
    kept = groups.stitch("core", "body", how="left")
    assert kept.count() == 500
    for df in (both, kept):
        assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
    assert "the `text`" not in plan_of(groups.read("core"))  # other groups' columns aren't read
    more = one.withColumn("group_id", F.lit("f1"))
    groups.write("core", more, append=True)
    groups.write("body", text.withColumn("group_id", F.lit("f1")), append=True)
    assert groups.stitch("core", "body").groupBy("group_id").count().orderBy("group_id").collect() == [("f0", 400), ("f1", 500)]
    for name in ("core", "body"):
        groups.drop(name)
    again = ColumnGroups(spark, path).stitch("core", "body")  # as a session that has never seen them
    assert again.count() == 900 and "Exchange" not in plan_of(again)
    for bad in ("layout", "no name"):
        with pytest.raises(ValueError):
            groups.write(bad, one)


def test_messages_of_a_hot_batch(spark):
    events = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("user"), F.format_string("%04d", "id").alias("name"))
    sent = as_messages(events, F.col("user"), ["name"], most=50).collect()
    hot = sorted((r for r in sent if r.batch == "hot"), key=lambda r: r.first)
    assert [r.first for r in hot] == list(range(0, 900, 50)) and len(sent) == 18 + 100
    names = [e["name"] for r in hot for e in json.loads(r.value)["events"]]
    assert names == [f"{i:04d}" for i in range(900)]
    by_bytes = as_messages(events, F.col("user"), ["name"], most=1000, most_bytes=200).collect()
    assert max(len(r.value) for r in by_bytes) < 200 + 60
    assert sorted(e["name"] for r in by_bytes for e in json.loads(r.value)["events"]) == [f"{i:04d}" for i in range(1000)]
    with pytest.raises(ValueError):
        as_messages(events, F.col("user"), ["name"], most=0)


def test_windows_of_a_long_text(spark):
    long = " \n".join(f"wörd{i}" for i in range(60_000))
    rows = [(1, long), (2, None), (3, ""), (4, " \t\n"), (5, "a b  c"), (6, "  x")]
    out = chunk_texts(spark.createDataFrame(rows, "id int, text string"), target=128, overlap=16)
    seen = [r for r in out.collect() if r.id == 1]
    assert len(seen) == -(-60_000 // 112) and all(long[r.char_start : r.char_end] == r.chunk for r in seen)
    assert max(r.token_end for r in seen) == 60_000
    assert sorted((r.id, r.char_start, r.char_end, r.token_end, r.chunk) for r in out.where("id > 1").collect()) == [(5, 0, 6, 2, "a b  c"), (6, 2, 3, 1, "x")]


def test_compaction_of_equal_file_names(spark, tmp_path):
    listed = []
    for run in ("r1", "r2"):
        folder = tmp_path / "in" / run
        spark.range(4).select(F.lit(run).alias("run"), "id").coalesce(1).write.parquet(str(folder))
        (part,) = folder.glob("*.parquet")
        part.rename(folder / "part-0.parquet")
        for crc in folder.glob(".*.crc"):
            crc.unlink()
        listed.append(("V", run, "core", str(folder / "part-0.parquet"), 4, 100.0))
    files = spark.createDataFrame(listed, "entity string, run_id string, kind string, uri string, rows long, bytes double")
    audits = maintenance.compact(spark, files, {"V": ("core",)}, str(tmp_path / "out"), "c", low=50.0, high=150.0, most=10)
    assert sorted((r.batch, r.rows_in, r.rows_out) for r in audits.collect()) == [(0, 4, 4), (1, 4, 4)]
