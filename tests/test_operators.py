"""Operators on small literal inputs."""

import base64

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.functions import text as tx
from stratalens.functions.vectors import cosine_distance, cosine_distance_arrow, decibels, score_of_bm25
from stratalens.operators import control, fusion, graph, policy, reports, search
from stratalens.plans.filters import FilterError, compile_filter
from stratalens.sources import files, readers, writers
from stratalens.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    out = one(spark, tx.redact(F.lit("Email test@example.com or call 415-555-1234. SSN 123-45-6789 card 4242 4242 4242 4242.")))
    assert "[REDACTED]" in out and not any(x in out for x in ("test@example.com", "415-555-1234", "123-45-6789", "4242 4242"))


@pytest.mark.parametrize("query, yes", [("INV-2026-001", True), ("error code 500", False), ("video query", False), ("ABCDEF", True), ("abc", False), ("", False)])
def test_id_like(spark, query, yes):
    assert one(spark, tx.id_like(F.lit(query))) is yes


def test_token_f1_orders(spark):
    assert one(spark, tx.token_f1(F.lit("alarm alarm"), "alarm sound")) > one(spark, tx.token_f1(F.lit("cat photo"), "alarm sound")) == 0


def test_highlight(spark):
    assert one(spark, tx.highlight(F.lit("One two. Red  fox\nruns. Blue"), "the red FOX")) == "Red fox runs"
    assert one(spark, tx.highlight(F.lit(None).cast("string"), "x")) is None


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "id int, text string")
    rows = tx.chunk_windows(df, target=4, overlap=1).orderBy("chunk_index").collect()
    assert [(r.token_start, r.token_end, r.chunk) for r in rows] == [(0, 4, "0 1 2 3"), (3, 7, "3 4 5 6"), (6, 10, "6 7 8 9"), (9, 10, "9")]


def test_cosine_forms_agree(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],), ([0.0, 0.0],)], "v array<float>")
    rows = df.select(cosine_distance("v", [1.0, 0.0]).alias("a"), cosine_distance_arrow([1.0, 0.0])("v").alias("b")).collect()
    assert abs(rows[0].a) < 1e-12 and rows[1].a == pytest.approx(rows[1].b) == pytest.approx(1 - 2**-0.5) and rows[2].a != rows[2].a


def test_small_math(spark):
    assert one(spark, score_of_bm25(F.lit(2.5))) == pytest.approx(2.5 / 3.5) and one(spark, score_of_bm25(F.lit(-1.0))) == 0
    assert one(spark, decibels(F.lit(0.0))) == float("-inf") and one(spark, decibels(F.lit(0.1))) == pytest.approx(-20)
    assert one(spark, search.boost(F.lit(0.5), "image", "a photo")) == pytest.approx(0.5 * 1.05 * 1.15)


def test_fusion_merges_one_key(spark):
    hits = spark.createDataFrame([("document", "a", 0.9), ("document", "a", 0.8)], "modality string, key string, score double")
    row = fusion.reciprocal_rank_fusion(hits, ["key"], tie=["key"], why=True).collect()
    assert len(row) == 1 and row[0].score == 1.0 and len(row[0].why) == 2


def test_interval_merge(spark):
    rows = [("a", 0, 5000, 0.8), ("a", 5000, 10000, 0.79), ("a", 11000, 12000, 0.1), ("b", 0, 5000, 0.9)]
    df = spark.createDataFrame(rows, "asset string, start_ms long, end_ms long, score double")
    out = sorted((r.asset, r.start_ms, r.end_ms, r.n_merged, r.score) for r in fusion.merge_intervals(df, ["asset"], 500).collect())
    assert out == [("a", 0, 10000, 2, 0.8), ("a", 11000, 12000, 1, 0.1), ("b", 0, 5000, 1, 0.9)]


def test_backfill_keeps_weak_segment(spark):
    seg = spark.createDataFrame([("s", 0.1)], "asset string, score double")
    clips = spark.createDataFrame([(f"c{i}", 1.0) for i in range(6)] + [("s", 1.0)], "asset string, score double")
    rows = fusion.backfill(seg, clips, "asset", 5, order=[F.desc("score"), F.col("asset")]).collect()
    assert len(rows) == 5 and rows[0].asset == "s" and rows[0].tier == 0


def test_normalised_and_selection(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (2.0,)], "raw double")
    x = [r.normalised for r in fusion.normalised_scores(df).orderBy("raw").collect()]
    assert x == sorted(x) and 0 < x[0] < x[2] < 1
    many = spark.createDataFrame([(i, 1.0 - i / 10, 100) for i in range(8)], "i int, score double, chars long")
    assert fusion.rerank_selection(many, top_n=8, min_candidates=2, budget=250, order=[F.desc("score")]).count() == 2


def test_cursor():
    c = fusion.encode_cursor({"q": "x"}, "s1", 20)
    assert fusion.decode_cursor(c, {"q": "x"}, "s1") == 20 and fusion.decode_cursor(None, {}, "") == 0
    for query, snapshot, cursor in (({"q": "y"}, "s1", c), ({"q": "x"}, "s2", c), ({"q": "x"}, "s1", "!!")):
        with pytest.raises(fusion.CursorError):
            fusion.decode_cursor(cursor, query, snapshot)


def test_filters(spark):
    df = spark.createDataFrame([("a1", "video", 1200), ("a2", None, 8000), (None, "video", None)], "asset_id string, asset_type string, start_ms long").withColumn("end_ms", F.col("start_ms"))
    count = lambda f: df.where(compile_filter(f)).count()
    assert count({"all": [{"field": "asset_type", "op": "eq", "value": "video"}, {"field": "start_ms", "op": "between", "value": [1000, 2000]}]}) == 1
    assert count({"not": {"field": "start_ms", "op": "gt", "value": 1000}}) == 1  # null compares as false
    assert count({"field": "asset_type", "op": "nin", "value": ["video"]}) == 1
    assert count({"field": "asset_id", "op": "in", "value": ["a1", None]}) == 2
    assert count({"field": "created_at", "op": "exists"}) == 0
    for bad in ({"field": "x", "op": "eq", "value": 1}, {"field": "start_ms", "op": "between", "value": [1]}, {"all": []}, {"field": "metadata.k", "op": "eq", "value": 1}):
        with pytest.raises(FilterError):
            compile_filter(bad)


def test_scope(spark):
    df = spark.createDataFrame([("o1",), (None,)], "org_id string")
    assert search.scoped(df, org_id="o1", site_id=None).count() == 1
    with pytest.raises(ValueError):
        search.scoped(df, site_id="s")
    assert search.with_scope_defaults(df, {"org_id": "d", "site_id": "s"}).where("org_id = 'd' and site_id = 's'").count() == 1


def test_retention(spark):
    df = spark.createDataFrame([(x,) for x in (0, 7, 15, 30, 120)], "age int")
    assert [r[0] for r in df.select(policy.retention_tier(F.col("age"), 7, 30, 90)).collect()] == ["hot", "warm", "warm", "cold", "delete"]


def test_alerts(spark):
    rules = spark.createDataFrame([("r", ["asset.detected"], ["image"], 0.8, ["person"]), ("all", ["*"], None, None, None)], "rule string, types array<string>, modalities array<string>, min_confidence double, rule_tags array<string>")
    events = spark.createDataFrame([(1, "asset.detected", "image", 0.9, ["person", "vehicle"]), (2, "asset.detected", "image", 0.5, ["person"])], "id int, event_type string, modality string, confidence double, tags array<string>")
    assert sorted((r.id, r.rule) for r in policy.match_rules(events, rules).collect()) == [(1, "all"), (1, "r"), (2, "all")]


def test_rollout_and_positions(spark):
    stages = graph.rollout_stages(spark.range(10), "id").groupBy("stage").count().orderBy("stage").collect()
    assert [r["count"] for r in stages] == [1, 4, 5]
    assert graph.even_positions(10, 4) == [0, 3, 6, 9] and graph.even_positions(3, 5) == [0, 1, 2] and graph.even_positions(0, 3) == []


def test_promotion(spark):
    a = spark.createDataFrame([(12345,)], "source_ref_id int")
    b = spark.createDataFrame([("3f2c-uuid", 1)], "source_ref_id string, extra int")
    out = graph.append_by_name(a, b)
    assert out.schema["source_ref_id"].dataType.simpleString() == "string" and {r.source_ref_id for r in out.collect()} == {"12345", "3f2c-uuid"}


def test_compaction_batches(spark):
    df = spark.createDataFrame([("e", i, 4.0) for i in range(5)] + [("e", 9, 50.0)], "entity string, run long, bytes double")
    rows = graph.first_fit_batches(df, "entity", "run", "bytes", low=10.0, high=15.0, most=10).orderBy("run").collect()
    assert [r.batch for r in rows] == [0, 0, 0, 1, 1, 2]


def test_folds(spark):
    df = spark.createDataFrame([(1, "k", 0, "ok"), (2, "k", 10, "ok"), (3, "j", 0, "running"), (4, "j", 5, "ok"), (5, "j", 500, "failed"), (6, "j", 501, "ok")], "event_id long, key string, at long, outcome string")
    got = {r.event_id: r.action for r in folds.idempotency(df, "key", "at", "outcome", ttl_ms=100, attempts=2).collect()}
    assert got == {1: "start", 2: "skip_done", 3: "start", 4: "skip_running", 5: "start", 6: "dead"}
    times = spark.createDataFrame([(i, "k", t) for i, t in enumerate((0, 1, 2, 5000))], "event_id long, key string, at long")
    assert [r.batch for r in folds.flush_batches(times, "key", "at", most=2, latency_ms=2000).orderBy("event_id").collect()] == [0, 0, 1, 2]
    assert [r.allowed for r in folds.token_bucket(times, "key", "at", per_minute=2).orderBy("event_id").collect()] == [True, True, False, False]


def test_sources_and_sinks(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1,)], "id int").write.parquet(a)
    spark.createDataFrame([("x", 2.0)], "id string, v double").write.parquet(b)
    assert sorted(map(tuple, readers.parquet_by_name(spark, [a, b]).collect()), key=str) == [("1", None), ("x", 2.0)]
    stats = writers.write_parts(spark.range(10).coalesce(1), str(tmp_path / "c"))
    assert stats.first().rows == 10 and readers.listing(spark, str(tmp_path / "c")).count() >= 1
    writers.export(spark.createDataFrame([("a@b.co",)], "t string"), str(tmp_path / "d"), "csv", redacted=["t"])
    assert readers.tabular(spark, str(tmp_path / "d")).first().t == "[REDACTED]"
    (tmp_path / "g/manifests/r1").mkdir(parents=True)
    (tmp_path / "g/manifests/r1/manifest.json").write_text('{"schema_version": "1", "completed_at": "2026-01-01", "files": [{"uri": "x/vertices/DocChunk/core/part-1.parquet", "rows": 2}, {"uri": "x/vertices/DocChunk/text/part-1.parquet", "rows": 2}]}')
    groups = readers.file_groups(readers.manifest_files(readers.manifests(spark, str(tmp_path / "g/manifests/*/manifest.json")))).collect()
    assert [(g.run_id, g.vertex, g.core is not None, g.vector) for g in groups] == [("r1", "DocChunk", True, None)]
    assert one(spark, readers.base_name(F.lit("gs://b/x/part-1.parquet?sig=1"))) == "part-1.parquet"
    assert one(spark, readers.modality_of_path(F.lit("raw/videos/a.mp4"))) == "video" and one(spark, readers.admission(F.lit("a.mp4"), F.lit("text/plain; x"))) == "content_type"
    events = spark.createDataFrame([('{"events": [{"bucket": "b", "name": "n", "generation": "1", "stream_id": "s"}, {"bucket": "b"}]}',)], "value string")
    assert readers.decode_batches(events).count() == 1


def test_file_groups_go_through_one_exchange(spark, monkeypatch):
    """Ordinals and groups share an exchange, whose parts follow the number of files; a constant vertex too."""
    monkeypatch.setattr(readers, "GROUP_FILES", 10)
    rows = [(r, f"{r}-{kind}-{i}", kind) for r in ("a", "b", None) for kind, n in (("core", 12), ("text", 3), ("adj_list", 14)) for i in range(n)]
    files = spark.createDataFrame(rows, "run_id string, uri string, kind string")
    for vertex in (F.lit("V"), F.col("run_id")):
        groups = readers.file_groups(files.withColumn("vertex", vertex))
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f", {-(-len(rows) // 10)}), REPARTITION_BY_NUM" in plan
        got = {(g.run_id, g.nth): (g.core, g.text, g.vector) for g in groups.collect()}
        of = lambda r, kind, n: (sorted(u for x, u, k in rows if x == r and k == kind)[n - 1 : n] or [None])[0]
        assert got == {(r, n): (of(r, "core", n), of(r, "text", n), None) for r in ("a", "b", None) for n in range(1, 15)}


def test_control(spark):
    from stratalens.operators import control

    assert control.retrieval_modalities(["video"]) == {"image"} and control.retrieval_modalities(["text", "audio"]) == {"document", "transcript", "audio"}
    for bad in ({"top_k": 0, "query": "x"}, {"top_k": 5, "page_limit": 9, "query": "x"}, {"top_k": 5}):
        with pytest.raises(control.RequestError):
            control.check_request(**bad)
    with pytest.raises(control.RequestError):
        control.retrieval_modalities(["smell"])
    v = control.stub_embedding("hello", 768)
    assert len(v) == 768 and sum(x * x for x in v) == pytest.approx(1) and v == control.stub_embedding("hello", 768)
    now, last = F.lit("2026-01-05 10:30:20").cast("timestamp"), F.lit("2026-01-05 10:30:01").cast("timestamp")
    assert one(spark, control.schedule_due("every 5m", now, last)) is False and one(spark, control.schedule_due("30 10 * * 1", now, last)) is False
    assert one(spark, control.schedule_due("30 10 * * 1", now, F.lit(None).cast("timestamp"))) is True and one(spark, control.schedule_due("bad", now, last)) is False
    assert one(spark, control.frame_times(F.lit("x pts_time:1.5 y pts_time:12"))) == [1500, 12000]
    assert one(spark, control.digits_to_long(F.lit("12"))) == 12 and one(spark, control.digits_to_long(F.lit("1x"))) is None
    assert one(spark, control.first_of(F.create_map(F.lit("org"), F.lit("o")), ("org_id", "org"))) == "o"
    assert control.build_decision(same_fingerprint=False, fresh=0, base_exists=True, compacted=False) == "skip"
    assert control.build_decision(same_fingerprint=False, fresh=5, base_exists=True, compacted=False) == "incremental"
    assert control.build_decision(same_fingerprint=False, fresh=5, base_exists=False, compacted=False) == "full"
    stats = control.buffer_stats(spark.createDataFrame([("b", 3, 10.0), ("b", 4, 2.0)], "k string, size long, age double"), "k", "size", "age").first()
    assert (stats["count"], stats.bytes, stats.oldest, stats.newest) == (2, 7, 10.0, 2.0)


def test_base64url_of_long_values(spark):
    for n in (56, 57, 58, 200, 3000):
        token = tx.base64url(F.lit("a" * n).cast("binary"))
        assert one(spark, token) == base64.urlsafe_b64encode(b"a" * n).decode().rstrip("=")
        assert one(spark, tx.from_base64url(token).cast("string")) == "a" * n


def test_a_buffer_that_is_just_full(spark):
    """Sizes that add up to the bound keep all items, though their floating-point sum passes it; unknown ages come last."""
    rows = [(0, 0.1, 1), (1, 0.2, 1), (2, 0.3, 1), (3, 5.0, None), (4, 0.1, 20)]
    assert 0.1 + 0.2 + 0.3 > 0.6
    items = spark.createDataFrame([(1, *r) for r in rows], "k long, id long, size double, age long")
    go = lambda most: {r["id"]: r["evicted"] for r in control.evicted(items, "k", "age", "size", order=[F.asc_nulls_last("age"), F.asc_nulls_last("id")], ttl=20, most=most).collect()}
    assert go(0.6) == {0: False, 1: False, 2: False, 3: None, 4: True}
    assert go(0.5) == {0: False, 1: False, 2: True, 3: True, 4: True}


def test_percentiles_meet_their_brackets_without_a_shuffle_of_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    out = reports.exact_percentiles(df, ["g"], {"p": ("v", 0.5)})
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in tree
    assert {r["g"]: r["p"] for r in out.collect()} == {0: 499.5, 1: 499.0, 2: 500.0}


def test_windows_leave_in_parts(spark, monkeypatch):
    """Windows of one long text leave a task a few at a time, with the columns that are kept."""
    monkeypatch.setattr(files, "CHUNK_CHARS", 100)
    text = " ".join(f"w{i}" for i in range(500))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "a b")], "id long, text string").repartition(1)
    got = files.chunk_texts(rows, keep=["id"]).orderBy("id", "chunk_index").collect()
    assert [r["id"] for r in got] == [1] * 5 + [3] and all(r["chunk"] == (text if r["id"] == 1 else "a b")[r["char_start"] : r["char_end"]] for r in got)
    assert files.chunk_texts(rows).columns[:2] == ["id", "text"]
    cut = files._windows(128, 112)([pa.record_batch([pa.array([1]), pa.array([text])], names=["id", "_text"])])
    assert [b.num_rows for b in cut] == [1] * 5
