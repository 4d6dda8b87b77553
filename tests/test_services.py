"""Ingest, records, consumers and upkeep on small literal inputs."""

import io
import json
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text as tx
from stratalens.operators import compose, control, maintenance, reports
from stratalens.session import with_rank
from stratalens.sources import files, readers, records, writers
from stratalens.streaming import consumer, folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


DOCX = zipped(word__document='<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:tab/><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
PPTX = zipped(ppt__slides__slide1='<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:sp><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sp></p:sld>')
XLSX = zipped(
    xl__sharedStrings='<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>size</t></si><si><t>oak</t></si></sst>',
    xl__worksheets__sheet1='<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>',
)
STREAM = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td (next) Tj ET")
PDF = b"%PDF-1.4\n4 0 obj\n<< /Length " + str(len(STREAM)).encode() + b" /Filter /FlateDecode >>\nstream\n" + STREAM + b"\nendstream\nendobj\n"


def tone(loud, rate=8000, seconds=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", x) for x in ([0] * (rate * seconds) + [loud, -loud] * (rate * seconds // 2))))
    return out.getvalue()


def test_texts_of_files(spark, tmp_path):
    bodies = {"a.docx": DOCX, "b.pptx": PPTX, "c.xlsx": XLSX, "d.csv": b'name,size\noak,"7, big"\n', "e.txt": "caf\u00e9 \ud83d".encode("utf-8", "surrogatepass"), "f.doc": b"old", "g.pdf": PDF, "h.docx": b"broken"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = files.checked(files.files(spark, str(tmp_path)), 10_000)
    got = {r.uri.rsplit("/", 1)[1]: r for r in files.read_texts(found).collect()}
    assert [got[x].text for x in ("a.docx", "b.pptx", "c.xlsx", "d.csv", "g.pdf")] == ["First\tline\nSecond", "Title\nPoint", "name: oak, : , size: 7", "name: oak, size: 7, big", "Hello (you)\nnext"]
    assert got["e.txt"].text.startswith("caf\u00e9") and got["f.doc"].text is None and "legacy" in got["f.doc"].error and got["h.docx"].error
    small = files.checked(files.files(spark, str(tmp_path)), 5).where("reason is not null")
    assert small.where("content is null and sha256 is null").count() == small.count() > 0


def test_chunks_have_offsets(spark):
    df = spark.createDataFrame([(1, "  one two\n three  four five "), (2, " "), (3, None)], "id int, text string")
    rows = files.chunk_texts(df, target=2, overlap=1).orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end, r.chunk) for r in rows] == [(2, 9, "one two"), (6, 16, "two\n three"), (11, 22, "three  four"), (18, 27, "four five"), (23, 27, "five")]


def test_sound(spark):
    loud = tone(16384)
    assert files.sound_facts(loud)["duration_ms"] == 2000
    levels = files.loudness(loud, 0.5, 0.5, 10)
    assert [x[:2] for x in levels] == [(0, 500), (500, 1000), (1000, 1500), (1500, 2000)] and levels[0][2] == float("-inf") and levels[3][2] == pytest.approx(-6.0206, abs=1e-3)
    df = spark.createDataFrame([("a", bytearray(loud)), ("b", bytearray(b"no sound"))], "uri string, content binary")
    assert [(r.uri, r.window) for r in files.sound_windows(df, window_s=0.5, hop_s=0.5, most=3, silence_db=-30.0).collect()] == [("a", 2)]
    assert files.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 5)) == ("png", 3, 5) and files.image_size(b"GIF89a" + struct.pack("<HH", 4, 6)) == ("gif", 4, 6)
    assert files.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 9, 8) + b"\0" * 9) == ("jpeg", 8, 9) and files.image_size(b"x") is None
    assert one(spark, files.spoken(F.lit(None).cast("string"), F.lit(5)))[0].end_ms == 5


def test_compaction_writes_and_checks(spark, tmp_path):
    rows = []
    for run in ("r1", "r2", "r3"):
        for kind in ("core", "text"):
            path = str(tmp_path / "in" / run / kind)
            spark.range(4).select(F.lit(run).alias("run"), "id", F.lit(kind).alias("kind")).coalesce(1).write.parquet(path)
            for f in spark.read.parquet(path).select("_metadata.file_path").distinct().collect():
                rows.append(("V", run, kind, f[0], 4, 100.0))
    rows.append(("V", "r4", "core", "missing", 1, 1.0))  # without its text: not eligible
    listed = spark.createDataFrame(rows, "entity string, run_id string, kind string, uri string, rows long, bytes double")
    audits = maintenance.compact(spark, listed, {"V": ("core", "text")}, str(tmp_path / "out"), "c1", low=150.0, high=250.0, most=10)
    assert sorted((r.kind, r.batch, r.rows_in, r.rows_out) for r in audits.collect()) == [("core", 0, 8, 8), ("core", 1, 4, 4), ("text", 0, 8, 8), ("text", 1, 4, 4)]
    both = [spark.read.parquet(str(tmp_path / "out/vertices/V" / kind / "c1/batch=0")).select("run", "id").collect() for kind in ("core", "text")]
    assert both[0] == both[1]  # groups still match by position
    maintenance.compaction_audit(audits, str(tmp_path / "audit"), {"run": "c1"})
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert lines[0] == {"run": "c1"} and len(lines) == 5
    wrong = listed.where("run_id <> 'r4'").withColumn("rows", F.col("rows") + 1)
    with pytest.raises(maintenance.RowCountError):
        maintenance.compact(spark, wrong, {"V": ("core",)}, str(tmp_path / "out2"), "c2", low=150.0, high=250.0, most=10)


def test_audit_compaction(spark, tmp_path):
    paths = []
    for i in range(3):
        spark.createDataFrame([(i,)], "n int").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        paths.append(str(tmp_path / f"f{i}"))
    listed = spark.createDataFrame([("log", u, float(i), 10) for i, u in enumerate(paths)] + [("log", "young", 99.0, 10)], "log string, uri string, mtime double, bytes long")
    cut = maintenance.audit_batches(listed, by="log", min_age_s=50.0, now=100.0, low=1000, high=2000, most_files=2, most_batches=5)
    assert sorted((r.uri, r.batch) for r in cut.collect()) == [(paths[0], 0), (paths[1], 0)]  # a single file is no batch
    bad = cut.unionByName(spark.createDataFrame([("log", str(tmp_path / "nowhere"), 0.0, 1, 1)], cut.schema))
    done, failed = maintenance.compact_audit_logs(spark, bad, str(tmp_path / "logs"))
    assert [d["rows"] for d in done] == [2] and [f["batch"] for f in failed] == [1]
    assert maintenance.audit_batches(listed, by="log", min_age_s=0.0, now=100.0, low=1, high=2, most_files=1, most_batches=5).count() == 0


def test_collection(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.parquet").write_bytes(b"x" * (i + 1))
    listing = readers.listing(spark, str(tmp_path))
    kept = spark.createDataFrame([(str(tmp_path / "p0.parquet"),)], "uri string")
    found = maintenance.gc_candidates(listing, kept, exclude=[str(tmp_path / "p2")])
    assert maintenance.collect_files(spark, found)["candidates"] == 1 and (tmp_path / "p1.parquet").exists()
    assert maintenance.collect_files(spark, found, dry_run=False) == {"dry_run": False, "candidates": 1, "bytes": 2, "deleted": 1}
    assert not (tmp_path / "p1.parquet").exists() and (tmp_path / "p0.parquet").exists()


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "_manifest string, id int")
    runs = lambda *names: spark.createDataFrame([(n,) for n in names], "uri string")
    build = lambda path, fp, *names, **more: maintenance.build_snapshot(spark, {"t": rows}, runs(*names), str(tmp_path / path), fingerprint=fp, **more)
    first = build("s1", "a", "m1")
    assert (first.decision, first.rows) == ("full", {"t": 1})
    base = str(tmp_path / "s1")
    assert build("s2", "a", "m1", "m2", base=base).decision == "skip" and build("s2", "b", "m1", base=base).decision == "skip"
    assert build("s2", "b", "m1", "m2", base=base, least=2).decision == "defer"
    more = build("s2", "b", "m1", "m2", base=base)
    assert (more.decision, more.rows) == ("incremental", {"t": 2}) and build("s3", "c", "m1", "m2", "m3", base=base, most=1).decision == "full"
    assert build("s4", "c", "m1", base=str(tmp_path / "nothing")).decision == "full" and maintenance.read_sidecar(spark, str(tmp_path / "nothing")) is None
    assert [r.run_id for r in maintenance.sample_runs(runs("m1", "m2", "m3").withColumnRenamed("uri", "run_id"), 2).collect()] == ["m3", "m2"]


def test_records(spark, tmp_path):
    root, clock, held = str(tmp_path), [0.0], []
    buffer = records.RecordBuffer(held.extend, size=3, seconds=5.0, clock=lambda: clock[0])
    assert [buffer.add({"action": "a"}) for _ in range(3)] == [False, False, True] and len(held) == 3
    clock[0] = 6.0
    assert buffer.add({"action": "b"}) and records.RecordBuffer(held.extend).add({"action": "c"}) and len(held) == 5
    assert records.append_records(spark, held, records.AUDIT, root, "AuditLog") == 5
    log = records.records(spark, root, "AuditLog", records.AUDIT)
    assert log.where("id is not null and created_at is not null").count() == 5 and readers.audit_log(log, action="a", limit=2).count() == 2
    records.create_dataset(spark, root, "set", labels=[" x ", "", "y"])
    records.add_annotation(spark, root, dataset_id="d", label="cat")
    records.append_records(spark, [{"units": 3}], records.USAGE, root, "UsageEvent")
    assert records.records(spark, root, "Dataset", records.DATASET).first().tags == "x,y" and records.records(spark, root, "Annotation", records.ANNOTATION).first().status == "active"
    assert records.records(spark, str(tmp_path / "none"), "Dataset", records.DATASET).count() == 0
    with pytest.raises(records.SchemaError):
        records.append_records(spark, [{"colour": 1}], records.USAGE, root, "UsageEvent")
    vectors = spark.createDataFrame([("1", [1.0, 2.0])], "id string, v array<float>")
    fits = records.checked(vectors, "id long, v array<float>, more string", vectors={"v": 2})
    assert fits.first() == (1, [1.0, 2.0], None)
    fits.coalesce(1).write.parquet(str(tmp_path / "parts"))
    part = records.written_files(spark, str(tmp_path / "parts")).first()
    assert part.rows == 1 and len(part.sha256) == 64 and part.bytes_written > 0
    with pytest.raises(records.SchemaError):
        records.checked(vectors, "id long")
    with pytest.raises(Exception, match="vectors of 3"):
        records.checked(vectors, "id string, v array<float>", vectors={"v": 3}).collect()
    records.cost_lines(spark.createDataFrame([("a", 1.5)], "asset string, cost double"), str(tmp_path / "cost"))
    assert spark.read.json(str(tmp_path / "cost")).first().cost == 1.5 and records.new_ids(spark.range(2)).select("id").distinct().count() == 2


def test_webhooks(spark):
    hook, waits, answers = records.Webhook("h", "http://x", secret="s"), [], [503, None, 200]

    def post(url, body, headers, timeout):
        assert headers["X-Event-Signature"] == records.signature("s", headers["X-Event-Timestamp"], body)
        got = answers.pop(0)
        if got is None:
            raise OSError("down")
        return got

    status, tried = records.deliver(hook, {"id": "e"}, records.DeliveryOptions(), post, sleep=waits.append)
    assert status == "success" and [t["status_code"] for t in tried] == [503, None, 200] and waits == [0.5, 1.0]
    assert records.deliver(hook, {"id": "e"}, records.DeliveryOptions(), lambda *a: 404, sleep=waits.append)[0] == "failed" and len(waits) == 2
    assert records.deliver(records.Webhook("h", "u", enabled=False), {}, records.DeliveryOptions(), post, sleep=waits.append) == ("skipped", [])
    rows = records.deliver_rows(spark.createDataFrame([("1",), ("2",)], "id string"), [records.Webhook("h", "u")], records.DeliveryOptions(attempts=2), lambda *a: 500, sleep=lambda s: None)
    assert sorted((r.event_id, r.attempt) for r in rows.collect()) == [("1", 1), ("1", 2), ("2", 1), ("2", 2)]
    letter = records.dead_letters(spark.createDataFrame([("1",)], "id string"), F.lit("bad"), F.lit(5)).first().value
    assert json.loads(letter) == {"event": {"id": "1"}, "error": "bad", "attempts": 5}


def test_consumer(spark, tmp_path):
    state = str(tmp_path / "state")
    event = lambda n: {"bucket": "b", "name": n, "generation": "1", "stream_id": "s"}
    messages = lambda *names: spark.createDataFrame([(json.dumps({"events": [event(n) for n in names]}),)], "value string")
    process = lambda df: df.select("key", (F.col("name") != "bad").alias("ok"), F.sha2("name", 256).alias("digest"))
    assert consumer.consume(messages("a", "a", "bad"), 0, state, process, attempts=2) == {"start": 2}
    assert consumer.consume(messages("a", "bad"), 1, state, process, attempts=2) == {"skip_done": 1, "start": 1}
    assert consumer.consume(messages("bad"), 2, state, process, attempts=2) == {"dead": 1}
    assert consumer.consume(messages("bad"), 3, state, process, attempts=2) == {"skip_done": 1}
    assert {r.status for r in consumer.latest_state(spark, state).collect()} == {"COMPLETED", "DLQ"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text(json.dumps({"events": [event("c")]}))
    stream = spark.readStream.text(str(tmp_path / "in"))
    consumer.run_stream(stream, str(tmp_path / "state2"), process, checkpoint=str(tmp_path / "check"), once=True).awaitTermination()
    assert [r.status for r in consumer.latest_state(spark, str(tmp_path / "state2")).collect()] == ["COMPLETED"]
    assert consumer.rejected(90, 11, 100) and not consumer.rejected(90, 10, 100) and consumer.flush_wait(0) == 0.25 and consumer.flush_wait(2) == 1


def test_edge_buffer(tmp_path):
    clock, sent = [100.0], []
    buffer = consumer.EdgeBuffer(str(tmp_path), max_bytes=10, ttl_s=50, clock=lambda: clock[0])
    for body in (b"aaaa", b"bbbb", b"cccc"):
        buffer.add(body, {"n": body.decode()})
        clock[0] += 1
    assert [p.read_bytes() for _, p in buffer.items()] == [b"bbbb", b"cccc"]  # the oldest went
    assert buffer.replay(lambda body, meta: sent.append(meta["n"]) or body != b"cccc") == 1 and sent == ["bbbb", "cccc"] and len(buffer.items()) == 1
    clock[0] = 200.0
    assert buffer.prune() == 1 and not buffer.items()


def test_settings_and_plans(spark):
    env = {"A": "yes", "B": "12", "C": "x", "D": "text=1.5, audio=.5", "E": "a, ,b"}
    got = [control.setting(env, "A", False, bool), control.setting(env, "B", 0, int), control.setting(env, "C", 7, int), control.setting(env, "D", {}, dict), control.setting(env, "E", [], list), control.setting(env, "F", "z")]
    assert got == [True, 12, 7, {"text": 1.5, "audio": 0.5}, ["a", "b"], "z"]
    assert one(spark, control.sampling_rate(F.lit(100.0), fps=2, most=50)) == 0.5 and one(spark, control.sampling_rate(F.lit(0.0), most=5)) == 1 and one(spark, control.sampling_rate(F.lit(1.0), interval_s=5, most=9)) == 1
    assert one(spark, tx.ascii_fold(F.lit("Café Ñandú ﬁ 日本 ß"))) == "Cafe Nandu  " .rstrip() + "   "
    assert compose.looks_like_id("INV-2026-001") and not compose.looks_like_id("video query") and not compose.looks_like_id("")
    calls = []
    encode = compose.memo(lambda t: calls.append(t) or [1.0])
    assert encode("a") == encode("a") == (1.0,) and calls == ["a"]
    assert compose.with_timeout(lambda: 3, 5) == compose.with_timeout(lambda: 3, None) == 3
    import time

    with pytest.raises(compose.InferenceTimeout):
        compose.with_timeout(lambda: time.sleep(1), 0.05)
    now = F.lit("2026-01-04 00:00:00").cast("timestamp")
    never = F.lit(None).cast("timestamp")
    due = lambda s: one(spark, control.schedule_due(s, now, never))
    assert [due(s) for s in ("0 0 * * 7", "0 0 * * 0", "*/0 * * * *", "0 0 31 * *", "61 * * * *", "every 0m", "@weekly", "0 0 4,5 1 *")] == [True, True, False, False, False, False, True, True]


def test_ranks_and_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in ("d", "b", "a", "c")], "x string").repartition(3)
    assert [(r.x, r.place) for r in with_rank(df, "x", name="place").orderBy("x").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    many = spark.range(100_001).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    got = {r.g: r for r in reports.exact_percentiles(many, ["g"], {"p50": ("v", 0.5), "p99": ("v", 0.99)}).collect()}
    want = {r.g: r for r in many.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.99)).alias("p99")).collect()}
    assert all(got[g].p50 == pytest.approx(want[g].p50) and got[g].p99 == pytest.approx(want[g].p99) for g in want)
    hot = spark.range(50_000).select(F.when(F.col("id") < 49_000, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert reports.exact_percentiles(hot, [], {"p50": ("v", 0.5), "p100": ("v", 1.0)}).first() == (50_000, 1.0, 49_999.0)


def test_fold_of_a_long_key(spark):
    df = spark.range(30_000).select(F.lit("k").alias("key"), "id").repartition(5)
    got = folds.fold_by_key(df, "key", ["id"], lambda s, r: ((s or 0) + r["id"], (s or 0) + r["id"]), "total", "long")
    assert got.agg(F.max("total")).first()[0] == sum(range(30_000))


def test_run_query_keeps_unranked_rows(spark):
    assets = spark.createDataFrame([("a", "u://a", "text"), ("b", "u://b", "image")], "id string, uri string, media_type string")
    chunks = spark.createDataFrame([(f"c{i}", "a", "red fox" if i == 5 else "blue", "text", 0, [1.0, i / 10]) for i in range(6)], "id string, media_asset_id string, content string, source_type string, source_time_ms long, vector array<double>")
    images = spark.createDataFrame([("i1", "b", 5, [1.0, 0.0])], "id string, media_asset_id string, timestamp_ms long, vector array<double>")
    snap = {"media_assets": assets, "doc_chunks": chunks, "image_assets": images}
    request = compose.Request(query="red fox", vectors={"text": [1.0, 0.0], "clip": [1.0, 0.0]}, top_k=10)
    rows = compose.run_query(snap, request, rerank=True, min_candidates=2, skip_gap=1.1).collect()
    assert len(rows) == 7 and {r.rerank_status for r in rows} == {"applied"}
    image = next(r for r in rows if r.modality == "image")
    assert image.score == image.base_score and image.why[0].weight == 0.8
    few = compose.run_query(snap, request, rerank=True, min_candidates=9).collect()
    assert {r.rerank_status for r in few} == {"skipped_low_candidate_count"} and all(r.score == r.base_score for r in few)
    page = compose.respond(compose.run_query(snap, request), compose.Request(query="red fox", top_k=3, page_limit=2, group_by="video"))
    assert {r.asset_id: (r.clip_count, r.total) for r in page.collect()} == {"a": (6, 2), "b": (1, 2)}
    assert compose.run_query({"media_assets": assets}, compose.Request(query="x")).count() == 0
    writers.tags([])


def test_registry(spark):
    r = spark.createDataFrame([(1, "o", "x"), (2, None, "x"), (3, "p", "y"), (4, "o", "x")], "pos int, org_id string, kind string")
    assert [x.pos for x in records.last_entries(records.scoped_entries(r, org_id="o"), "pos", 2, kind="x").collect()] == [2, 4]
    assert records.registry(r, kind="y", org_id=None).count() == 1


def png(pixels, kind=2, filters=None):
    depth, chunk = {0: 1, 2: 3, 6: 4}[kind], lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body, above = b"", [0] * len(pixels[0])
    for n, row in enumerate(pixels):
        how = (filters or [0] * len(pixels))[n]
        left = lambda r, i: r[i - depth] if i >= depth else 0
        coded = []
        for i, x in enumerate(row):
            a, b, c = left(row, i), above[i], left(above, i)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((x - [0, a, b, (a + b) // 2, paeth][how]) & 255)
        body, above = body + bytes([how, *coded]), row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]) // depth, len(pixels), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_thumbnails():
    pixels = [[(13 * x * y + 7 * x) % 256 for x in range(24)] for y in range(5)]
    plain = files.thumbnail(png(pixels), 100)
    assert all(files.thumbnail(png(pixels, filters=[f] * 5), 100) == plain for f in range(5))
    small = files.thumbnail(png([[10, 20, 30, 40], [10, 20, 30, 40]], kind=0), 2)
    assert files.image_size(small) == ("png", 2, 1) and small == files.thumbnail(png([[15, 35]], kind=0), 9)
    assert files.thumbnail(b"GIF89a" + b"\0" * 40, 5) is None


def test_ingest(spark, tmp_path):
    from stratalens.operators import ingest

    source, root = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    (source / "a.txt").write_text(" ".join(f"word{i}" for i in range(300)))
    (source / "b.csv").write_text("name,size\noak,7\n")
    (source / "c.png").write_bytes(png([[1, 2, 3]]))
    (source / "d.wav").write_bytes(tone(16384))
    (source / "e.exe").write_bytes(b"x")
    (source / "f.docx").write_bytes(b"broken")
    refused = ingest.ingest(spark, str(source), root, "r1", window_s=0.5, hop_s=0.5)
    assert sorted((r.uri.rsplit("/", 1)[1], r.reason.split(":")[0]) for r in refused.collect()) == [("e.exe", "extension"), ("f.docx", "BadZipFile")]
    chunks = ingest.ingested(spark, root, "DocChunk", "r1").collect()
    assert len(chunks) == 4 and all(len(c.vector) == 768 for c in chunks) and {c.content for c in chunks if c.token_end == 4} == {"name: oak, size: 7"}
    assert all(abs(x - y) < 1e-6 for x, y in zip(chunks[0].vector, control.stub_embedding(chunks[0].content, 768)))
    image = ingest.ingested(spark, root, "ImageAsset", "r1").first()
    assert (image.format, image.width, image.height, len(image.vector)) == ("png", 1, 1, 512)
    assert sorted(r.start_ms for r in ingest.ingested(spark, root, "AudioSegment", "r1").collect()) == [1000, 1500]
    listed = ingest.manifest_of(spark, root, "r1")
    assert listed.where("vertex = 'DocChunk'").select("kind").distinct().count() == 3 and listed.where("kind = 'adj_list'").agg(F.sum("rows")).first()[0] == 7
    edges = spark.read.parquet(f"{root}/edges/DerivedFrom/adj_list/r1")
    assets = ingest.ingested(spark, root, "MediaAsset", "r1")
    assert edges.join(assets, edges.dst_id == assets.id).count() == 7


def test_requests():
    ok = {"top_k": 5, "query": "x"}
    control.check_request(**ok)
    wrong = [{"kind": "graph"}, {"group_by": "colour"}, {"sort_by": "name"}, {"kind": "metadata"}, {"kind": "keyword", "query": None, "metadata": {"a": 1}}, {"image": "i" * 9, "image_bytes": 8}, {"image": "i", "kind": "keyword"}, {"image": "i", "modalities": ["text"]}]
    for more in wrong:
        with pytest.raises(control.RequestError):
            control.check_request(**ok | more)
    control.check_request(top_k=5, kind="metadata", metadata={"field": "asset_type"})


def test_admission_previews_and_paths(spark, tmp_path):
    why = lambda name, kind, m=None: one(spark, readers.admission(F.lit(name), F.lit(kind), None if m is None else F.lit(m)))
    assert [why("a.MD", "text/markdown"), why("a.mp4", None, "audio"), why("a.mp3", "audio/mp3; x", "audio"), why("a", "")] == [None, "extension", None, "extension"]
    for i in range(2):
        spark.range(i * 10, i * 10 + 5).write.parquet(str(tmp_path / f"p{i}"))
    spark.range(3).select("id", F.lit(1.5).alias("v")).write.parquet(str(tmp_path / "p2"))
    both = readers.parquet_by_name(spark, [str(tmp_path / f"p{i}") for i in range(3)])
    rows, total = readers.preview(both, 2)
    assert rows.count() == 2 and total == 13 and both.where("v is null").count() == 10
    assert writers.manifest_path(writers.graph_root("b://x/", "/g/"), "r") == "b://x/g/manifests/r/manifest.json"
    people = spark.createDataFrame([("ocr", "a@b.co"), ("text", "a@b.co")], "modality string, t string")
    writers.export(people, str(tmp_path / "e"), "jsonl", redacted=["t"], policies=[{"types": ["email"], "modalities": ["ocr"], "contexts": ["export"]}])
    assert {r.modality: r.t for r in spark.read.json(str(tmp_path / "e")).collect()} == {"ocr": "[REDACTED]", "text": "a@b.co"}


def test_vector_index(spark, sf, tmp_path):
    from stratalens.operators import index, search
    from stratalens.sources.snapshots import SnapshotLog

    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    lists = index.build_index(v, str(tmp_path / "ix"))
    assert lists == 22 and SnapshotLog(spark, str(tmp_path / "ix")).read("vectors").count() == v.count()
    hit = wanted = 0
    for row in v.where("id % 50 = 0").collect():
        exact = {r.id for r in search.nearest(v, row.vector, 10, vector="vector", tie="id").collect()}
        found = {r.id for r in index.search_index(spark, str(tmp_path / "ix"), row.vector, 10).collect()}
        hit, wanted = hit + len(exact & found), wanted + len(exact)
    assert hit / wanted >= 0.9, hit / wanted
    assert index.build_index(v.limit(0), str(tmp_path / "none")) == 0


def test_model_scores(spark):
    hits = spark.createDataFrame([(f"e{i}", "document", 1.0 - i / 10, t) for i, t in enumerate(("a b c", None, "", "b c d e", "x"))], "evidence_id string, modality string, score double, snippet string")
    seen = compose.model_scores(hits, "b c more words", lambda q, texts: [len(set(q.split()) & set(t.split())) + len(texts) / 100 for t in texts], query_tokens=2, tokens=3, batch=2)
    got = {r.evidence_id: r.model_score for r in seen.collect()}
    assert got["e1"] is None and got["e2"] is None and [int(got[x]) for x in ("e0", "e3", "e4")] == [2, 2, 0] and seen.columns == [*hits.columns, "model_score"]
    from stratalens.operators import fusion

    ranked = fusion.rerank(seen, F.col("model_score"), order=[F.desc("score")], min_candidates=2, skip_gap=2.0)
    assert {r.evidence_id: r.score == r.base_score for r in ranked.collect()}["e1"]
