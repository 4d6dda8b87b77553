"""Versioned snapshots, the quantised vector index and the term index."""

import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions.stems import porter
from stratalens.operators import index, maintenance, search, terms
from stratalens.sources.snapshots import CommitConflict, SnapshotLog


def rows_of(spark, start, stop, manifest, **more):
    df = spark.range(start, stop).select("id", *[F.lit(v).alias(k) for k, v in more.items()])
    return df.withColumn("_manifest", F.lit(manifest))


def test_append_writes_new_rows_only(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "s"))
    assert log.version() == -1 and log.append({"t": rows_of(spark, 0, 10, "a")}, ["a"]) == 0
    both = rows_of(spark, 0, 10, "a").unionByName(rows_of(spark, 10, 13, "b", extra="x"), True)
    assert log.append({"t": both}, ["a", "b"]) == 1 and log.append({"t": both}, ["a", "b"]) is None
    written = log.files().where("version = 1").agg(F.sum("n_rows")).first()[0]
    assert written == 3 and log.read("t").count() == 13 and log.read("t", 0).columns == ["id"]
    assert {tuple(r) for r in log.read("t").groupBy("extra").count().collect()} == {(None, 10), ("x", 3)}
    assert log.pruned("t", id=(11, 11)).count() == 1 and log.read("t", id=[12]).where("id = 12").count() == 1
    assert log.pruned("t", id=(None, -1)).count() == 0 and log.pruned("t", id=(13, None)).count() == 0
    with pytest.raises(TypeError):
        log.append({"t": spark.createDataFrame([("x",)], "id string")})
    with pytest.raises(ValueError):
        log.read("other")
    assert log.append({"t": rows_of(spark, 0, 0, "none")}, ["none"]) == 2 and log.read("t").count() == 13


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "s")
    SnapshotLog(spark, path).append({"t": rows_of(spark, 0, 5, "a")}, ["a"])
    with pytest.raises(CommitConflict):  # both looked at version 0
        SnapshotLog(spark, path).append({"t": rows_of(spark, 5, 6, "b")}, ["b"], read_version=0)
        SnapshotLog(spark, path).append({"t": rows_of(spark, 5, 6, "b")}, ["b"], read_version=0)
    assert SnapshotLog(spark, path).append({"t": rows_of(spark, 6, 9, "c")}, ["c"], read_version=0) == 2  # another manifest: the next number
    log = SnapshotLog(spark, path)
    assert sorted(r.id for r in log.read("t").collect()) == list(range(9))
    some = log.pruned("t", id=(0, 4))
    kept = log.read("t", id=(0, 4)).where("id < 3")
    assert log.replace("t", kept, some, read_version=2) == 3 and log.read("t", 2).count() == 9
    with pytest.raises(CommitConflict):
        log.replace("t", kept, some, read_version=2)
    results = []

    def write():
        try:
            results.append(SnapshotLog(spark, path).append({"t": rows_of(spark, 20, 22, "d")}, ["d"], read_version=3))
        except CommitConflict:
            results.append("lost")

    threads = [threading.Thread(target=write) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results.count("lost") == 2 and SnapshotLog(spark, path).read("t").where("id >= 20").count() == 2


def test_checkpoints_and_dead_files(spark, tmp_path):
    path = str(tmp_path / "s")
    for i in range(12):
        SnapshotLog(spark, path).append({"t": rows_of(spark, i, i + 1, f"m{i}").coalesce(1)}, [f"m{i}"])
    log = SnapshotLog(spark, path)
    assert (tmp_path / "s" / "_log" / f"{9:020d}.checkpoint").is_dir()
    for i in range(9):
        (tmp_path / "s" / "_log" / f"{i:020d}.json").unlink()  # the checkpoint stands for them
    assert log.read("t").count() == 12 and log.manifests().count() == 12 and log.append({"t": rows_of(spark, 0, 1, "m0")}, ["m0"]) is None
    log.replace("t", log.read("t").where("id > 5"), log.pruned("t"))
    gone = log.dead_files()
    assert log.read("t").count() == 6 and gone.count() == 12 and log.dead_files(keep=2).count() == 0
    assert maintenance.collect_files(spark, gone, dry_run=False)["deleted"] == 12 and SnapshotLog(spark, path).read("t").count() == 6


def test_update_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    source = lambda *ms: {"t": rows_of(spark, 0, 4, "a").unionByName(rows_of(spark, 4, 6, "b")).unionByName(rows_of(spark, 6, 7, "c")).where(F.col("_manifest").isin(*ms))}
    named = lambda *ms: spark.createDataFrame([(m,) for m in ms], "uri string")
    steps = [(("a",), "full", {"t": 4}), (("a", "b"), "incremental", {"t": 2}), (("a", "b"), "skip", {})]
    for ms, decision, rows in steps:
        report = maintenance.update_snapshot(spark, source(*ms), named(*ms), path)
        assert (report.decision, report.rows) == (decision, rows)
    assert maintenance.update_snapshot(spark, source("a", "b", "c"), named("a", "b", "c"), path, least=2).decision == "defer"
    whole = maintenance.update_snapshot(spark, source("a", "b", "c"), named("a", "b", "c"), path, compacted=True)
    assert whole.decision == "full" and whole.rows == {"t": 7} and SnapshotLog(spark, path).read("t").count() == 7


def clustered(n, dims, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 0.25


def nearest(points, ids, query, k):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    apart = 1 - unit @ (query / np.linalg.norm(query))
    return [int(ids[i]) for i in np.lexsort((ids, np.round(apart, 12)))[:k]]


def test_vector_index_on_clusters(spark, tmp_path):
    """Recall of 0.95 at less than a fifth of the bytes; exact searches miss nothing; inserts and deletions hold."""
    path, points = str(tmp_path / "ix"), clustered(6_000, 32, 60)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>").repartition(4)
    extra = spark.createDataFrame([(-1, None), (-2, [0.0] * 32)], "id long, vector array<float>")
    lists = index.build_index(vectors.unionAll(extra), path, lists=40)
    assert lists == 40
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    log = SnapshotLog(spark, path)
    assert log.read("vectors").count() == 6_000  # null and zero vectors have no direction
    ids, points = np.arange(6_000), points.astype(np.float32).astype(np.float64)
    want = {q: nearest(points, ids, points[q], 10) for q in range(0, 6_000, 50)}

    def found(**options):
        got = {}
        for r in index.search_many(spark, path, asked, 10, **options).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        return got

    fast = found(probes=6, rerank=8)
    assert np.mean([len(set(fast[q]) & set(want[q])) / 10 for q in want]) >= 0.95
    codes, whole = 8 + 8 + index.WIDTH * 0 + 32 // index.WIDTH, 32 * 4
    assert (6_000 * 6 / 40 * 2 * codes + 80 * whole) / (6_000 * whole) < 0.2  # lists of twice the mean size, and what is measured
    assert found(exact=True) == want
    model = index.load_model(log)
    assert (model.radius > 0).sum() > 30 and index.load_model(SnapshotLog(spark, str(tmp_path / "none"))) is None

    more = clustered(200, 32, 60, seed=9).astype(np.float32).astype(np.float64)
    index.insert_vectors(spark.createDataFrame([(10_000 + i, p.tolist()) for i, p in enumerate(more)], "id long, vector array<float>"), path)
    before = SnapshotLog(spark, path).version()
    index.delete_vectors(spark, path, vectors.where("id % 3 = 1").select("id"))
    assert SnapshotLog(spark, path).version() == before + 1 and index.delete_vectors(spark, path, vectors.where("id = 1").select("id")) == before + 1
    keep = np.flatnonzero(ids % 3 != 1)
    points, ids = np.concatenate([points[keep], more]), np.concatenate([keep, 10_000 + np.arange(200)])
    of = dict(zip(ids.tolist(), points))
    asked = asked.where("qid % 3 <> 1")
    assert found(exact=True) == {q: nearest(points, ids, of[q], 10) for q in want if q % 3 != 1}


def test_vector_index_of_little(spark, tmp_path):
    path = str(tmp_path / "ix")
    few = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 1.0, 0.0])], "id long, vector array<double>")
    assert index.build_index(few, path) == 2
    got = index.search_index(spark, path, [0.0, 3.0, 0.0], 10, exact=True).collect()
    assert [r["id"] for r in got] == [2, 3, 4, 1] and got[0]["score"] == 1.0
    nothing = spark.createDataFrame([(0, [0.0, 0.0, 0.0])], "qid int, vector array<double>")
    assert index.search_many(spark, path, nothing, 3).count() == 0 and index.search_many(spark, str(tmp_path / "no"), nothing, 3).count() == 0


def test_a_version_is_taken_once(spark, tmp_path):
    """Writers that put the same version at one moment: one wins, and its actions are those that stand."""
    log = SnapshotLog(spark, str(tmp_path / "s"))
    for version in range(40):
        start, won = threading.Barrier(8), []

        def put(i):
            start.wait()  # noqa: B023
            if log._put(version, [{"op": "commit", "id": f"w{i}", "manifests": []}], f"w{i}"):  # noqa: B023
                won.append(f"w{i}")  # noqa: B023

        threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and won[0] in (tmp_path / f"s/_log/{version:020d}.json").read_text()
    assert not list((tmp_path / "s/_log/drafts").glob("w*"))


def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def test_term_index_is_the_whole_scan(spark, sf, tmp_path):
    path, docs = str(tmp_path / "terms"), texts(spark, sf).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "license " * 400)], "doc_id long, text string"))
    assert terms.build_terms(docs, path, size=16) == docs.count()
    skipped = 0
    for query in ("the public license", "license", "the", "zzz", "", "license zzz the and of"):
        for k in (1, 5, 1000):
            found = terms.search_terms(spark, path, query, k)
            want = search.bm25(docs, "doc_id", "text", query).orderBy(F.desc("score"), "doc_id").limit(k).collect()
            got = found.hits.collect()
            assert [r["key"] for r in got] == [r["doc_id"] for r in want] and [r["score"] for r in got] == pytest.approx([r["score"] for r in want])
            skipped += found.ranges.where("not looked_at").count()
    assert skipped > 5
    terms.build_terms(docs.where("doc_id < 10"), path)  # a new build takes the place of the old one
    assert terms.search_terms(spark, path, "the", 1000).hits.agg(F.max("key")).first()[0] in (None, *range(10))


def test_stems_stop_words_and_accents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Connected connections"), (2, "connecting the café"), (3, "relate RELATIONAL"), (4, "the the the")], "doc_id long, text string")
    path = str(tmp_path / "terms")
    terms.build_terms(docs, path, analysis=terms.Analysis(accents=True, stems=True, stop_words=("the",)))
    of = lambda q: {r["key"] for r in terms.search_terms(spark, path, q, 10).hits.collect()}
    assert of("connection") == {1, 2} and of("cafe") == of("CAFÉ") == {2} and of("relating") == {3} and of("the") == set()


def test_term_index_build_counts_whole_texts(spark, tmp_path, monkeypatch):
    """Words at the edges of texts, letters that aren't a to z, slices and ranges of a few entries: postings as counted in plain Python."""
    monkeypatch.setattr(terms, "SLICE_BYTES", 40)
    monkeypatch.setattr(terms, "RANGE_ENTRIES", 6)
    monkeypatch.setattr(terms, "PART_WORDS", 10)
    rows = [("a", "cat"), ("b", "cat"), ("c", None), ("d", ""), ("e", "  Dog-dog\u00e9dog \u212aelvin 12x"), ("f", " ".join(f"w{chr(97 + i)}" for i in range(20)) + " cat"), ("g", "!!"), ("h", "the cat the")]
    for size in (1, 100):
        path = str(tmp_path / f"t{size}")
        assert terms.build_terms(spark.createDataFrame(rows, "k string, text string"), path, key="k", size=size) == len(rows)
        blocks = SnapshotLog(spark, path).read("blocks").collect()
        got = {(b.term, k, int.from_bytes(b.figures[8 * i : 8 * i + 4]), int.from_bytes(b.figures[8 * i + 4 : 8 * i + 8])) for b in blocks for i, k in enumerate(b["keys"])}
        want = set()
        for k, text in rows:
            words = re.findall("[a-z]+", (text or "").lower())
            want |= {(w, k, words.count(w), len(words)) for w in words}
        assert got == want and sum(b.n for b in blocks) == len(want) and len({(b.term, b.range) for b in blocks}) == len(blocks)
        held = {}
        for b in blocks:
            held[b.range] = held.get(b.range, 0) + b.n
        assert all(n <= 6 or n == 21 for n in held.values())
        found = terms.search_terms(spark, path, "cat", 10)
        assert {r["key"] for r in found.hits.collect()} == {"a", "b", "f", "h"}


def test_term_index_is_built_by_few_exchanges(spark, sf, tmp_path, monkeypatch):
    """Texts move once and blocks once: nothing goes word by word."""
    plans, write = [], SnapshotLog.write
    monkeypatch.setattr(SnapshotLog, "write", lambda log, name, rows, commit: plans.append(rows._jdf.queryExecution().toString()) or write(log, name, rows, commit))
    terms.build_terms(texts(spark, sf), str(tmp_path / "t"), size=16)
    blocks = plans[0].split("== Physical Plan ==")[1]
    assert blocks.count("Exchange") == 2 and "Join" not in blocks and "collect_list" not in blocks


def test_porter():
    """Words and stems of the published paper."""
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]


def test_running_values_over_ranges(spark):
    """What comes before a row is the same whether its key is one task's or spans ranges; keys may be null."""
    from stratalens.operators import fusion
    from stratalens.session import running

    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else "ab"[int(rng.random() < 0.1)], int(rng.integers(0, 400)), None if i % 7 == 0 else int(rng.integers(0, 50))) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, asset string, start_ms long, length long").repartition(3)
    got = {r["id"]: (r["top"], r["total"]) for r in running(df, ["asset"], ["start_ms", "id"], 9, top=("max", F.col("length")), total=("sum", F.col("length"))).collect()}
    want = {}
    for asset in (None, "a", "b"):
        own = sorted((r for r in rows if r[1] == asset), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(own):
            seen = [x[3] for x in own[:i] if x[3] is not None]
            want[r[0]] = (max(seen), sum(seen)) if seen else (None, None)
    assert got == want and running(df.limit(0), ["asset"], ["id"], 3, top=("max", F.col("length"))).count() == 0
    hits = df.withColumn("end_ms", F.col("start_ms") + F.col("length")).withColumn("score", F.lit(1.0))
    plain, ranged = (fusion.merge_intervals(hits, ["asset"], 2, tie=("id",), **x) for x in ({}, {"longest": 12}))
    assert sorted(map(str, plain.drop("island").collect())) == sorted(map(str, ranged.drop("island").collect()))
    top = fusion.group_moments(hits.withColumn("score", F.col("length").cast("double")), "asset", order=[F.desc("score"), F.col("id")], keep=2)
    assert {(r["asset"], r["clip_count"]) for r in top.collect()} == {(a, sum(r[1] == a for r in rows)) for a in (None, "a", "b")} and top.count() == 6
