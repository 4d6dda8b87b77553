"""Nearest neighbours by slices of rows and blocks of queries."""

import numpy as np
import pytest

from stratalens.operators import blocks, index
from stratalens.plans.catalogue import QUERIES
from stratalens.sources.snapshots import SnapshotLog


def vectors(spark, n, width=6):
    rng = np.random.default_rng(4)
    made = [rng.normal(size=width).round(1).tolist() for _ in range(n)]
    made[5:40] = [made[5]] * 35  # ties beyond k
    made[41], made[42], made[50] = [0.0] * width, None, [0.0] * width
    return made, spark.createDataFrame(list(enumerate(made)), "id long, vector array<float>").repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_nearest_of_each(spark, monkeypatch, small):
    """As by all pairs, ties by key, zero and null vectors last; however the work is cut."""
    if small:
        for name, n in (("SLICE", 40), ("QUERIES", 7), ("CHUNK", 16), ("PAIRS", 50)):
            monkeypatch.setattr(blocks, name, n)
    made, df = vectors(spark, 200)
    asked = df.where("id % 5 = 0").selectExpr("id as qid", "vector")
    got = {}
    for r in blocks.nearest_of_each(df, asked, 12, key="id", vector="vector").orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    m = np.array([v or [0.0] * 6 for v in made], np.float32).astype(np.float64)
    for q in range(0, 200, 5):
        d = blocks.cosine_distances(m, np.broadcast_to(m[q], m.shape))
        assert got[q] == np.lexsort((np.arange(200), d))[:12].tolist()
    assert blocks.nearest_of_each(df.limit(0), asked, 3, key="id", vector="vector").count() == 0


def test_eval_metrics_make_no_pairs(spark, sf):
    plan = QUERIES["q31_eval_metrics"](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_searches_hand_on_few_rows(spark, tmp_path, monkeypatch):
    """A call hands on no more of a query than is asked for, however many lists there are."""
    monkeypatch.setattr(blocks, "SLICE", 100)
    made, df = vectors(spark, 200)
    path = str(tmp_path / "ix")
    index.build_index(df, path, lists=30, words=8)
    log = SnapshotLog(spark, path)
    model, stored = index.load_model(log), log.read("vectors")
    asked = df.where("id % 5 = 0 and id <> 50").selectExpr("id as qid", "vector", "double('inf') as reach")
    assert index._sure(stored, asked, model, 10, "id", "vector").count() == 390
    near = index._candidates(stored, asked, model, "id", probes=30, most=20)
    assert near.count() == 780
    exact = index.search_many(spark, path, asked, 12, exact=True).orderBy("qid", "rank").collect()
    plain = {}
    for r in blocks.nearest_of_each(df.where("id not in (41, 42, 50)"), asked, 12, key="id", vector="vector").orderBy("qid", "rank").collect():
        plain.setdefault(r["qid"], []).append(r["id"])
    assert all([r["id"] for r in exact if r["qid"] == q] == ids for q, ids in plain.items()) and len(exact) == 12 * len(plain)
