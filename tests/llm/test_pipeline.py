"""The pipeline on the smallest tables."""

import corpus_pipeline
from stratalens.llm.common import materialize, table


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == columns and 0 < docs.count() <= count, name
        count = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == count


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
    assert docs.count() == 0


def test_awkward_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 string, body int, kind string, fp double, hash string, text_hash string, words int, score string, predicted string, n string, node int, root int, copies int, id2 int, hash2 int"
    long = " ".join(f"x{i % 977} y{i}" for i in range(60_000))
    item = table(spark, sf, "benchmark").first()["text"]
    texts = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "two words"), (5, "two words"), (5, "two other words"), (None, "no id here"), (None, None), (6, f"before {item} after"), (7, "you idiot stupid pathetic worthless loser moron scum trash clown disgusting"), (8, "short")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "a", 1, "b", 0.5, "h", "t", 2, "s", "p", "n", 1, 2, 3, 4, 5) for i, t in texts], schema)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        left[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in out.collect())
    ids = {name: [r[1] for r in rows if not r[0]] for name, rows in left.items()}
    assert len(left["substrings"]) == len(texts)
    assert 6 not in ids["decontamination"] and len(left["decontamination"]) == len(texts) - 1
    assert ids["near_duplicates"].count(5) == 2 and sum(not r[3].strip() for r in left["near_duplicates"]) == 1
    assert {4, 5, 8} <= set(ids["toxicity"])
