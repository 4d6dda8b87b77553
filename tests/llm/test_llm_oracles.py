"""The corpus queries that have SQL give the same rows as DuckDB."""

import duckdb
import pytest

from stratalens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    columns = want.columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_awkward_rows_in_sql(spark, tmp_path):
    """Nulls, empty and repeated texts, other scripts and license lines."""
    lines = ["Licensed under the MIT License. CC BY cc by", "General public license, all rights reserved", "x " * 40 + "é ß 日本 " * 30, "x " * 40 + "é ß 日本 " * 30, None, "", " \n\t", "This work is licensed under the GNU General Public License version 3 and released under the MIT license"]
    words = " ".join(f"w{i % 37}" for i in range(400))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(lines + [words, "head " + words, words + " tail", "É" * 900, "É" * 500])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten"), (1, "w3 w4 w5 w6"), (2, None), (3, "é ß 日本 é ß 日本 é ß 日本")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(0, 1, "user", "hello there"), (0, 0, "user", "first"), (0, None, None, "zeroth"), (1, 0, "user", "own"), (21, 5, None, None), (22, 0, "user", "a b"), (22, 0, "user", "a b"), (-3, 0, "user", "x"), (None, 0, "user", "lost"), *[(40 + i, j, "user", f"turn {j}") for i in range(20) for j in range(5)]]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql)
        got = queries.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.fetchall()), key=str), name
