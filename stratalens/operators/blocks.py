"""Nearest neighbours of many queries at once: blocks of queries meet slices of rows, and a task keeps the best of each query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice and queries of a block, about: what one call of a task holds; rows that are measured at once; pairs measured in double precision at once.
SLICE, QUERIES, CHUNK, PAIRS = 32_768, 2_048, 4_096, 1 << 17
#: Matrix products place a distance within this.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows in double precision; null ones, and those of another width, are zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    width = width or int(sizes.max(initial=0))
    out = np.zeros((len(flat), width))
    fits = sizes == width
    if width and fits.any():
        out[fits] = flat.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up coordinate by coordinate, as vectors.dot() does: equal vectors have equal ones."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """vectors.cosine_distance() of rows, to the last bit."""
    out = np.empty(len(a))
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        scale = np.sqrt(_added(x, x)) * np.sqrt(_added(y, y))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i : i + PAIRS] = np.where(scale == 0, np.nan, 1 - _added(x, y) / scale)
    return out


def places(keys: pa.ChunkedArray) -> np.ndarray:
    """The place of each key among all, nulls first."""
    out = np.empty(len(keys), np.int64)
    out[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    return out


def best_of_slice(rows: np.ndarray, asked: np.ndarray, order: np.ndarray, k: int, allowed: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query, ties by ``order``, zero vectors last.

    Matrix products say which rows may be among them, these are measured as
    cosine_distances() does.  ``allowed`` masks the rows from one place to
    another for every query.
    """
    known, sought = unit(rows), unit(asked)
    blank, lost = ~rows.any(axis=1), ~asked.any(axis=1)
    q, r, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = np.full(len(asked), np.inf)
    for i in range(0, len(rows), CHUNK):
        near = 1 - sought @ known[i : i + CHUNK].T
        near[:, blank[i : i + CHUNK]] = np.inf
        near[lost] = np.inf
        n = near.shape[1]
        may = np.ones(near.shape, bool) if allowed is None else allowed(i, i + n)
        near[~may] = np.inf
        upto = np.partition(near, k - 1, axis=1)[:, k - 1] if n >= k else np.full(len(asked), np.inf)
        bound = np.minimum(bound, upto)
        q_new, r_new = np.nonzero(may & (near <= bound[:, None] + SLACK))
        for j in range(0, len(q_new), PAIRS):
            some, at = q_new[j : j + PAIRS], r_new[j : j + PAIRS] + i
            q, r, d = np.r_[q, some], np.r_[r, at], np.r_[d, cosine_distances(rows[at], asked[some])]
            place = np.lexsort((order[r], d, q))
            q, r, d = q[place], r[place], d[place]
            first = np.searchsorted(q, q)  # where a query's rows begin
            keep = np.arange(len(q)) - first < k
            q, r, d = q[keep], r[keep], d[keep]
            full = np.flatnonzero((np.arange(len(q)) - np.searchsorted(q, q) == k - 1) & ~np.isnan(d))
            bound[q[full]] = np.minimum(bound[q[full]], d[full])
    return q, r, d


def slices_and_blocks(rows: DataFrame, key: str, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over every slice of rows beside every block of queries (qid, ...): a pair is one call, dealt by hashes of ids."""
    slices, blocks = (max(1, math.ceil(df.count() / n)) for df, n in ((rows, SLICE), (queries, QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).withColumn("_block", every(blocks))
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_slice", every(slices))
    return own.groupBy("_slice", "_block").cogroup(asked.groupBy("_slice", "_block")).applyInArrow(run, schema)


def best_by(found: DataFrame, k: int, *order: Column | str, name: str) -> DataFrame:
    """The k first rows of each query, numbered."""
    return found.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col(name) <= k)


def nearest_of_each(rows: DataFrame, queries: DataFrame, k: int, *, key: str, vector: str) -> DataFrame:
    """(qid, key, distance, rank) of the k rows nearest to each query (qid, vector), ties by key, over all rows.

    Work grows with rows times queries, by nature; a call holds a slice and a
    block, and hands on k rows a query and slice.
    """
    kinds = queries.schema["qid"].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        points = matrix(asked.column("vector"))
        q, r, d = best_of_slice(matrix(own.column(vector), points.shape[1]), points, places(own.column(key)), k)
        return pa.table([asked.column("qid").take(q), own.column(key).take(r), pa.array(d)], names=["qid", key, "distance"])

    found = slices_and_blocks(rows.select(key, vector), key, queries.select("qid", "vector"), run, f"qid {kinds[0]}, `{key}` {kinds[1]}, distance double")
    return best_by(found, k, "distance", key, name="rank")
