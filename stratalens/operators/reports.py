"""Reports: percentiles, rates, quality rules, guardrails, costs, retrieval metrics, stage timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .search import small_side


#: Ranks of a bracket's ends are off by less than this share of the rows.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """Percentiles by linear interpolation, exact, of name: (column, share); one row a group, n its rows.

    No task holds the values of a group: approximate quantiles, whose error is
    bounded, bracket each wanted rank; what lies below a bracket is only
    counted, and of the values inside, some four in ``ACCURACY`` rows, each
    distinct one is one row.  Groups of up to four times ``ACCURACY`` rows are
    ranked whole.  Nulls are left out, as by SQL.
    """
    series: dict[str, Column] = {}
    shares: dict[str, dict[str, float]] = {}
    for name, (column, p) in wanted.items():
        key = column if isinstance(column, str) else name
        series[key] = F.col(column) if isinstance(column, str) else column
        shares.setdefault(key, {})[name] = p
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    ks = sorted({p for ps in shares.values() for p in ps.values()})
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("_s"), c.cast("double").alias("_v")) for k, c in series.items()])).alias("x")).select(*names, "x.*").where("_v is not null")
    ends = [min(1.0, max(0.0, p + move / ACCURACY)) for p in ks for move in (-2, 2)]
    rough = long.groupBy(*names, "_s").agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("q"))
    whole = F.col("_n") <= 4 * ACCURACY  # beyond it, a bracket's margin is several ranks
    low = lambda i, p: F.when(whole | F.lit(p <= 2 / ACCURACY), F.lit(float("-inf"))).otherwise(F.col("q")[2 * i])
    high = lambda i, p: F.when(whole | F.lit(p >= 1 - 2 / ACCURACY), F.lit(float("inf"))).otherwise(F.col("q")[2 * i + 1])
    brackets = rough.select(*names, "_s", "_n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), low(i, p).alias("lo"), high(i, p).alias("hi")) for i, p in enumerate(ks)])).alias("b")).select(*names, "_s", "_n", "b.*")
    brackets = small_side(materialize(brackets))  # a few rows a group: values needn't be dealt by group to meet them
    inside = long.join(brackets, [*names, "_s"]).where("_v <= hi").groupBy(*names, "_s", "_n", "p", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("many"))
    upto = F.sum("many").over(Window.partitionBy(*names, "_s", "p").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("_n") - 1) * F.col("p")
    ranked = inside.withColumn("upto", upto)
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("_v")))
    found = ranked.groupBy(*names, "_s", "_n", "p").agg(value(F.floor(at)).alias("x"), value(F.ceil(at)).alias("y"))
    found = found.withColumn("v", F.col("x") + (F.col("y") - F.col("x")) * (at - F.floor(at)))
    pick = lambda key, p: F.max(F.when((F.col("_s") == key) & (F.col("p") == p), F.col("v")))
    out = found.groupBy(*names).agg(*[F.round(pick(key, p), 6).alias(name) for key, ps in shares.items() for name, p in ps.items()])
    counts = df.groupBy(*by).agg(F.count("*").alias("n")).select("*", *keys)
    return counts.join(out, names, "left").select(*by, "n", *wanted) if names else counts.crossJoin(F.broadcast(out)).select("n", *wanted)  # one row each


def summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return exact_percentiles(df, by, {"p50": (column, 0.5), "p95": (column, 0.95), "p99": (column, 0.99)})


def rate(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)


def delta_percent(baseline: Column, candidate: Column) -> Column:
    """By how much a candidate is lower, in percent; null where the baseline is zero."""
    return F.when(baseline != 0, F.round((1 - candidate / F.when(baseline != 0, baseline)) * 100, 2))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.withColumn("reason", F.explode(found))


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "component", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def guardrails(df: DataFrame, baseline: DataFrame, multiplier: float, by: str = "component") -> DataFrame:
    """Components whose p95 passes the baseline's times a multiplier."""
    return df.join(baseline, by).where(F.col("p95") > F.col("baseline_p95") * multiplier)


def retrieval_metrics(ranks: DataFrame, by: str, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Recall at k and mean reciprocal rank at 10, by group and overall; ``rank`` is null where nothing was found."""
    recalls = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_10")
    out = ranks.rollup(by).agg(F.count("*").alias("n"), *recalls, mrr)
    return out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("overall")))


def stage_timings(df: DataFrame, by: list[str], stage: str, value: str, stages: list[str]) -> DataFrame:
    """Sums by stage as columns, zero where a stage is missing."""
    return df.groupBy(*by).pivot(stage, stages).agg(F.sum(value)).fillna(0.0, subset=stages)


def stage_percentiles(df: DataFrame, stages: str, share: float = 0.95, name: str = "p95") -> DataFrame:
    """A percentile of every stage that occurs in a map of stage to value (A08); stages needn't be known before."""
    each = df.select(F.explode(stages).alias("stage", "value")).where("value is not null")
    return exact_percentiles(each, ["stage"], {name: ("value", share)})


# Components of the bytes that are derived from an upload.
COMPONENTS = ("parquet_b", "thumbnails_b", "frames_b", "transcript_b", "embeddings_b")


def derived_bytes(breakdown: dict[str, Column], fallback: dict[str, Column], totals: list[Column]) -> dict[str, Column]:
    """Bytes by component, with derived_total and other_b.

    The breakdown counts if any of it is there; else what the older fields
    say.  The total is the first of ``totals`` that is known, else the sum of
    the components but the manifest; what the known ones leave of it is
    other_b, unless the breakdown says.
    """
    said = F.coalesce(*breakdown.values()).isNotNull()
    names = dict.fromkeys([*breakdown, *fallback, "manifest_b"])
    none = F.lit(None).cast("double")
    out = {n: F.when(said, breakdown.get(n, none)).otherwise(fallback.get(n, none)) for n in names if n != "other_b"}
    if "manifest_b" in fallback:
        out["manifest_b"] = F.coalesce(out["manifest_b"], fallback["manifest_b"])
    known = [c for n, c in out.items() if n != "manifest_b"]
    added = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    total = F.coalesce(*totals, F.when(F.coalesce(*known, none).isNotNull(), added(known)))
    rest = F.greatest(F.lit(0.0), total - added([out[n] for n in COMPONENTS if n in out]))
    given = F.when(said, breakdown["other_b"]) if "other_b" in breakdown else none
    return out | {"derived_total": total, "other_b": F.coalesce(given, rest)}


def asset_costs(df: DataFrame, *, cpu: list[Column], model_ms: Column, vectors: list[Column], raw: Column, derived: list[Column], seconds_per_vector: float) -> DataFrame:
    """df with what each asset cost (A13): CPU and model seconds, bytes, vectors, and the seconds that indexing them is guessed to take.

    ``model_ms`` is a map of model to milliseconds; what is missing counts as
    nothing.  Rounded half to even, as a floating-point report is.
    """
    zero = F.lit(0.0)
    added = lambda cs: sum((F.coalesce(c.cast("double"), zero) for c in cs), zero)
    n = sum((F.coalesce(c.cast("long"), F.lit(0)) for c in vectors), F.lit(0))
    spent = F.aggregate(F.coalesce(F.map_values(model_ms), F.array().cast("array<double>")), zero, lambda a, x: a + F.coalesce(x, zero))
    return df.select(
        "*", F.bround(added(cpu), 4).alias("cost_cpu_seconds"), F.bround(spent / 1000, 4).alias("cost_model_seconds"), F.coalesce(raw.cast("double"), zero).alias("cost_raw_bytes"),
        F.coalesce(*[c.cast("double") for c in derived], zero).alias("cost_derived_bytes"), F.bround(n * F.lit(seconds_per_vector), 4).alias("cost_index_seconds_est"), n.alias("vector_count"),
    )


def overlap_at(found: Column, expected: Column, k: int) -> Column:
    """The share of the expected ones among the first k found; zero if none is expected."""
    wanted = F.array_distinct(F.filter(expected, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, max(0, k)), wanted)) / F.size(wanted))


def rank_of_expected(found: Column, expected: Column) -> Column:
    """The place, from 1, of the first found that is expected; null if none is."""
    wanted = F.filter(expected, lambda x: x.isNotNull() & (x != ""))
    places = F.transform(found, lambda x, i: F.when(F.array_contains(wanted, x), i + 1))
    return F.array_min(places)
