"""Query templates as DataFrame operators: top-N, monthly trend, counts,
segment breakdowns, rollups, top rows, spread of values, previews and the
common filters.

Each is a single ``groupBy().agg()`` (partial aggregation before the shuffle,
so a hot key is combined map-side) followed, where asked, by a top-k
(``orderBy().limit()`` plans as ``TakeOrderedAndProject``). Every sort adds a
unique tie-breaker so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions.exprs import (
    ColumnOrName, col, mean_of, money, month_of, nan_to_null, round6, total,
)
from martlet.plans.joins import broadcast_if_bounded
from martlet.plans.numbering import with_ordered_ids


def _is_floating(df: DataFrame, metric: ColumnOrName) -> bool:
    return isinstance(df.select(col(metric)).schema[0].dataType, (T.FloatType, T.DoubleType))


def _metric_sum(df: DataFrame, metric: ColumnOrName, as_money: bool) -> Column:
    """Sum by the metric's type: integers and decimals exactly, floating
    values as a double rounded to 6 places (NaN counts as missing). Only a
    caller who knows that a metric is money asks for cents."""
    if as_money:
        return total(F.sum(money(metric)))
    if _is_floating(df, metric):
        return round6(F.sum(nan_to_null(col(metric).cast("double"))))
    return F.sum(col(metric))


def _metric_values(df: DataFrame, metric: ColumnOrName) -> Column:
    """Number of values that an average is over (missing ones don't count)."""
    return F.count(nan_to_null(col(metric)) if _is_floating(df, metric) else col(metric))


def _metric_average(df: DataFrame, metric: ColumnOrName, as_money: bool) -> Column:
    """SQL's AVG: over the values that are there, rounded to 6 places."""
    c = money(metric) if as_money else col(metric).cast("double")
    if not as_money and _is_floating(df, metric):
        c = nan_to_null(c)
    return mean_of(F.sum(c), _metric_values(df, metric))


def top_n(df: DataFrame, dim: str, metric: ColumnOrName, n: int | None = 10,
          as_money: bool = False, name: str = "total_revenue") -> DataFrame:
    """SUM(metric) by dim, largest first, first ``n`` (all if None; ties by
    dim)."""
    out = (df.groupBy(dim).agg(_metric_sum(df, metric, as_money).alias(name))
           .orderBy(F.col(name).desc(), F.col(dim).asc_nulls_last()))
    return out if n is None else out.limit(n)


def monthly_trend(df: DataFrame, ts: str, metric: ColumnOrName, as_money: bool = False,
                  name: str = "total_revenue") -> DataFrame:
    """``yyyy-MM`` month of a non-null timestamp, SUM(metric), ascending."""
    return (df.filter(F.col(ts).isNotNull())
            .groupBy(month_of(ts).alias("month"))
            .agg(_metric_sum(df, metric, as_money).alias(name))
            .orderBy("month"))


def count_by(df: DataFrame, dim: str, name: str = "record_count") -> DataFrame:
    """COUNT(*) by dim, most first."""
    return (df.groupBy(dim).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), F.col(dim).asc_nulls_last()))


def segment_breakdown(df: DataFrame, dim: str, metric: ColumnOrName,
                      as_money: bool = False) -> DataFrame:
    """count, sum and average (over non-null values) of metric by dim, largest
    sum first."""
    return (df.groupBy(dim)
            .agg(F.count(F.lit(1)).alias("orders"), _metric_sum(df, metric, as_money).alias("revenue"),
                 _metric_average(df, metric, as_money).alias("avg_value"))
            .orderBy(F.col("revenue").desc(), F.col(dim).asc_nulls_last()))


def generic_rollup(df: DataFrame, dim: str, metric: ColumnOrName,
                   as_money: bool = False) -> DataFrame:
    """sum and count of metric by dim, largest sum first."""
    return (df.groupBy(dim)
            .agg(_metric_sum(df, metric, as_money).alias("total"),
                 F.count(F.lit(1)).alias("records"))
            .orderBy(F.col("total").desc(), F.col(dim).asc_nulls_last()))


def top_rows(df: DataFrame, metric: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` single records with the highest metric (ties by key)."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(key).asc()).limit(n)


def monthly_count(df: DataFrame, ts: str, name: str = "record_count") -> DataFrame:
    return (df.filter(F.col(ts).isNotNull())
            .groupBy(month_of(ts).alias("month"))
            .agg(F.count(F.lit(1)).alias(name)).orderBy("month"))


def avg_by(df: DataFrame, dim: str, metric: ColumnOrName, name: str = "avg_value",
           as_money: bool = False) -> DataFrame:
    """Average of metric by dim, highest first."""
    return (df.groupBy(dim).agg(_metric_average(df, metric, as_money).alias(name))
            .orderBy(F.col(name).desc_nulls_last(), F.col(dim).asc_nulls_last()))


_PROBS = (0.25, 0.5, 0.75)
QUANTILE_SKETCH_ACCURACY = 1_000
QUANTILE_BRACKET = 4.0 / QUANTILE_SKETCH_ACCURACY


def _ranked_values(v: DataFrame, wanted: list[int]) -> dict[int, float]:
    """Values at 0-based positions ``wanted`` of the sorted ``v`` column:
    distributed range sort + global numbering; only those rows are fetched.
    A row-order tie-breaker spreads a hot value over several partitions."""
    ranked = with_ordered_ids(v.withColumn("_t", F.monotonically_increasing_id()),
                              [F.col("v"), F.col("_t")], "pos", start=0)
    return {r["pos"]: r["v"] for r in ranked.filter(F.col("pos").isin(wanted)).select("pos", "v").collect()}


def exact_quantiles(df: DataFrame, metric: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of ``metric`` (see ``_quantiles_and``)."""
    return _quantiles_and(df, metric, probs, [])[0]


def _quantiles_and(df: DataFrame, metric: str, probs: list[float], more: list[Column]) -> tuple[list[float | None], Row]:
    """Exact linear-interpolation quantiles without sorting the whole column
    and without collecting values into one buffer (``percentile`` keeps
    every value of a group in one task).

    Job 1: the count and, per quantile, a bracket [lo, hi] from a
    ``percentile_approx`` sketch (bounded memory, merged map-side) a few
    sketch errors either side of the quantile. Job 2 proves each bracket:
    ``count(v < lo)`` and ``count(lo <= v <= hi)`` must put the needed ranks
    inside it. Job 3 range-sorts only the bracketed values (about
    2 x bracket x n rows per quantile, tagged by quantile) and fetches the
    <= 2 rows per quantile at the needed positions. If a bracket cannot be
    proven, the whole column is range-sorted instead; both paths are exact.
    ``more`` aggregates of the values ``v`` ride on job 1; they and the count ``n``
    are the second result."""
    import math

    v = df.select(nan_to_null(F.col(metric).cast("double")).alias("v")).filter(F.col("v").isNotNull())
    lows = [max(0.0, p - QUANTILE_BRACKET) for p in probs]
    highs = [min(1.0, p + QUANTILE_BRACKET) for p in probs]
    first = v.agg(F.count(F.lit(1)).alias("n"),
                  F.percentile_approx("v", lows + highs, QUANTILE_SKETCH_ACCURACY).alias("b"), *more).first()
    n = first["n"]
    if n == 0:
        return [None for _ in probs], first
    spots = [((n - 1) * p, math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in probs]
    k = len(probs)
    lo, hi = first["b"][:k], first["b"][k:]
    within = [(F.col("v") >= lo[i]) & (F.col("v") <= hi[i]) for i in range(k)]
    proof = v.agg(*[F.count_if(F.col("v") < lo[i]).alias(f"b{i}") for i in range(k)],
                  *[F.count_if(within[i]).alias(f"w{i}") for i in range(k)]).first()
    below = [proof[f"b{i}"] for i in range(k)]
    inside = [proof[f"w{i}"] for i in range(k)]
    if not all(below[i] <= a and below[i] + inside[i] > b for i, (_, a, b) in enumerate(spots)):
        wanted = sorted({x for _, a, b in spots for x in (a, b)})
        at = _ranked_values(v, wanted)
        return [at[a] + (h - a) * (at[b] - at[a]) for h, a, b in spots], first
    # bracket i occupies positions [start_i, start_i + inside_i) of the
    # (quantile, value)-ordered subset; shift by below_i to the column rank
    start = [sum(inside[:i]) for i in range(k)]
    tagged = (v.select(F.explode(F.filter(F.array(*[F.when(within[i], F.lit(i)) for i in range(k)]),
                                          lambda x: x.isNotNull())).alias("_q"), "v"))
    ranked = with_ordered_ids(tagged.withColumn("_t", F.monotonically_increasing_id()),
                              [F.col("_q"), F.col("v"), F.col("_t")], "pos", start=0)
    want = {start[i] + x - below[i]: (i, x) for i, (_, a, b) in enumerate(spots) for x in (a, b)}
    got = {r["pos"]: r["v"] for r in ranked.filter(F.col("pos").isin(list(want))).select("pos", "v").collect()}
    at = {want[pos]: val for pos, val in got.items()}
    return [at[(i, a)] + (h - a) * (at[(i, b)] - at[(i, a)]) for i, (h, a, b) in enumerate(spots)], first


def distribution(df: DataFrame, metric: str, exact: bool = True) -> DataFrame:
    """One-row spread: count, min, max, mean, population stddev, quartiles.
    Exact quartiles use a distributed sort of a small part of the values (see
    ``_quantiles_and``), whose first pass takes the other statistics along;
    ``exact=False`` uses ``percentile_approx`` (a bounded sketch per partition,
    one pass)."""
    def spread(m: Column) -> list[Column]:
        return [F.min(m).alias("min_value"), F.max(m).alias("max_value"), round6(F.avg(m)).alias("mean_value"),
                round6(F.stddev_pop(m)).alias("stddev_value")]

    names = ("p25", "median", "p75")
    if not exact:
        m = nan_to_null(F.col(metric).cast("double"))
        return df.agg(F.count(m).alias("n"), *spread(m),
                      *[round6(F.percentile_approx(m, p, 10000)).alias(q) for p, q in zip(_PROBS, names)])
    found, row = _quantiles_and(df, metric, list(_PROBS), spread(F.col("v")))
    rest = ("min_value", "max_value", "mean_value", "stddev_value")
    return df.sparkSession.range(1).select(
        F.lit(row["n"]).cast("bigint").alias("n"), *[F.lit(row[c]).cast("double").alias(c) for c in rest],
        *[round6(F.lit(x).cast("double")).alias(q) for x, q in zip(found, names)])


KLL_K = 2_000
#: A quantile is looked for this far to either side of its rank (4 errors of a sketch of KLL_K).
KLL_BRACKET = 0.008


def distribution_by(df: DataFrame, dims: list[str], metric: str, exact: bool = True) -> DataFrame:
    """AGG-9 per group of ``dims``: count, min, max, mean, population stddev and
    quartiles, for any number and size of groups.

    One aggregate keeps a KLL sketch per group (merged on the map side, so a
    group with a third of all rows is one row per task). ``exact=False`` reads
    the quartiles off it. Otherwise the sketch brackets them: a second pass
    counts, per group, the values below and inside each bracket, which proves it
    or not; only bracketed values (of a group whose bracket is not proven, all)
    are range-sorted and numbered, and the two values next to each rank are
    taken by position. No group is sorted in one task."""
    from martlet.session import scratch_path
    spark = df.sparkSession
    rows = df.select(*[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)], nan_to_null(F.col(metric).cast("double")).alias("v"))
    keys = [f"_d{i}" for i in range(len(dims))]
    v = F.col("v")
    sketch = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), round6(F.avg(v)).alias("mean_value"),
        round6(F.stddev_pop(v)).alias("stddev_value"), F.kll_sketch_agg_double(v, KLL_K).alias("k"))

    def at(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("k", F.lit(p)))

    ends = [(at(max(0.0, p - KLL_BRACKET)), at(min(1.0, p + KLL_BRACKET)), at(p)) for p in _PROBS]
    path = scratch_path(spark, "group-sketches")
    sketch.select("*", *[c.alias(f"{n}{i}") for i, e in enumerate(ends) for n, c in zip(("lo", "hi", "q"), e)]).drop("k") \
        .write.parquet(path)
    groups = spark.read.parquet(path)
    names = [F.col(f"_d{i}").alias(d) for i, d in enumerate(dims)]
    stats = ["n", "min_value", "max_value", "mean_value", "stddev_value"]
    if not exact:
        return groups.select(*names, *stats, *[round6(f"q{i}").alias(q) for i, q in enumerate(("p25", "median", "p75"))])

    def same(a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[f"{k}_"])
        return out

    def joined(other: DataFrame, cols: list) -> DataFrame:
        other = broadcast_if_bounded(other.select(*[F.col(k).alias(f"{k}_") for k in keys], *cols))
        return rows.where("v IS NOT NULL").join(other, same(rows, other)).drop(*[f"{k}_" for k in keys])

    k = range(len(_PROBS))
    within = [(v >= F.col(f"lo{i}")) & (v <= F.col(f"hi{i}")) for i in k]
    counted = joined(groups, [f"{x}{i}" for i in k for x in ("lo", "hi")]).groupBy(*keys).agg(
        *[F.count_if(v < F.col(f"lo{i}")).alias(f"b{i}") for i in k], *[F.count_if(within[i]).alias(f"w{i}") for i in k])
    held = [F.col(k).alias(f"{k}_") for k in keys]
    counted = counted.select(*held, *[f"{x}{i}" for i in k for x in ("b", "w")])
    proof = groups.join(broadcast_if_bounded(counted), same(groups, counted), "left")
    spots = [((F.col("n") - 1) * F.lit(p)) for p in _PROBS]
    proven = F.lit(True)
    for i in k:
        proven = proven & (F.col(f"b{i}") <= F.floor(spots[i])) & (F.col(f"b{i}") + F.col(f"w{i}") > F.ceil(spots[i]))
    path = scratch_path(spark, "group-brackets")
    proof.select(*keys, *stats, *[F.when(proven, F.col(f"lo{i}")).otherwise(F.col("min_value")).alias(f"lo{i}") for i in k],
                 *[F.when(proven, F.col(f"hi{i}")).otherwise(F.col("max_value")).alias(f"hi{i}") for i in k],
                 *[F.when(proven, F.col(f"b{i}")).otherwise(0).alias(f"b{i}") for i in k]).write.parquet(path)
    groups = spark.read.parquet(path)
    picked = joined(groups, [f"{x}{i}" for i in k for x in ("lo", "hi")])
    tags = F.filter(F.array(*[F.when(within[i], F.lit(i)) for i in k]), lambda x: x.isNotNull())
    tagged = picked.select(*keys, "v", F.explode(tags).alias("_q"), F.monotonically_increasing_id().alias("_t"))
    ranked = with_ordered_ids(tagged, [*[F.col(x) for x in keys], F.col("_q"), F.col("v"), F.col("_t")], "pos", start=0)
    path = scratch_path(spark, "bracketed")
    ranked.select(*keys, "_q", "v", "pos").write.parquet(path)
    ranked = spark.read.parquet(path)
    begin = ranked.groupBy(*keys, "_q").agg(F.min("pos").alias("begin"))
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), (spots[i] - F.floor(spots[i])).alias("part"),
                                        (F.floor(spots[i]) - F.col(f"b{i}")).alias("a"),
                                        (F.ceil(spots[i]) - F.col(f"b{i}")).alias("z")) for i in k]))
    wanted = groups.where("n > 0").select(*keys, want.alias("s")).select(*held, "s.*")
    wanted = begin.join(wanted, same(begin, wanted) & (begin["_q"] == wanted["_q"])).select(
        "begin", "part", begin["_q"].alias("q"), (F.col("begin") + F.col("a")).alias("a"), (F.col("begin") + F.col("z")).alias("z"),
        *[F.col(x) for x in keys])
    # positions are global: each is wanted by at most two places of one group
    places = wanted.select(*held, "q", "part", F.explode(F.array(F.struct(F.col("a").alias("pos"), (1 - F.col("part")).alias("w")),
                                                                 F.struct(F.col("z").alias("pos"), F.col("part").alias("w")))).alias("p"))
    places = broadcast_if_bounded(places.select(*[f"{x}_" for x in keys], "q", "p.pos", "p.w"))
    both = ranked.select("pos", "v").join(places, "pos").groupBy(*[f"{x}_" for x in keys]).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("q") == i, F.struct("pos", "v", "w")))).alias(f"x{i}") for i in k])

    def between(x: Column) -> Column:
        lo, hi = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        return lo["v"] + (F.when(lo["pos"] == hi["pos"], 0.0).otherwise(hi["w"])) * (hi["v"] - lo["v"])

    out = groups.join(broadcast_if_bounded(both), same(groups, both), "left")
    return out.select(*names, *stats, *[round6(between(F.col(f"x{i}"))).alias(q) for i, q in enumerate(("p25", "median", "p75"))])


def histogram(df: DataFrame, metric: str, buckets: int = 10) -> DataFrame:
    """Equal-width bucket counts between the column's min and max. The
    bounds come from ONE one-row scalar subquery (min and max together),
    not a window over all rows."""
    m = nan_to_null(F.col(metric).cast("double"))
    bounds = df.select(F.struct(F.min(m).alias("lo"), F.max(m).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    # width_bucket puts the max itself into bucket n+1; fold it into n
    b = F.least(F.width_bucket(m, lo, hi + F.lit(0.0), F.lit(buckets)), F.lit(buckets))
    return (df.filter(m.isNotNull())
            .groupBy(b.cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(m).alias("bucket_min"), F.max(m).alias("bucket_max"))
            .orderBy("bucket"))


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """``SELECT * ... LIMIT n``; ordered by key so the rows are defined."""
    return df.orderBy(key).limit(n)


def in_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Half-open date range: prunes row groups by min/max statistics."""
    return df.filter((F.col(ts) >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                     & (F.col(ts) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))


def last_month_of(df: DataFrame, ts: str) -> DataFrame:
    """Rows in the latest calendar month present in ``ts``. The latest
    month is a one-row scalar subquery."""
    latest = df.select(F.max(F.col(ts))).scalar()
    start = F.trunc(latest, "month")
    return df.filter((F.col(ts) >= start.cast("timestamp_ntz"))
                     & (F.col(ts) < F.add_months(start, 1).cast("timestamp_ntz")))
