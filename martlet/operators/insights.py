"""Insights derived from a result DataFrame: leading value, z-score anomaly,
first-to-last trend, cluster readiness, the combined insight list, moving
averages and k-means segments.

Column roles are read from ``df.schema`` on the driver (no data moves);
every statistic is a one-row aggregate (``max_by``/``min_by`` carry the row
they belong to), so nothing is collected and no global window is used.
Numbers inside messages are rounded to 2 places and printed as decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import fixed
from martlet.functions.exprs import nan_to_null, round6
from martlet.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: MLlib's maxIter is a 32-bit integer.
_NO_BOUND = 2**31 - 1


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def date_like_columns(df: DataFrame) -> list[str]:
    """Name holds 'date' or 'month', or the type is a date/timestamp."""
    return [f.name for f in df.schema.fields
            if "date" in f.name.lower() or "month" in f.name.lower()
            or isinstance(f.dataType, _DATETIME)]


def round2_text(c: Column) -> Column:
    """Rounded to 2 places (half away from zero) and printed with at least one
    place: ``205.0``, ``1.5``, ``1.23``."""
    two = (F.round(c.cast("double") * F.lit(100.0)) / F.lit(100.0)).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(two, "0$", "")


def raw_text(c: Column, dtype: T.DataType) -> Column:
    """A single value as it is: integers and decimals by their digits, floating
    values by their shortest form; ``nan`` when missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        plain = F.regexp_replace(d.cast("decimal(38,12)").cast("string"), "(\\.[0-9]+?)0+$", "$1")
        usual = F.abs(d).between(1e-3, 1e16) | (d == 0)
        return F.coalesce(F.when(usual, plain).otherwise(d.cast("string")), F.lit("nan"))
    return F.coalesce(c.cast("string"), F.lit("nan"))


def _number(df: DataFrame, name: str) -> Column:
    """A numeric column as a double, NaN as missing."""
    return nan_to_null(F.col(name).cast("double"))


def _label_of(df: DataFrame, metric: str) -> str | None:
    return next((c for c in df.columns if c != metric), None)


def primary_signal(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """ANL-1: one row (kind, label, metric, value, message)."""
    nums = numeric_columns(df)
    if not nums:
        return df.agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit("record_count").alias("kind"), F.lit(None).cast("string").alias("label"),
            F.lit(None).cast("string").alias("metric"), F.col("_n").cast("double").alias("value"),
            F.concat(F.lit("The result returned "), F.col("_n").cast("string"),
                     F.lit(" records without a dominant numeric KPI.")).alias("message"))
    metric = nums[0]
    label = _label_of(df, metric)
    v = _number(df, metric)
    lab = F.col(label).cast("string") if label else F.lit(None).cast("string")
    # highest value first; among equal values the smallest order key
    # (rows whose metric is null never win: min_by skips null ordering keys)
    rank_key = F.when(v.isNotNull(), F.struct((-v).alias("v"),
                                              (F.col(order_col) if order_col else F.lit(0)).alias("o")))
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.min_by(F.struct(lab.alias("l"), v.alias("v")), rank_key).alias("_top"),
                 F.first(v, ignorenulls=False).alias("_only"),
                 F.first(raw_text(F.col(metric), df.schema[metric].dataType)).alias("_raw"))
    value = F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_top.v"))
    one = F.concat(F.lit(f"The primary metric `{metric}` equals `"), F.col("_raw"),
                   F.lit("` for the selected slice."))
    if label:
        many = F.concat(F.lit("The strongest result is `"), F.coalesce(F.col("_top.l"), F.lit("None")),
                        F.lit(f"` with `{metric}` = `"), round2_text(F.col("_top.v")), F.lit("`."))
    else:
        many = F.concat(F.lit(f"The highest observed `{metric}` is `"), round2_text(F.col("_top.v")),
                        F.lit("`."))
    return agg.filter(F.col("_n") > 0).select(
        F.lit("primary").alias("kind"),
        F.when(F.col("_n") == 1, F.lit(None).cast("string")).otherwise(F.col("_top.l")).alias("label"),
        F.lit(metric).alias("metric"), value.alias("value"),
        F.when(F.col("_n") == 1, one).otherwise(many).alias("message"))


def detect_anomaly(df: DataFrame, order_col: str, threshold: float = fixed.ANOMALY_Z) -> DataFrame:
    """ANL-2: the row with the largest |z| of the first numeric column (nulls
    count as 0, population stddev); zero or one row out. Among equal |z|
    the row first in ``order_col`` wins."""
    nums = numeric_columns(df)
    if not nums:
        return _empty_anomaly(df)
    metric = nums[0]
    label = _label_of(df, metric)
    v = F.coalesce(_number(df, metric), F.lit(0.0))
    stats = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mu"),
                               F.stddev_pop(v).alias("sd"))).scalar()
    n, mu, sd = stats["n"], stats["mu"], stats["sd"]
    z = F.try_divide(v - mu, sd)
    lab = F.col(label).cast("string") if label else F.lit(None).cast("string")
    # rank key: larger |z| first, then earlier order key (min over order)
    best = (df.select(lab.alias("l"), v.alias("v"), z.alias("z"), F.col(order_col).alias("o"))
            .agg(F.max(F.abs(F.col("z"))).alias("_maxz"),
                 F.min_by(F.struct("l", "v", "z", "o"),
                          F.struct((-F.abs(F.col("z"))).alias("a"), F.col("o").alias("o"))).alias("_b")))
    named = F.coalesce(F.col("_b.l"), F.lit("None"))
    if not label:  # the row is named by its place in the order: one value to look up
        at = best.first()["_b"]
        place = 1 + df.where(F.col(order_col) < F.lit(at["o"])).count() if at is not None else 1
        named = F.lit(f"row {place}")
    out = best.filter((F.lit(1) * n >= fixed.ANOMALY_MIN_ROWS) & (sd != 0) & (F.col("_maxz") >= threshold))
    return out.select(
        F.lit("anomaly").alias("kind"), F.col("_b.l").alias("label"), F.lit(metric).alias("metric"),
        F.col("_b.v").alias("value"), round6(F.col("_b.z")).alias("z_score"),
        F.concat(F.lit("Potential anomaly detected: `"), named,
                 F.lit(f"` deviates sharply on `{metric}` with a z-score of `"),
                 round2_text(F.col("_b.z")), F.lit("`.")).alias("message"))


def _empty_anomaly(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "kind string, label string, metric string, value double, z_score double, message string")


def detect_trend(df: DataFrame) -> DataFrame:
    """ANL-3: percent change from the first to the latest period of the first
    date-like column; zero or one row out."""
    nums, dates = numeric_columns(df), date_like_columns(df)
    if not nums or not dates:
        return df.sparkSession.createDataFrame(
            [], "kind string, first_period string, last_period string, baseline double, "
                "latest double, delta_pct double, direction string, message string")
    metric, ts = nums[0], dates[0]
    v = _number(df, metric)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.min_by(F.struct(F.col(ts).cast("string").alias("p"), v.alias("v")), F.col(ts)).alias("_f"),
                 F.max_by(F.struct(F.col(ts).cast("string").alias("p"), v.alias("v")), F.col(ts)).alias("_l"))
    delta = F.try_divide((F.col("_l.v") - F.col("_f.v")) * F.lit(100.0), F.col("_f.v"))
    direction = F.when(delta >= 0, F.lit("upward")).otherwise(F.lit("downward"))
    return (agg.filter((F.col("_n") >= fixed.TREND_MIN_ROWS) & (F.col("_f.v") != 0))
            .select(F.lit("trend").alias("kind"), F.col("_f.p").alias("first_period"),
                    F.col("_l.p").alias("last_period"), F.col("_f.v").alias("baseline"),
                    F.col("_l.v").alias("latest"), round6(delta).alias("delta_pct"),
                    direction.alias("direction"),
                    F.concat(F.lit("The time series shows an overall "), direction,
                             F.lit(" movement of `"), round2_text(delta),
                             F.lit("%` from first to latest period.")).alias("message")))


def cluster_ready(df: DataFrame) -> DataFrame:
    """ANL-4: one row when there are >= 2 numeric columns and >= 12 rows."""
    k = len(numeric_columns(df))
    agg = df.agg(F.count(F.lit(1)).alias("rows"))
    return (agg.filter((F.col("rows") >= fixed.CLUSTER_MIN_ROWS) & F.lit(k >= fixed.CLUSTER_MIN_NUMERIC))
            .select(F.lit("cluster").alias("kind"), F.lit(k).alias("numeric_columns"), "rows",
                    F.lit(fixed.CLUSTER_MESSAGE).alias("message")))


def insights(df: DataFrame, intent: str | None, order_col: str) -> DataFrame:
    """ANL-5: the insight list (position, kind, message): an empty-result
    message, or primary, anomaly, trend and (for segmentation) cluster rows
    in that order.

    Every insight is its own aggregate over the result, so the result is
    written once to the shared checkpoint folder first: the query that
    produced it (possibly a scan of the whole warehouse) runs once, not once
    per insight. Results are small (capped upstream, LIM-2)."""
    df = cut_lineage(df)
    parts = [primary_signal(df, order_col).select("kind", "message"),
             detect_anomaly(df, order_col).select("kind", "message"),
             detect_trend(df).select("kind", "message")]
    if intent == "segmentation":
        parts.append(cluster_ready(df).select("kind", "message"))
    pos = {"primary": 1, "anomaly": 2, "trend": 3, "cluster": 4}
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    pos_col = F.element_at(F.create_map(*[x for k, v in pos.items() for x in (F.lit(k), F.lit(v))]),
                           F.col("kind"))
    rows = u.select(pos_col.cast("int").alias("position"), "kind", "message")
    n = df.select(F.count(F.lit(1))).scalar()
    empty = df.sparkSession.range(1).select(F.lit(1).alias("position"), F.lit("empty").alias("kind"),
                                            F.lit(fixed.EMPTY_MESSAGE).alias("message"))
    return rows.filter(n > 0).unionByName(empty.filter(n == 0))


def moving_average(series: DataFrame, period: str, index: str, value: str, k: int = 3) -> DataFrame:
    """ANL-6: average of ``value`` over the last ``k`` calendar periods: of
    those that have one; ``window_periods`` counts the periods present. Each
    period is emitted for the k periods it feeds and summed per target in one
    ``groupBy``: the series is computed once, and there is no join and no global
    window. Sums follow the type: decimals and integers are exact."""
    kind = series.schema[value].dataType
    typed = "decimal(38,6)" if isinstance(kind, T.DecimalType) and kind.scale > 2 else \
        "decimal(38,2)" if isinstance(kind, T.DecimalType) else "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "decimal(38,0)"
    v = F.col("_v")
    emitted = (series.select(F.col(index).alias("_i"), F.col(period).alias("_p"), F.col(value).alias("_v"))
               .withColumn("_off", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))))
    own = F.col("_off") == 0
    there = nan_to_null(v) if typed == "double" else v
    met = emitted.groupBy((F.col("_i") + F.col("_off")).alias("_target")).agg(
        F.max(own).alias("_own"), F.max(F.when(own, F.col("_p"))).alias(period), F.max(F.when(own, v)).alias(value),
        F.sum(there.cast(typed)).alias("_s"), F.count(there).alias("_n"), F.count(F.lit(1)).alias("window_periods"))
    return (met.where("_own")
            .select(period, value, round6(F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double"))).alias("moving_avg"),
                    F.col("window_periods").cast("bigint").alias("window_periods"))
            .orderBy(period))


def cluster_summary(clustered: DataFrame, features: list[str]) -> DataFrame:
    """ANL-8's segments: per cluster its entities and the mean of every feature,
    clusters numbered by their first feature's mean (ties by the next)."""
    means = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("entities"),
                                             *[F.avg(f).alias(f"mean_{f}") for f in features])
    # one row per cluster: the window sees k rows
    nth = F.row_number().over(Window.orderBy(*[f"mean_{f}" for f in features], "entities"))
    return means.select(nth.alias("segment"), "entities", *[round6(f"mean_{f}").alias(f"mean_{f}") for f in features])


def cluster_entities(df: DataFrame, key: str, features: list[str], k: int = 4,
                     seed: int = 7, max_iter: int | None = None) -> DataFrame:
    """ANL-8: k-means segments over standardised numeric features
    (MLlib: each iteration is one distributed pass plus a k-row reduce).
    The feature table (one row per entity) is written once to the shared
    checkpoint folder: the scaler fit, the k-means fit and the assignment
    all read it, so the query behind it runs once. Iterations go on until no
    center moves by more than MLlib's tolerance (1e-4, in standard deviations).
    That ends by itself: an iteration that moves one farther lowers the total
    squared distance, and MLlib raises on NaN and infinite features. How many
    it takes depends on the rows and their partitions, so there is no bound;
    with a caller's own ``max_iter``, a fit that reaches it has not converged
    and raises."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    clean = cut_lineage(df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                         for c in features]))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster",
               maxIter=_NO_BOUND if max_iter is None else max_iter),
    ])
    model = pipe.fit(clean)
    if max_iter is not None and model.stages[-1].summary.numIter >= max_iter:
        raise RuntimeError(f"k-means did not converge in {max_iter} iterations")
    return model.transform(clean).select(key, *features, F.col("cluster").cast("int"))
