"""PRF-1 / PRF-9 kept up to date: a store of mergeable column sketches, one row
per data file and column, beside a Parquet table.

``update`` scans only the files that the store doesn't know (by path, size and
modification time) and appends their rows; ``profile`` merges the rows of the
files that are there now. A new file therefore costs a scan of itself, and a
deleted or rewritten one drops out, however large the table is. Per file and
column the store holds counts, the smallest and largest value, a theta sketch
of the distinct values and, for numbers, a KLL sketch of their distribution; all
merge without loss of accuracy.

Distinct counts are exact up to the sketches' nominal entries (which covers the
role decision, at 50 values); a column that may be a key is decided from its own
values, that column alone; other counts are estimates and marked as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.operators import profile as PR
from martlet.operators.sketches import EXACT_UP_TO, LG_ENTRIES, may_be_key, plain_value, value_class

#: Smallest and largest texts are kept as this many first characters.
TEXT_ENDS = 64
_FILE = ["file", "size", "modified"]


def _files(table: DataFrame) -> DataFrame:
    """The table's data files; no column is read."""
    m = "_metadata"
    return table.select(F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_size").alias("size"),
                        F.col(f"{m}.file_modification_time").alias("modified")).distinct()


def _ends(f: T.StructField):
    key = PR._typed_key(f)
    return key.withField("s", F.substring(key["s"], 1, TEXT_ENDS)) if value_class(f.dataType) in ("text", "nested") else key


def sketch_files(table: DataFrame) -> DataFrame:
    """One row per file and column of ``table`` (a Parquet scan): partial
    aggregation sends one row per task and file."""
    fields = table.schema.fields
    m = "_metadata"
    vals = table.select(F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_size").alias("size"),
                        F.col(f"{m}.file_modification_time").alias("modified"),
                        *[plain_value(f).alias(f"v{i}") for i, f in enumerate(fields)],
                        *[_ends(f).alias(f"e{i}") for i, f in enumerate(fields)])
    aggs, items = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        there = F.col(f"v{i}").isNotNull()
        number = value_class(f.dataType) in ("integer", "floating")
        aggs += [F.count(f"v{i}").alias(f"n{i}"), F.theta_sketch_agg(f"v{i}", LG_ENTRIES).alias(f"t{i}"),
                 F.min(F.when(there, F.col(f"e{i}"))).alias(f"lo{i}"), F.max(F.when(there, F.col(f"e{i}"))).alias(f"hi{i}")]
        if number:
            aggs.append(F.kll_sketch_agg_double(F.col(f"v{i}").cast("double")).alias(f"k{i}"))
        items.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(value_class(f.dataType)).alias("class"), F.col(f"n{i}").alias("non_null"), F.col(f"lo{i}").alias("low"),
            F.col(f"hi{i}").alias("high"), F.col(f"t{i}").alias("theta"),
            (F.col(f"k{i}") if number else F.lit(None).cast("binary")).alias("kll")))
    per = vals.groupBy(*_FILE).agg(*aggs)
    return per.select(*_FILE, "rows", F.explode(F.array(*items)).alias("c")).select(*_FILE, "rows", "c.*")


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(store) if there else None


def update(spark: SparkSession, table: str, store: str) -> int:
    """Add the rows of files that ``store`` doesn't have; the number of files
    scanned. Running it again adds nothing."""
    known = _stored(spark, store)
    now = _files(spark.read.parquet(table))
    new = now if known is None else now.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
    paths = [r["file"] for r in new.collect()]  # names of new files, no data
    if paths:
        sketch_files(spark.read.schema(spark.read.parquet(table).schema).parquet(*paths)).write.mode("append").parquet(store)
    return len(paths)


SCHEMA = ("position int, name string, dtype string, rows bigint, non_null bigint, null_pct double, n_unique bigint, "
          "is_exact boolean, low string, high string, about_median double, role string, is_key boolean")


def profile(spark: SparkSession, table: str, store: str) -> DataFrame:
    """One row per column from the store's rows of the files that are there now."""
    frame = spark.read.parquet(table)
    rows = spark.read.parquet(store).join(_files(frame), _FILE, "left_semi")
    merged = rows.groupBy("position", "name", "dtype", "class").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.theta_sketch_estimate(F.theta_union_agg("theta", LG_ENTRIES)).alias("estimate"),
        F.kll_merge_agg_double("kll").alias("kll"))
    merged = merged.withColumn("median", F.when(F.col("class").isin("integer", "floating") & (F.col("non_null") > 0),
                                                F.kll_sketch_get_quantile_double("kll", F.lit(0.5))))
    texts = [PR._key_text(F.col(c)).alias(f"{c}_text") for c in ("low", "high")]
    found = merged.select("*", may_be_key(F.col("estimate")).alias("near"), *texts).drop("kll").orderBy("position").collect()
    fields = frame.schema.fields
    open_ = [(0, r["position"]) for r in found if r["near"] and r["rows"] > EXACT_UP_TO]
    repeated = PR._with_repeated_values([frame], open_) if open_ else set()
    data = []
    for r in found:
        is_key = bool(r["near"]) and (0, r["position"]) not in repeated
        exact = is_key or r["estimate"] <= EXACT_UP_TO
        data.append((r["position"], r["name"], r["dtype"], r["rows"], r["non_null"], PR._null_pct(r["rows"], r["non_null"]),
                     r["rows"] if is_key else r["estimate"], exact, r["low_text"], r["high_text"], r["median"], None, is_key))
    out = spark.createDataFrame(data, SCHEMA).drop("role")
    kinds = [(i, isinstance(f.dataType, PR._INTEGRAL + PR._FRACTIONAL + (T.BooleanType,)), isinstance(f.dataType, PR._DATETIME))
             for i, f in enumerate(fields)]
    kinds = spark.createDataFrame(kinds, "position int, is_numeric boolean, is_date boolean")
    return PR.classify_roles(out.join(F.broadcast(kinds), "position")).drop("is_numeric", "is_date")
