"""Sources/sinks (SRC-*, SNK-*), cleaning (CLN-*) and profiling (PRF-*).

The upload fixtures are derived from the warehouse tables by Spark itself
(``messy_orders``: orders rendered as the text a spreadsheet export would
hold, with NA spellings, currency and percent text, US dates, a keyword
header, an empty column, repeated rows and blank rows), so every query's
work grows with the tables. The oracles compute the expected clean values
straight from the source columns.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.functions.exprs import round6
from martlet.operators import clean as CL
from martlet.operators import inclusion as INC
from martlet.operators import ingest as IG
from martlet.operators import insights as I
from martlet.operators import profile as PR
from martlet.operators import rollups as R
from martlet.operators import star as S
from martlet.session import TABLES, Warehouse, scratch_path
from martlet.sources import files as SRC
from martlet.sources import profile_store as STORE
from martlet.sources import sinks as SNK
from martlet.suite.insight import ANOMALY_SQL, MONTHLY_SQL, TREND_SQL, txt2
from martlet.suite.registry import register
from martlet.suite.sales import money_sum_sql, r6

MESSY_HEADERS = ["Order ID", "Customer", "Status", "Total Price", "Order Date", "Priority",
                 "Discount", "Note", "Empty", "Select", "Flag"]
CLEAN_NAMES = ["order_id", "customer", "status", "total_price", "order_date", "priority",
               "discount", "note", "empty", "col_select", "flag"]


def messy_orders(wh: Warehouse):
    o = wh.orders
    base = o.select(
        F.col("o_orderkey").cast("string").alias("c0"),
        F.col("o_custkey").cast("string").alias("c1"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
        .otherwise(F.col("o_orderstatus")).alias("c2"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("c3"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("c4"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), F.lit("n/a"))
        .otherwise(F.col("o_orderpriority")).alias("c5"),
        F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(" %")).alias("c6"),
        F.concat(F.lit("ref-"), F.col("o_custkey").cast("string")).alias("c7"),
        F.lit(None).cast("string").alias("c8"),
        F.lower("o_orderstatus").alias("c9"),
        F.when(F.col("o_totalprice") > 100000, F.lit("True")).otherwise(F.lit("False")).alias("c10"),
        "o_orderstatus", "o_orderpriority")
    cols = [f"c{i}" for i in range(11)]
    dups = base.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(*cols)
    blanks = base.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH")).select(
        *[F.lit(None).cast("string").alias(c) for c in cols])
    return base.select(*cols).unionByName(dups).unionByName(blanks).toDF(*MESSY_HEADERS)


MESSY_BASE_SQL = """base AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS c0, CAST(o_custkey AS VARCHAR) AS c1,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN ' ' || o_orderstatus || ' ' ELSE o_orderstatus END AS c2,
         '$' || format('{:,.2f}', o_totalprice) AS c3, strftime(o_orderdate, '%-m/%-d/%Y') AS c4,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'n/a' ELSE o_orderpriority END AS c5,
         CAST(o_orderkey % 40 AS VARCHAR) || ' %' AS c6, 'ref-' || CAST(o_custkey AS VARCHAR) AS c7,
         CAST(NULL AS VARCHAR) AS c8, lower(o_orderstatus) AS c9,
         CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS c10, o_orderstatus, o_orderpriority
  FROM orders)"""
_C = ", ".join(f"c{i}" for i in range(11))
MESSY_SQL = f"""{MESSY_BASE_SQL},
messy AS (SELECT {_C} FROM base
  UNION ALL SELECT {_C} FROM base WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
  UNION ALL SELECT {", ".join(f"CAST(NULL AS VARCHAR) AS c{i}" for i in range(11))} FROM base
            WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')"""


def _named(prefix_sql: str, names: list[str], cols=None) -> str:
    cols = cols or [f"c{i}" for i in range(len(names))]
    return ", ".join(f"{c} AS {n}" for c, n in zip(cols, names))


# ---------------------------------------------------------------- sources / sinks

@register("src_csv_roundtrip", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    (Warehouse(spark, sf).customer.write.option("header", True).option("sep", ";").csv(path))
    df, _, _ = SRC.read_delimited(spark, path)
    return CL.infer_column_types(df)


QUOTED_SQL = """SELECT doc_id, lang, '"' || source || '", ' || substr(text, 1, 200) || chr(10) || '"' || lang || '"; end' AS note
FROM documents WHERE text NOT LIKE '%' || chr(13) || '%'"""


@register("src_csv_quoted", QUOTED_SQL)
def src_csv_quoted(spark, sf):
    """Text with quotes, commas and newlines, written and read back equal."""
    d = Warehouse(spark, sf).documents.where(~F.contains("text", F.lit("\r")))
    note = F.concat(F.lit('"'), "source", F.lit('", '), F.substring("text", 1, 200), F.lit('\n"'), "lang", F.lit('"; end'))
    path = scratch_path(spark, "quoted")
    SNK.export_csv(d.select("doc_id", "lang", note.alias("note")), path)
    df, _, _ = SRC.read_delimited(spark, path)
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register("src_csv_whole_texts", """
SELECT doc_id, lang, '"' || source || '", ' || text || chr(10) || '"' || lang || '"; end' AS note FROM documents""")
def src_csv_whole_texts(spark, sf):
    """The whole text of every document, carriage returns included, between
    quotes and commas, written and read back equal; a null note stays null."""
    note = F.concat(F.lit('"'), "source", F.lit('", '), "text", F.lit('\n"'), "lang", F.lit('"; end'))
    path = scratch_path(spark, "whole")
    SNK.export_csv(Warehouse(spark, sf).documents.select("doc_id", "lang", note.alias("note")), path)
    df, _, _ = SRC.read_delimited(spark, path)
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register("src_split_csv", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def src_split_csv(spark, sf):
    path = scratch_path(spark, "split")
    SNK.export_csv(Warehouse(spark, sf).customer, path)
    return SRC.read_split(spark, path)


@register("src_parquet_scan", """
SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'""")
def src_parquet_scan(spark, sf):
    li = SRC.read_split(spark, os.path.join(sf, "lineitem.parquet"))
    return (li.filter(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
            .select("l_orderkey", "l_quantity"))


@register("src_sql_scan", """
SELECT p_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def src_sql_scan(spark, sf):
    wh = Warehouse(spark, sf)
    wh.register_views()
    SRC.scan(spark, "lineitem")  # resolves the registered view
    return spark.sql("""
        SELECT p_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")


@register("recent_events_topk", """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 10""")
def recent_events_topk(spark, sf):
    ev = Warehouse(spark, sf).events
    return (ev.select("event_id", "ts", "user_id", "event_type", "value")
            .orderBy(F.col("ts").desc(), "event_id").limit(10))


@register("sink_append_roundtrip", "SELECT * FROM nation UNION ALL SELECT * FROM nation")
def sink_append_roundtrip(spark, sf):
    path = scratch_path(spark, "append")
    n = Warehouse(spark, sf).nation
    SNK.write_table(n, path, "overwrite")
    SNK.write_table(n, path, "append")
    return spark.read.parquet(path)


@register("sink_append_once", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'N'""")
def sink_append_once(spark, sf):
    """Batches that are sent twice land once; a batch's retry replaces it."""
    li = Warehouse(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    batch = lambda flag: li.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    path = scratch_path(spark, "batches")
    SNK.append_batch(batch("A"), path, "A")
    SNK.append_batch(batch("R").limit(1), path, "R")
    SNK.append_batch(batch("R"), path, "R")
    SNK.append_new_batches(li, path, "l_returnflag")  # only N is new
    return SNK.read_batches(spark, path)


@register("sink_replace", "SELECT n_regionkey, COUNT(*) AS nations FROM nation GROUP BY n_regionkey")
def sink_replace(spark, sf):
    """A table replaced by rows made from itself."""
    path = scratch_path(spark, "replaced")
    SNK.replace_table(Warehouse(spark, sf).nation, path)
    SNK.replace_table(spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations")), path)
    return spark.read.parquet(path)


@register("sink_csv_roundtrip", f"""
SELECT p_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
       AS DECIMAL(38,2)) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY total_revenue DESC, p_name LIMIT 10""")
def sink_csv_roundtrip(spark, sf):
    wh = Warehouse(spark, sf)
    path = scratch_path(spark, "export")
    SNK.export_csv(S.top_products(wh.lineitem, wh.part, 10), path)
    df, _, _ = SRC.read_delimited(spark, path)
    return df.select("p_name", F.col("total_revenue").cast("decimal(38,2)").alias("total_revenue"))


def _export_summary_sql():
    sql_text = "SELECT month, total_revenue FROM monthly_trend"
    ins = f"""
WITH i AS (SELECT 1 AS position, message FROM (
      SELECT 'The strongest result is `' || month || '` with `total_revenue` = `' || {txt2('total_revenue')} || '`.'
             AS message FROM ({MONTHLY_SQL}) ORDER BY total_revenue DESC, month LIMIT 1)
   UNION ALL SELECT 2, message FROM ({ANOMALY_SQL})
   UNION ALL SELECT 3, message FROM ({TREND_SQL})),
  s AS (SELECT k FROM (VALUES (1), (2), (3)) v(k))
SELECT 'sql' AS section, '{sql_text}' AS content
UNION ALL SELECT 'insight_' || CAST(s.k AS VARCHAR), COALESCE(i.message, '') FROM s LEFT JOIN i ON i.position = s.k"""
    return sql_text, ins


@register("export_summary_rows", _export_summary_sql()[1])
def export_summary_rows(spark, sf):
    monthly = R.monthly_trend(Warehouse(spark, sf).orders, "o_orderdate", "o_totalprice", as_money=True)
    return SNK.export_summary(I.insights(monthly, "trend", "month"), _export_summary_sql()[0])


def _session_batch(wh):
    ev = wh.events
    return ev.select(
        F.col("event_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"),
        F.concat(F.lit("Show the monthly "), "event_type", F.lit(" trend")).alias("question"),
        F.concat(F.lit("SELECT * FROM events WHERE event_type = '"), "event_type", F.lit("'")).alias("approved_sql"),
        F.col("value").cast("int").alias("row_count"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("line"))
        .when(F.col("event_type") == "purchase", F.lit("bar")).otherwise(F.lit("table")).alias("chart_type"),
        F.lit(None).cast("string").alias("csv_path"), F.lit(None).cast("string").alias("xlsx_path"),
        F.lit(None).cast("string").alias("pdf_path"),
        F.when(F.col("value") > 50, F.array(F.lit("The query uses SELECT *; explicit columns are preferred.")))
        .otherwise(F.array().cast("array<string>")).alias("warnings"))


@register("session_log_append", """
SELECT TRUE AS session_id_generated, ts AS created_at, 'Show the monthly ' || event_type || ' trend' AS question,
       'SELECT * FROM events WHERE event_type = ''' || event_type || '''' AS approved_sql,
       CAST(trunc(value) AS INTEGER) AS row_count,
       CASE WHEN event_type IN ('view', 'click') THEN 'line' WHEN event_type = 'purchase' THEN 'bar' ELSE 'table' END
         AS chart_type,
       CAST(NULL AS VARCHAR) AS csv_path, CAST(NULL AS VARCHAR) AS xlsx_path, CAST(NULL AS VARCHAR) AS pdf_path,
       CASE WHEN value > 50 THEN '["The query uses SELECT *; explicit columns are preferred."]' ELSE '[]' END
         AS warnings
FROM events""")
def session_log_append(spark, sf):
    """The appended log read back; the generated session id (a random UUID)
    is reported as a check, every other column as written."""
    path = scratch_path(spark, "sessions")
    batch = _session_batch(Warehouse(spark, sf)).withColumn("session_id", F.lit(None).cast("string"))
    SNK.append_sessions(batch, path)
    log = spark.read.parquet(path)
    return log.select((F.length("session_id") == 36).alias("session_id_generated"),
                      F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                      *[c for c in log.columns if c not in ("session_id", "created_at")])


@register("recent_sessions", """
SELECT CAST(event_id AS VARCHAR) AS session_id, ts AS created_at, 'Show the monthly ' || event_type || ' trend' AS question,
       CAST(trunc(value) AS INTEGER) AS row_count,
       CASE WHEN event_type IN ('view', 'click') THEN 'line' WHEN event_type = 'purchase' THEN 'bar' ELSE 'table' END
         AS chart_type, CAST(NULL AS VARCHAR) AS csv_path, CAST(NULL AS VARCHAR) AS xlsx_path,
       CAST(NULL AS VARCHAR) AS pdf_path
FROM events ORDER BY ts DESC, session_id LIMIT 10""")
def recent_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    SNK.append_sessions(_session_batch(Warehouse(spark, sf)), path)
    return (SNK.recent_sessions(spark.read.parquet(path))
            .withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))


@register("session_stats", """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'line' WHEN event_type = 'purchase' THEN 'bar' ELSE 'table' END
         AS chart_type, COUNT(*) AS sessions, CAST(SUM(CAST(trunc(value) AS INTEGER)) AS BIGINT) AS total_rows,
       CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS with_warnings,
       ROUND(CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) * 1e6) / 1e6 AS warning_rate
FROM events GROUP BY 1""")
def session_stats(spark, sf):
    path = scratch_path(spark, "sessions")
    SNK.append_sessions(_session_batch(Warehouse(spark, sf)), path)
    return SNK.session_stats(spark.read.parquet(path))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("metrics_pivot", "SELECT 'events' AS run, CAST(day(ts) AS BIGINT) AS step, " + ", ".join(
    f"{r6(f'AVG(CASE WHEN event_type = {chr(39)}{t}{chr(39)} THEN value END)')} AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY 2")
def metrics_pivot(spark, sf):
    ev = Warehouse(spark, sf).events
    long = (ev.groupBy(F.dayofmonth("ts").cast("bigint").alias("step"), F.col("event_type").alias("metric"))
            .agg(F.avg("value").alias("value"))
            .select(F.lit("events").alias("run"), "step", "metric", round6("value").alias("value")))
    path = scratch_path(spark, "metrics")
    SNK.log_metrics(long, path)
    return SNK.metrics_wide(spark.read.parquet(path), EVENT_TYPES)


# ---------------------------------------------------------------- cleaning

def _messy_named(spark, sf):
    return CL.sanitize_columns(messy_orders(Warehouse(spark, sf)))[0]


@register("clean_sanitize_columns", f"WITH {MESSY_SQL} SELECT {_named('', CLEAN_NAMES)} FROM messy")
def clean_sanitize_columns(spark, sf):
    return _messy_named(spark, sf)


NORMALIZED_NAMES = ["order_id", "customer", "status", "total_price", "order_date", "priority",
                    "discount", "note", "empty", "select", "flag"]


@register("clean_normalize_columns", f"WITH {MESSY_SQL} SELECT {_named('', NORMALIZED_NAMES)} FROM messy")
def clean_normalize_columns(spark, sf):
    return CL.normalize_column_names(messy_orders(Warehouse(spark, sf)))


@register("clean_drop_empty_rows", f"""WITH {MESSY_SQL}
SELECT {_named('', CLEAN_NAMES)} FROM messy WHERE c0 IS NOT NULL""")
def clean_drop_empty_rows(spark, sf):
    return CL.drop_empty_rows(_messy_named(spark, sf))


@register("clean_drop_duplicates", f"WITH {MESSY_SQL} SELECT DISTINCT {_named('', CLEAN_NAMES)} FROM messy")
def clean_drop_duplicates(spark, sf):
    return CL.drop_exact_duplicates(_messy_named(spark, sf))


@register("clean_drop_wide_duplicates", """
SELECT DISTINCT text, lang, source FROM documents""")
def clean_drop_wide_duplicates(spark, sf):
    """Whole texts: only rows whose fingerprint repeats are shuffled in full."""
    return CL.drop_exact_duplicates(Warehouse(spark, sf).documents.select("text", "lang", "source"), wide=True)


@register("clean_drop_all_null_columns", f"""WITH {MESSY_SQL}
SELECT {_named('', [n for n in CLEAN_NAMES if n != 'empty'], [f'c{i}' for i in range(11) if i != 8])} FROM messy""")
def clean_drop_all_null_columns(spark, sf):
    return CL.drop_all_null_columns(_messy_named(spark, sf))


@register("clean_drop_high_null_columns", """
SELECT c_custkey, c_name, CASE WHEN c_acctbal > 4500 THEN c_name END AS half_filled FROM customer""")
def clean_drop_high_null_columns(spark, sf):
    c = Warehouse(spark, sf).customer
    df = c.select("c_custkey", "c_name",
                  F.when(F.col("c_acctbal") > 4500, F.col("c_name")).alias("half_filled"),
                  F.when(F.col("c_acctbal") > 9500, F.col("c_name")).alias("mostly_empty"))
    return CL.drop_high_null_columns(df, fixed.HIGH_NULL_SHARE)


NA_SAMPLES = ["N/A", " null ", "NIL", "-", "--", "None", "nan", "#N/A", "na", "#na", ""]


@register("clean_na_strings", """
SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN NULL ELSE c_name END AS c_name FROM customer""")
def clean_na_strings(spark, sf):
    c = Warehouse(spark, sf).customer
    spell = F.element_at(F.array(*[F.lit(s) for s in NA_SAMPLES]),
                         (F.col("c_custkey") % len(NA_SAMPLES) + 1).cast("int"))
    raw = c.select("c_custkey", F.when(F.col("c_acctbal") < 1000, spell)
                   .otherwise(F.concat(F.lit("  "), "c_name")).alias("c_name"))
    return raw.select("c_custkey", CL.normalize_na(F.col("c_name")).alias("c_name"))


@register("clean_currency_to_number", "SELECT o_orderkey, o_totalprice AS total_price FROM orders")
def clean_currency_to_number(spark, sf):
    o = Warehouse(spark, sf).orders
    sign = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("€"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("£")).otherwise(F.lit("$")))
    text = F.concat(sign, F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", CL.parse_number(CL.strip_currency(text)).alias("total_price"))


@register("clean_percent_to_number", """
SELECT o_orderkey, CAST(o_orderkey % 40 AS DOUBLE) AS discount FROM orders""")
def clean_percent_to_number(spark, sf):
    o = Warehouse(spark, sf).orders
    text = F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(" %"))
    share = o.select(F.avg(text.rlike(fixed.PERCENT_DETECT).cast("int"))).scalar()
    stripped = F.when(share > fixed.PERCENT_SHARE, CL.strip_percent(text)).otherwise(text)
    return o.select("o_orderkey", CL.parse_number(stripped).alias("discount"))


DATE_SHAPES = [("1-URGENT", "M/d/yyyy"), ("2-HIGH", "yyyy-MM-dd"), ("3-MEDIUM", "d-MMM-yyyy"),
               ("4-NOT SPECIFIED", "MMMM d, yyyy")]


@register("coerce_dates", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS order_date FROM orders""")
def coerce_dates(spark, sf):
    o = Warehouse(spark, sf).orders
    text = F.lit("not recorded")
    for pri, fmt in reversed(DATE_SHAPES):
        text = F.when(F.col("o_orderpriority") == pri, F.date_format("o_orderdate", fmt)).otherwise(text)
    raw = o.select("o_orderkey", text.alias("order_date"))
    coerced, _ = CL.coerce_types(raw)
    return coerced


# One spelling of the same moment per priority, each read as a zone-less timestamp.
MORE_DATES = [("1-URGENT", "yyyyMMdd", "%Y%m%d"), ("2-HIGH", "M.d.yyyy", "%-m.%-d.%Y"),
              ("3-MEDIUM", "MMMM d yyyy", "%B %-d %Y"), ("4-NOT SPECIFIED", "yyyy M d", "%Y %-m %-d"),
              ("5-LOW", "M/d/yyyy", "%-m/%-d/%Y")]


@register("coerce_more_dates", """
SELECT o_orderkey, o_orderdate + INTERVAL 14 HOUR + INTERVAL 5 MINUTE AS order_date FROM orders""")
def coerce_more_dates(spark, sf):
    """Further date spellings with 12-hour times."""
    o = Warehouse(spark, sf).orders
    text = F.lit(None).cast("string")
    for pri, fmt, _ in MORE_DATES:
        text = F.when(F.col("o_orderpriority") == pri, F.date_format("o_orderdate", fmt)).otherwise(text)
    coerced, _ = CL.coerce_types(o.select("o_orderkey", F.concat(text, F.lit(" 2:05 PM")).alias("order_date")))
    return coerced


# Spellings that need the column's shapes: by day of the month, and an offset.
CENSUS_DATES = ["M/d/yy", "d/M/yyyy", "MM-dd-yyyy", "yyyy.MM.dd", "EEEE, MMMM d, yyyy", "d MMM yy", "d-MMM-yy", "yyyyMMdd'T'HHmmss",
                "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"]


@register("coerce_census_dates", f"""
WITH o AS (SELECT o_orderkey, o_orderdate, CAST(o_orderkey % {len(CENSUS_DATES)} AS INTEGER) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 1 AND day(o_orderdate) <= 12
                        THEN CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP)
                        WHEN k = 9 THEN o_orderdate - INTERVAL 2 HOUR ELSE o_orderdate END AS order_date
FROM o""")
def coerce_census_dates(spark, sf):
    """Ten spellings in one column: ambiguous ones are month first where that is
    a date, offsets become the UTC time."""
    o = Warehouse(spark, sf).orders
    text = F.lit(None).cast("string")
    for k, fmt in enumerate(CENSUS_DATES):
        text = F.when(F.col("o_orderkey") % len(CENSUS_DATES) == k, F.date_format("o_orderdate", fmt)).otherwise(text)
    coerced, _ = CL.coerce_types(o.select("o_orderkey", text.alias("order_date")))
    return coerced


@register("infer_wide_integers", """
SELECT o_orderkey, '99999' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS account, o_custkey AS padded,
       CAST(o_totalprice AS DOUBLE) AS price FROM orders""")
def infer_wide_integers(spark, sf):
    """Integers beyond 64 bits stay text; blanks around numbers don't count."""
    o = Warehouse(spark, sf).orders
    return CL.infer_column_types(o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit("99999"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0")).alias("account"),
        F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("padded"),
        F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice")).alias("price")))


@register("coerce_numbers", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.1 AND l_returnflag = 'R' THEN NULL ELSE l_quantity END AS qty
FROM lineitem""")
def coerce_numbers(spark, sf):
    li = Warehouse(spark, sf).lineitem
    text = F.when((F.col("l_discount") == 0.1) & (F.col("l_returnflag") == "R"),
                  F.concat(F.lit("about "), F.col("l_quantity").cast("string"))) \
        .otherwise(F.col("l_quantity").cast("string"))
    raw = li.select(F.col("l_orderkey").cast("string").alias("l_orderkey"),
                    F.col("l_linenumber").cast("string").alias("l_linenumber"), text.alias("qty"))
    typed = CL.infer_column_types(raw)
    coerced, _ = CL.coerce_types(typed)
    return coerced.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"), "qty")


READ_TYPED_SQL = f"""WITH {MESSY_SQL}
SELECT TRY_CAST(c0 AS DOUBLE) AS order_id, TRY_CAST(c1 AS DOUBLE) AS customer, c2 AS status, c3 AS total_price,
       c4 AS order_date, CASE WHEN c5 = 'n/a' THEN NULL ELSE c5 END AS priority, c6 AS discount, c7 AS note,
       c8 AS empty, c9 AS col_select, c10 AS flag FROM messy"""


@register("infer_column_types", READ_TYPED_SQL)
def infer_column_types(spark, sf):
    return CL.infer_column_types(_messy_named(spark, sf))


COERCED_SQL = """
SELECT CAST(o_orderkey AS DOUBLE) AS order_id, CAST(o_custkey AS DOUBLE) AS customer, o_orderstatus AS status,
       o_totalprice AS total_price, o_orderdate AS order_date,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
       CAST(o_orderkey % 40 AS DOUBLE) AS discount, 'ref-' || CAST(o_custkey AS VARCHAR) AS note,
       lower(o_orderstatus) AS col_select, CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS flag
FROM orders"""


@register("coerce_all", COERCED_SQL)
def coerce_all(spark, sf):
    cleaned, _, _ = CL.clean_upload(messy_orders(Warehouse(spark, sf)))
    return cleaned


@register("cleaning_report", f"""WITH {MESSY_SQL}
SELECT COUNT(*) AS rows_read, (SELECT COUNT(*) FROM orders) AS rows_kept,
       COUNT(*) - (SELECT COUNT(*) FROM orders) AS rows_removed FROM messy""")
def cleaning_report(spark, sf):
    raw = messy_orders(Warehouse(spark, sf))
    kept, _, rows_read = CL.clean_rows_counted(raw)
    return CL.cleaning_report(raw, kept, rows_read)


# ---------------------------------------------------------------- profiling

ORDERS_TYPES = [("o_orderkey", "bigint", True, False), ("o_custkey", "bigint", True, False),
                ("o_orderstatus", "string", False, False), ("o_totalprice", "double", True, False),
                ("o_orderdate", "timestamp_ntz", False, True), ("o_orderpriority", "string", False, False)]


def _profile_sql(table: str, cols) -> str:
    parts = []
    for i, (c, t, num, dt) in enumerate(cols):
        parts.append(f"""SELECT {i} AS position, '{c}' AS name, '{t}' AS dtype,
  (SELECT COUNT(DISTINCT {c}) FROM {table}) AS n_unique,
  (SELECT ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) * 100.0 / COUNT(*) * 10.0) / 10.0 FROM {table}) AS null_pct,
  (SELECT list(CAST(v AS VARCHAR) ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {table}
     WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values,
  {str(num).upper()} AS is_numeric, {str(dt).upper()} AS is_date""")
    return "\nUNION ALL ".join(parts)


@register("profile_orders", _profile_sql("orders", ORDERS_TYPES))
def profile_orders(spark, sf):
    return PR.profile_columns(Warehouse(spark, sf).orders)


ID_RE = fixed.ID_NAME_PATTERN


def _roles_sql(table: str, cols) -> str:
    return f"""WITH p AS ({_profile_sql(table, cols)})
SELECT position, name, CASE WHEN is_date THEN 'date' WHEN regexp_matches(lower(name), '{ID_RE}') THEN 'id'
  WHEN is_numeric THEN 'measure' WHEN n_unique <= 50 THEN 'dimension' ELSE 'text' END AS role FROM p"""


@register("column_roles", _roles_sql("orders", ORDERS_TYPES))
def column_roles(spark, sf):
    return PR.classify_roles(PR.profile_columns(Warehouse(spark, sf).orders)).select("position", "name", "role")


@register("blueprint_tables", f"""WITH r AS ({_roles_sql("orders", ORDERS_TYPES)})
SELECT 'orders_fact' AS table_name, 'fact' AS kind, CAST(NULL AS VARCHAR) AS source_column
UNION ALL SELECT 'dim_' || name, 'dimension', name FROM r WHERE role = 'dimension'""")
def blueprint_tables(spark, sf):
    roles = PR.classify_roles(PR.profile_columns(Warehouse(spark, sf).orders))
    return PR.build_blueprint(roles, "orders")[1]


@register("dim_mktsegment", """
SELECT ROW_NUMBER() OVER (ORDER BY c_mktsegment) AS id, c_mktsegment
FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)""")
def dim_mktsegment(spark, sf):
    return PR.extract_dimension(Warehouse(spark, sf).customer, "c_mktsegment")


@register("dim_orderpriority", """
SELECT ROW_NUMBER() OVER (ORDER BY o_orderpriority) AS id, o_orderpriority
FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)""")
def dim_orderpriority(spark, sf):
    return PR.extract_dimension(Warehouse(spark, sf).orders, "o_orderpriority")


@register("star_build_counts", """
SELECT 'orders_upload_fact' AS table_name, 'fact' AS kind, COUNT(*) AS rows FROM orders
UNION ALL SELECT 'dim_status', 'dimension', COUNT(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'dim_priority', 'dimension', COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
                 THEN NULL ELSE o_orderpriority END) FROM orders
UNION ALL SELECT 'dim_col_select', 'dimension', COUNT(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'dim_flag', 'dimension', COUNT(DISTINCT o_totalprice > 100000) FROM orders""")
def star_build_counts(spark, sf):
    res = IG.build_star(messy_orders(Warehouse(spark, sf)), "orders_upload", scratch_path(spark, "star"))
    return IG.star_counts(res, spark)


@register("star_build_fact", COERCED_SQL)
def star_build_fact(spark, sf):
    """The written fact table's contents."""
    res = IG.build_star(messy_orders(Warehouse(spark, sf)), "orders_upload", scratch_path(spark, "star"))
    return spark.read.parquet(res.tables[res.blueprint.fact_table])


@register("dim_bought_names", """
SELECT ROW_NUMBER() OVER (ORDER BY bought) AS id, bought
FROM (SELECT DISTINCT p_name || ' / ' || CAST(o_custkey AS VARCHAR) AS bought
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""")
def dim_bought_names(spark, sf):
    """Numbering of a column with far more values than a dimension has."""
    wh = Warehouse(spark, sf)
    bought = (wh.lineitem.select("l_orderkey", "l_partkey")
              .join(wh.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(wh.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
              .select(F.concat("p_name", F.lit(" / "), F.col("o_custkey").cast("string")).alias("bought")))
    return PR.extract_dimension(bought, "bought")


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("check_not_null", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM lineitem" for c in LINEITEM_COLS))
def check_not_null(spark, sf):
    return PR.check_not_null(Warehouse(spark, sf).lineitem, LINEITEM_COLS)


@register("check_unique_lineitem", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def check_unique_lineitem(spark, sf):
    return PR.check_unique(Warehouse(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@register("check_unique_custkey", """
SELECT o_custkey, COUNT(*) AS occurrences FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1""")
def check_unique_custkey(spark, sf):
    """One dense integer key: by bitmaps."""
    return PR.check_unique(Warehouse(spark, sf).orders, ["o_custkey"])


@register("check_fk_orders", """
SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def check_fk_orders(spark, sf):
    wh = Warehouse(spark, sf)
    return PR.check_foreign_key(wh.lineitem, "l_orderkey", wh.orders, "o_orderkey")


@register("check_fk_violations", """
SELECT * FROM lineitem WHERE l_orderkey NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')""")
def check_fk_violations(spark, sf):
    wh = Warehouse(spark, sf)
    parent = wh.orders.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return PR.check_foreign_key(wh.lineitem, "l_orderkey", parent, "o_orderkey")


@register("check_fk_null_keys", """
WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS ref FROM lineitem)
SELECT * FROM c WHERE ref IS NOT NULL AND ref NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')""")
def check_fk_null_keys(spark, sf):
    """A null key refers to nothing and is no violation."""
    wh = Warehouse(spark, sf)
    child = wh.lineitem.select("l_orderkey", "l_linenumber",
                               F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("ref"))
    parent = wh.orders.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return PR.check_foreign_key(child, "ref", parent, "o_orderkey")


def _warehouse(spark, sf):
    wh = Warehouse(spark, sf)
    return PR.warehouse_profile({t: getattr(wh, t) for t in TABLES})


# Schemas of the driver tables as Spark reads them; the oracle text lists
# the columns so that DuckDB computes the same per-column statistics.
TABLE_SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}


def _warehouse_sql() -> str:
    parts = []
    for t, cols in TABLE_SCHEMAS.items():
        for i, (c, typ) in enumerate(cols):
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{typ}' AS data_type, {i + 1} AS ordinal, "
                f"COUNT(*) AS rows, COUNT(DISTINCT {c}) AS n_unique, COUNT(*) - COUNT({c}) AS null_count, "
                f"COUNT(DISTINCT {c}) = COUNT(*) AND COUNT(*) = COUNT({c}) AND COUNT(*) > 0 AS is_key_candidate "
                f"FROM {t}")
    return "\nUNION ALL ".join(parts)


@register("warehouse_profile", _warehouse_sql())
def warehouse_profile(spark, sf):
    return _warehouse(spark, sf)


@register("key_candidates", f"SELECT table_name, column_name FROM ({_warehouse_sql()}) WHERE is_key_candidate")
def key_candidates(spark, sf):
    wh = Warehouse(spark, sf)
    return PR.key_candidates({t: getattr(wh, t) for t in TABLES})


_CLASS_OF = {"int": "integer", "bigint": "integer", "string": "text", "timestamp_ntz": "time"}


def _foreign_keys_sql() -> str:
    """All distinct values of all columns in one table; a column is contained in
    a key if as many of its values as it has meet one of the key's."""
    parts = [f"SELECT '{_CLASS_OF[typ]}' AS kind, '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, COUNT(*) AS n "
             f"FROM {t} GROUP BY {c}" for t, cols in TABLE_SCHEMAS.items() for c, typ in cols if typ in _CLASS_OF]
    return f"""WITH vals AS MATERIALIZED ({' UNION ALL '.join(parts)}),
cols AS (SELECT kind, t, c, COUNT(v) AS n_values, SUM(n) = COUNT(v) AND COUNT(*) = COUNT(v) AS is_key FROM vals GROUP BY kind, t, c),
met AS (SELECT x.t AS ct, x.c AS cc, y.t AS pt, y.c AS pc, COUNT(*) AS n
        FROM vals x JOIN vals y ON x.kind = y.kind AND x.v = y.v JOIN cols k ON y.t = k.t AND y.c = k.c AND k.is_key
        WHERE x.t <> y.t OR x.c <> y.c GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, n AS child_values, p.n_values AS parent_values
FROM met JOIN cols c ON c.t = ct AND c.c = cc AND c.n_values = met.n JOIN cols p ON p.t = pt AND p.c = pc"""


@register("foreign_key_candidates", _foreign_keys_sql())
def foreign_key_candidates(spark, sf):
    """PRF-9: inclusions of columns in keys, over all tables."""
    wh = Warehouse(spark, sf)
    return INC.foreign_keys({t: getattr(wh, t) for t in TABLES})


def _store_sql() -> str:
    cols = [("o_orderkey", "measure"), ("o_custkey", "measure"), ("o_orderstatus", None), ("o_totalprice", "measure"),
            ("o_orderdate", "date"), ("o_orderpriority", None)]
    parts = [f"SELECT {i} AS position, '{c}' AS name, COUNT(*) AS rows, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS u, "
             f"CASE WHEN '{kind or ''}' <> '' THEN '{kind or ''}' WHEN COUNT(DISTINCT {c}) <= 50 THEN 'dimension' ELSE 'text' END AS role "
             f"FROM orders" for i, (c, kind) in enumerate(cols)]
    return f"""SELECT position, name, rows, non_null, CASE WHEN u <= 4096 OR u = rows THEN u END AS n_unique, role,
       u = rows AND non_null = rows AS is_key FROM ({' UNION ALL '.join(parts)})"""


@register("profile_store_update", _store_sql())
def profile_store_update(spark, sf):
    """The profile of a table that grew: its first files were sketched before,
    only the later ones are scanned."""
    orders = Warehouse(spark, sf).orders
    table, store = scratch_path(spark, "grown"), scratch_path(spark, "store")
    SNK.write_table(orders.where("o_orderkey % 3 <> 0"), table)
    STORE.update(spark, table, store)
    SNK.write_table(orders.where("o_orderkey % 3 = 0"), table, "append")
    STORE.update(spark, table, store)
    n = F.when(F.col("is_exact"), F.col("n_unique"))
    return STORE.profile(spark, table, store).select("position", "name", "rows", "non_null", n.alias("n_unique"), "role", "is_key")


@register("key_wide_decimals", """
SELECT 'o_orderkey' AS name, COUNT(DISTINCT o_orderkey) AS n_unique, TRUE AS is_key FROM orders
UNION ALL SELECT 'near_one', COUNT(DISTINCT o_orderkey), TRUE FROM orders
UNION ALL SELECT 'o_custkey', COUNT(DISTINCT o_custkey), COUNT(DISTINCT o_custkey) = COUNT(*) FROM orders""")
def key_wide_decimals(spark, sf):
    """Decimals that differ only beyond a double's digits are told apart, by the
    profile and by the key search."""
    big = F.lit("90000000000000000000000000000").cast("decimal(38,0)")
    orders = Warehouse(spark, sf).orders.select(
        (big + F.col("o_orderkey")).cast("decimal(38,0)").alias("o_orderkey"),
        (F.lit(1) + F.col("o_orderkey").cast("decimal(38,30)") / F.lit("1" + "0" * 22).cast("decimal(38,0)")).cast("decimal(38,30)").alias("near_one"),
        (big + F.col("o_custkey")).cast("decimal(38,0)").alias("o_custkey"))
    keys = PR.key_candidates({"orders": orders}).select(F.col("column_name").alias("name"), F.lit(True).alias("is_key"))
    profile = PR.profile_columns(orders).select("name", "n_unique")
    return profile.join(F.broadcast(keys), "name", "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def _rollup(kind):
    return lambda spark, sf: PR.auto_rollup(Warehouse(spark, sf).orders, kind, as_money=True)


register("auto_rollup_orders", f"""
SELECT o_orderstatus, COUNT(*) AS orders, {money_sum_sql('o_totalprice')} AS revenue,
       {r6('AVG(CAST(o_totalprice AS DECIMAL(12,2)))')} AS avg_value
FROM orders GROUP BY o_orderstatus""")(_rollup("segments"))
register("auto_rollup_top", f"""
SELECT o_orderstatus, {money_sum_sql('o_totalprice')} AS total_revenue FROM orders GROUP BY o_orderstatus""")(_rollup("top"))
register("auto_rollup_trend", MONTHLY_SQL)(_rollup("trend"))
register("auto_rollup_count", """
SELECT o_orderstatus, COUNT(*) AS return_count FROM orders GROUP BY o_orderstatus""")(_rollup("count"))
register("auto_rollup_generic", f"""
SELECT o_orderstatus, {money_sum_sql('o_totalprice')} AS total, COUNT(*) AS records
FROM orders GROUP BY o_orderstatus""")(_rollup("generic"))


@register("auto_compare_orders", f"""
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, {money_sum_sql('o_totalprice')} AS total,
       COUNT(*) AS records FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, {money_sum_sql('o_totalprice')}, COUNT(*) FROM orders GROUP BY o_orderpriority""")
def auto_compare_orders(spark, sf):
    return PR.auto_compare(Warehouse(spark, sf).orders, as_money=True)
