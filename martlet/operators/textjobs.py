"""Rule jobs over tables of questions, SQL strings and model replies.

Every rule is a row-local built-in expression (``contains``, ``rlike``,
``regexp_replace``, ``try_parse_json`` and higher-order array functions), so
a whole table of texts is processed in one pass inside whole-stage codegen.
Keyword tables (glossary, table ranks) are literal arrays evaluated per row
with ``filter``; no join (and no nested-loop join) is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import fixed
from martlet.functions.exprs import ColumnOrName, col, contains_any

# Word boundary with Unicode letters/digits, the same in Java and RE2.
_WORD_EDGE_L = r"(^|[^\p{L}\p{N}_])"
_WORD_EDGE_R = r"([^\p{L}\p{N}_]|$)"

# All unsafe keywords found as whole words in ONE scan of the text (Java
# look-arounds do not consume the neighbouring character, so adjacent
# keywords such as "drop delete" are both found).
UNSAFE_WORDS_RE = (r"(?<![\p{L}\p{N}_])(" + "|".join(fixed.UNSAFE_KEYWORDS) + r")(?![\p{L}\p{N}_])")

# Warehouse tables in catalogue (DDL) order: the tail of a table ranking.
WAREHOUSE_TABLE_ORDER = ["dim_date", "dim_region", "dim_channel", "dim_customer", "dim_product",
                         "fact_orders", "fact_order_items", "fact_returns"]


def _lower(c: ColumnOrName) -> Column:
    return F.lower(col(c))


def classify_intent(text: ColumnOrName) -> Column:
    """TXT-1: first class whose words occur (lower-cased substrings)."""
    q = _lower(text)
    out = None
    for intent, words in fixed.INTENT_WORDS:
        cond = contains_any(q, words)
        out = F.when(cond, F.lit(intent)) if out is None else out.when(cond, F.lit(intent))
    return out.otherwise(F.lit(fixed.INTENT_DEFAULT))


def needs_summary(text: ColumnOrName) -> Column:
    """TXT-2: any summary trigger phrase occurs."""
    return contains_any(_lower(text), fixed.SUMMARY_TRIGGERS)


ROUTE_CHART = {"top_products": "bar", "trend": "line", "returns_by_region": "bar",
               "segments": "bar", "generic": "bar"}


def route_template(text: ColumnOrName) -> Column:
    """TXT-3: rule template for a question, first route wins."""
    q = _lower(text)
    top = F.contains(q, F.lit("top")) & contains_any(q, ["product", "item"])
    ret = F.contains(q, F.lit("return")) & F.contains(q, F.lit("region"))
    return (F.when(top, F.lit("top_products"))
            .when(contains_any(q, fixed.TEMPLATE_TREND_WORDS), F.lit("trend"))
            .when(ret, F.lit("returns_by_region"))
            .when(contains_any(q, fixed.TEMPLATE_SEGMENT_WORDS), F.lit("segments"))
            .otherwise(F.lit("generic")))


def route_chart(route: Column) -> Column:
    m = F.create_map(*[x for k, v in ROUTE_CHART.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, route)


def match_glossary(df: DataFrame, text: str, key: str) -> DataFrame:
    """TXT-4: one row per (question, glossary term it mentions)."""
    terms = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term"), F.lit(g).alias("guidance"))
                      for i, (t, g) in enumerate(fixed.GLOSSARY)])
    # lower-case once per row: an expression inside the lambda would be
    # re-evaluated for every glossary term
    low = df.select(key, _lower(text).alias("_q"))
    hits = F.filter(terms, lambda t: F.contains(F.col("_q"), t["term"]))
    return (low.select(key, F.explode(hits).alias("h"))
            .select(key, F.col("h.term").alias("term"), F.col("h.guidance").alias("guidance")))


def rank_tables(df: DataFrame, text: str, key: str) -> DataFrame:
    """TXT-5: preferred tables for a question: keywords in map order, a
    table's first mention wins, then every other table in catalogue order.
    One row per (question, rank, table)."""
    # each keyword is searched once (not once per table it maps to); the
    # hits, in keyword order, are then mapped to their tables
    words = F.array(*[F.lit(k) for k, _ in fixed.TABLE_KEYWORDS])
    tables_of = F.create_map(*[x for k, tables in fixed.TABLE_KEYWORDS
                               for x in (F.lit(k), F.array(*[F.lit(t) for t in tables]))])
    low = df.select(key, _lower(text).alias("_q"))
    hits = F.filter(words, lambda k: F.contains(F.col("_q"), k))
    preferred = F.array_distinct(F.flatten(F.transform(hits, lambda k: F.element_at(tables_of, k))))
    ordered = F.concat(preferred, F.array_except(F.array(*[F.lit(t) for t in WAREHOUSE_TABLE_ORDER]),
                                                 preferred))
    return (low.select(key, F.posexplode(ordered).alias("pos", "table_name"))
            .select(key, (F.col("pos") + 1).alias("rank"), "table_name"))


# ---------------------------------------------------------------- SQL audit

MSG_EMPTY = "The SQL generator returned an empty query."
MSG_MULTI = "Only a single SQL statement is allowed."
MSG_SELECT = "Only SELECT queries are permitted."
MSG_STAR = "The query uses SELECT *; explicit columns are preferred for warehouse analytics."


WHITESPACE = " \t\n\r\f\u000b"


def _strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace (no regex scan of the text body)."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_sql(sql: ColumnOrName) -> Column:
    """Trim whitespace, then drop trailing semicolons."""
    return F.regexp_replace(_strip_ws(col(sql)), r";+$", "")


def audit_sql(df: DataFrame, sql: str) -> DataFrame:
    """TXT-6: (normalized_sql, errors, warnings, is_valid) per SQL string.
    The normalised and lower-cased texts are computed once (own projection)
    and shared by all checks."""
    base = df.withColumn("normalized_sql", normalize_sql(sql)).withColumn("_low", F.lower("normalized_sql"))
    base = base.withColumn("_kw", F.array_distinct(F.regexp_extract_all("_low", F.lit(UNSAFE_WORDS_RE), 1)))
    n, low = F.col("normalized_sql"), F.col("_low")
    checks = [F.when(F.contains(n, F.lit(";")), F.lit(MSG_MULTI))]
    checks += [F.when(F.array_contains("_kw", kw), F.lit(f"Unsafe SQL keyword detected: {kw}."))
               for kw in fixed.UNSAFE_KEYWORDS]
    checks += [F.when(F.contains(low, F.lit(fn)), F.lit(f"Unsafe SQL function detected: {fn}."))
               for fn in fixed.UNSAFE_FUNCTIONS]
    checks += [F.when(~(low.startswith("select") | low.startswith("with")), F.lit(MSG_SELECT))]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    errors = F.when(F.length(n) == 0, F.array(F.lit(MSG_EMPTY))).otherwise(found)
    warn = F.when((F.length(n) > 0) & F.contains(low, F.lit("*")) & ~F.contains(low, F.lit("count(*)")),
                  F.array(F.lit(MSG_STAR))).otherwise(F.array().cast("array<string>"))
    return base.withColumn("errors", errors).withColumn("warnings", warn) \
        .withColumn("is_valid", F.size("errors") == 0).drop("_low", "_kw")


# ---------------------------------------------------------------- replies

ANSI_RE = r"\x1b\[[0-9;]*[A-Za-z]"
FENCE_RE = r"(?i)```(json)?"
SQL_FIELD_RE = r'(?s)"sql"\s*:\s*"((?:[^"\\]|\\.)*)"'


def clean_reply(raw: ColumnOrName) -> Column:
    """Drop ANSI codes and code fences, trim whitespace and backticks."""
    no_ansi = F.regexp_replace(col(raw), ANSI_RE, "")
    no_fence = F.regexp_replace(no_ansi, FENCE_RE, "")
    return _strip_ws(F.btrim(_strip_ws(no_fence), F.lit("`")))


def extract_payload(df: DataFrame, reply: str) -> DataFrame:
    """TXT-7: (method, sql, chart_hint) from a model reply: the whole text as
    JSON; else the widest ``{...}`` block as JSON; else the ``"sql"`` field
    by pattern (unescaping ``\\n`` and ``\\"``); else an error row."""
    c = clean_reply(reply)
    whole = F.try_parse_json(c)
    block = F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    is_obj = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    field = F.regexp_extract(c, SQL_FIELD_RE, 1)
    has_field = c.rlike(SQL_FIELD_RE)
    method = (F.when(whole.isNotNull() & is_obj(whole), F.lit("json"))
              .when(block.isNotNull() & is_obj(block), F.lit("block"))
              .when(has_field, F.lit("sql_field"))
              .otherwise(F.lit("error")))
    v = F.when(method == "json", whole).when(method == "block", block)
    sql = F.when(method == "sql_field",
                 F.replace(F.replace(field, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))) \
        .otherwise(F.variant_get(v, "$.sql", "string"))
    hint = F.variant_get(v, "$.chart_hint", "string")
    return df.withColumn("method", method).withColumn("sql", sql).withColumn("chart_hint", hint)


# ---------------------------------------------------------------- scoring

def normalize_ws_lower(c: ColumnOrName) -> Column:
    return _strip_ws(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def exact_match(pred: DataFrame, gold: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-8: share of gold items whose prediction (same key) is equal after
    lower-casing and collapsing whitespace; 0 when there is no gold."""
    p = pred.select(F.col(key).alias("_k"), normalize_ws_lower(text).alias("_p"))
    g = gold.select(F.col(key).alias("_k"), normalize_ws_lower(text).alias("_g"))
    j = g.join(p, "_k", "left")
    return j.agg(F.count(F.lit(1)).alias("n_gold"),
                 F.sum(F.when(F.col("_p") == F.col("_g"), 1).otherwise(0)).cast("bigint").alias("n_match")) \
        .select("n_gold", "n_match",
                F.coalesce(F.try_divide(F.col("n_match").cast("double"), F.col("n_gold").cast("double")),
                           F.lit(0.0)).alias("score"))


def _multiset(df: DataFrame) -> DataFrame:
    """One row that is the same for the same multiset of rows in any order: the
    count, and sums of two hashes of every row. Sums combine on the map side, so
    a result is read once and nothing is grouped."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    # a null leaves a hash as it was: its place goes in beside
    parts = [x for c in cols for x in (c.isNull(), c)]
    h = [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (1, 2)]
    zero = F.lit(0).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), zero).alias(f"h{i}") for i, x in enumerate(h)])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """TXT-9, the verdict alone: whether two results hold the same multiset of
    rows (columns by position, nulls equal), by their fingerprints (2 x 64 bits a
    row); columns are compared as the first result's types."""
    b = b.select(*[F.col(f"`{y}`").cast(f.dataType).alias(f.name) for y, f in zip(b.columns, a.schema.fields)])
    x, y = _multiset(a).first(), _multiset(b).first()
    return tuple(x) == tuple(y)


def result_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """TXT-9: do two results hold the same multiset of rows (columns
    matched by position, nulls equal, as in ``EXCEPT ALL``)?

    Fingerprints of both sides (``same_rows``) decide equality in one scan each;
    only results that differ are grouped to report by how many rows. There, rows
    of both sides are tagged and grouped on all columns; each distinct row's
    copies are counted per side (combined map-side, so a row repeated millions
    of times is one row per partition in the shuffle) and the surpluses summed."""
    if len(a.columns) == len(b.columns) and [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields] \
            and not any(isinstance(f.dataType, T.MapType) for f in a.schema.fields) and same_rows(a, b):
        n = a.select(F.count(F.lit(1))).scalar()
        zero = F.lit(0).cast("bigint")
        return a.sparkSession.range(1).select(n.alias("rows_a"), n.alias("rows_b"), zero.alias("only_in_a"),
                                              zero.alias("only_in_b"), F.lit(True).alias("same"))
    cols = a.columns
    keys = [F.col(f"`{c}`") for c in cols]
    both = (a.select(*keys, F.lit(1).alias("_in_a"), F.lit(0).alias("_in_b"))
            .unionAll(b.toDF(*cols).select(*keys, F.lit(0).alias("_in_a"), F.lit(1).alias("_in_b"))))
    per_row = both.groupBy(*keys).agg(F.sum("_in_a").alias("_ca"), F.sum("_in_b").alias("_cb"))
    zero = F.lit(0).cast("bigint")
    out = per_row.agg(
        F.coalesce(F.sum("_ca"), zero).alias("rows_a"), F.coalesce(F.sum("_cb"), zero).alias("rows_b"),
        F.coalesce(F.sum(F.greatest(F.col("_ca") - F.col("_cb"), zero)), zero).alias("only_in_a"),
        F.coalesce(F.sum(F.greatest(F.col("_cb") - F.col("_ca"), zero)), zero).alias("only_in_b"))
    return out.withColumn("same", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))


def slug_base(text: ColumnOrName) -> Column:
    """Lower, non-alphanumeric runs -> ``_``, ``_`` trimmed, first 50."""
    s = F.regexp_replace(F.lower(_strip_ws(col(text))), "[^a-zA-Z0-9]+", "_")
    return F.substring(F.btrim(s, F.lit("_")), 1, fixed.SLUG_MAX)


def slug_default(base: ColumnOrName) -> Column:
    b = col(base)
    return F.when(F.length(b) == 0, F.lit(fixed.SLUG_DEFAULT)).otherwise(b)


def slug(text: ColumnOrName) -> Column:
    """TXT-10: lower, non-alphanumeric runs -> ``_``, trimmed, first 50,
    ``analysis`` when nothing is left."""
    return slug_default(slug_base(text))


def slug_keys(df: DataFrame, text: str, key: str) -> DataFrame:
    """Slug per row plus how many rows share it. The text is scanned once:
    the narrow (key, slug) result is written to the shared checkpoint folder
    (it is read twice below). The counts are a grouped aggregate joined back
    on the slug (a hot slug is combined map-side; the join is split by AQE
    skew handling), not a window holding a group in one task."""
    from martlet.session import cut_lineage
    base = df.select(key, slug_base(text).alias("_b"))
    s = cut_lineage(base.select(key, slug_default("_b").alias("slug")))
    counts = s.groupBy("slug").agg(F.count(F.lit(1)).alias("slug_count"))
    return s.join(counts, "slug").select(key, "slug", "slug_count")


# ---------------------------------------------------------------- retries

def first_valid_candidate(cands: DataFrame, request: str, attempt: str, sql: str, valid: str,
                          question: str, max_attempts: int = fixed.GENERATION_RETRIES + 1) -> DataFrame:
    """TXT-12: per request, the first valid attempt within the allowed
    number of attempts; when none, the rule template the question routes to.
    One grouped aggregate (``min_by`` ignores rows whose key is null)."""
    in_budget = F.col(attempt) <= max_attempts
    key = F.when(in_budget & F.col(valid), F.col(attempt))
    agg = cands.groupBy(request).agg(
        F.min_by(F.col(sql), key).alias("_sql"), F.min(key).alias("chosen_attempt"),
        F.count(F.when(in_budget, 1)).alias("_tried"), F.min(F.col(question)).alias("_q"))
    chosen = F.col("chosen_attempt").isNotNull()
    return agg.select(
        request, "chosen_attempt",
        F.when(chosen, F.col("_sql")).otherwise(F.concat(F.lit("fallback:"), route_template("_q")))
        .alias("approved_sql"),
        F.when(chosen, F.lit("model")).otherwise(F.lit("rule_based_fallback")).alias("source"),
        F.when(chosen, F.col("chosen_attempt") - 1).otherwise(F.col("_tried")).cast("bigint")
        .alias("failed_attempts"))
