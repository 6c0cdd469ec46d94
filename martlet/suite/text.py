"""Text jobs (TXT-*) over tables of questions, SQL strings and replies.

Inputs are the whole driver texts (``documents.text``, ``pages.html``) plus
question / SQL / reply strings that Spark builds from table columns with
``concat`` so that every rule branch is exercised at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.operators import rollups as R
from martlet.operators import textjobs as TX
from martlet.session import Warehouse
from martlet.suite.registry import register
from martlet.suite.sales import money_sum_sql

# Test-data templates ({x} is replaced by a column value).
QUESTION_TEMPLATES = [
    "Show the top 10 products by revenue for {x}",
    "What is the monthly sales trend for {x}?",
    "Which region has the highest return rate for {x} orders?",
    "Find unusual spikes in {x} activity",
    "Compare {x} vs purchase counts",
    "Break down customer segment revenue for {x}",
    "Summarize the {x} results in plain English",
    "Show {x} revenue by channel",
    "Did {x} drop per month this quarter?",
    "Tell me about the top item sales among {x} users",
    "What is the difference between {x} and view totals over time?",
    "Give me an overview of {x} returns by region",
    "Which group of customers drives {x}?",
    "Explain the {x} trend",
    "List {x} events with a STOP flag",
    "Describe the {x} dropdown usage",
]
SQL_TEMPLATES = [
    "SELECT event_type, COUNT(*) FROM events WHERE event_type = '{x}' GROUP BY event_type;",
    "  select * from events where event_type = '{x}'  ",
    "DELETE FROM events WHERE event_type = '{x}'",
    "SELECT * FROM events; DROP TABLE events",
    "WITH t AS (SELECT value FROM events WHERE event_type = '{x}') SELECT AVG(value) FROM t",
    "SELECT pg_sleep(10), '{x}'",
    "UPDATE events SET value = 0 WHERE event_type = '{x}'",
    "   ",
    "SELECT count(*) FROM events WHERE event_type = '{x}';;",
    "SELECT value * 2 AS doubled FROM events WHERE event_type = '{x}'",
    "EXPLAIN SELECT * FROM events",
    "SELECT created_at, updated FROM events_copy WHERE note = 'truncated {x}'",
]
REPLY_TEMPLATES = [
    '{"sql": "SELECT p_name FROM part WHERE p_name = \'{x}\'", "chart_hint": "bar"}',
    '```json\n{"sql": "SELECT COUNT(*) FROM part", "chart_hint": "line", "note": "{x}"}\n```',
    '\x1b[4m{"sql": "SELECT 1", "chart_hint": null}\x1b[0m',
    'Sure! Here is the query: {"sql": "SELECT p_brand FROM part", "chart_hint": "bar"} Enjoy {x}.',
    '{"sql": "SELECT p_type,\\n COUNT(*) FROM part GROUP BY p_type", "analysis_goal": "count {x}',
    'I cannot answer that about {x}.',
]


def _pick(templates, idx, value):
    arr = F.array(*[F.lit(t) for t in templates])
    return F.replace(F.element_at(arr, (idx % len(templates) + 1).cast("int")), F.lit("{x}"), value)


def _sql_list(templates) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in templates) + "]"


def _pick_sql(templates, idx: str, value: str) -> str:
    lst = _sql_list(templates).replace("\x1b", "' || chr(27) || '").replace("\n", "' || chr(10) || '")
    return f"replace(list_extract({lst}, CAST({idx} % {len(templates)} + 1 AS INTEGER)), '{{x}}', {value})"


def questions(wh: Warehouse):
    ev = wh.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("qid"),
                          _pick(QUESTION_TEMPLATES, F.col("event_id"), F.col("event_type")).alias("question"))
    docs = wh.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qid"),
                               F.col("text").alias("question"))
    return ev.unionByName(docs)


QUESTIONS_SQL = f"""q AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS qid, {_pick_sql(QUESTION_TEMPLATES, 'event_id', 'event_type')} AS question
  FROM events
  UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), text FROM documents)"""


def _contains_any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


INTENT_SQL = "CASE " + " ".join(
    f"WHEN {_contains_any_sql('lower(question)', words)} THEN '{intent}'" for intent, words in fixed.INTENT_WORDS
) + f" ELSE '{fixed.INTENT_DEFAULT}' END"

ROUTE_SQL = ("CASE WHEN contains(lower(question), 'top') AND "
             + _contains_any_sql("lower(question)", ["product", "item"]) + " THEN 'top_products' "
             + "WHEN " + _contains_any_sql("lower(question)", fixed.TEMPLATE_TREND_WORDS) + " THEN 'trend' "
             + "WHEN contains(lower(question), 'return') AND contains(lower(question), 'region') "
             + "THEN 'returns_by_region' "
             + "WHEN " + _contains_any_sql("lower(question)", fixed.TEMPLATE_SEGMENT_WORDS) + " THEN 'segments' "
             + "ELSE 'generic' END")


@register("question_intent", f"WITH {QUESTIONS_SQL} SELECT qid, {INTENT_SQL} AS intent FROM q")
def question_intent(spark, sf):
    return questions(Warehouse(spark, sf)).select("qid", TX.classify_intent("question").alias("intent"))


@register("question_needs_summary", f"""WITH {QUESTIONS_SQL}
SELECT qid, {_contains_any_sql('lower(question)', fixed.SUMMARY_TRIGGERS)} AS needs_summary FROM q""")
def question_needs_summary(spark, sf):
    return questions(Warehouse(spark, sf)).select("qid", TX.needs_summary("question").alias("needs_summary"))


@register("question_template", f"""WITH {QUESTIONS_SQL}, r AS (SELECT qid, {ROUTE_SQL} AS template FROM q)
SELECT qid, template, CASE WHEN template = 'trend' THEN 'line' ELSE 'bar' END AS chart_hint FROM r""")
def question_template(spark, sf):
    q = questions(Warehouse(spark, sf)).select("qid", TX.route_template("question").alias("template"))
    return q.withColumn("chart_hint", TX.route_chart(F.col("template")))


GLOSSARY_SQL = "(VALUES " + ", ".join(
    f"({i}, '{t}', '{g.replace(chr(39), chr(39) * 2)}')" for i, (t, g) in enumerate(fixed.GLOSSARY)) + \
    ") AS g(pos, term, guidance)"


@register("question_glossary", f"""WITH {QUESTIONS_SQL}
SELECT qid, term, guidance FROM q JOIN {GLOSSARY_SQL} ON contains(lower(question), term)""")
def question_glossary(spark, sf):
    return TX.match_glossary(questions(Warehouse(spark, sf)), "question", "qid")


_ENTRIES = [(k, t) for k, ts in fixed.TABLE_KEYWORDS for t in ts]
ENTRIES_SQL = "(VALUES " + ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(_ENTRIES)) + \
    ") AS e(pos, kw, table_name)"
ALL_TABLES_SQL = "(VALUES " + ", ".join(f"({100 + i}, '{t}')" for i, t in enumerate(TX.WAREHOUSE_TABLE_ORDER)) + \
    ") AS a(pos, table_name)"


@register("question_table_rank", f"""WITH {QUESTIONS_SQL},
hits AS (SELECT qid, table_name, MIN(pos) AS pos FROM q JOIN {ENTRIES_SQL} ON contains(lower(question), kw)
         GROUP BY qid, table_name),
rest AS (SELECT q.qid, a.table_name, a.pos FROM q, {ALL_TABLES_SQL}
         WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = q.qid AND h.table_name = a.table_name)),
u AS (SELECT * FROM hits UNION ALL SELECT * FROM rest)
SELECT qid, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY pos) AS INTEGER) AS rank, table_name FROM u""")
def question_table_rank(spark, sf):
    return TX.rank_tables(questions(Warehouse(spark, sf)), "question", "qid")


def sql_strings(wh: Warehouse):
    ev = wh.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sql_id"),
                          _pick(SQL_TEMPLATES, F.col("event_id"), F.col("event_type")).alias("sql"))
    pages = wh.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("sql_id"),
                            F.col("html").alias("sql"))
    return ev.unionByName(pages)


SQLS_SQL = f"""s AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS sql_id, {_pick_sql(SQL_TEMPLATES, 'event_id', 'event_type')} AS sql
  FROM events UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages),
n AS (SELECT sql_id, sql, regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', '') AS normalized_sql
      FROM s)"""
_W = r"[^\p{L}\p{N}_]"
AUDIT_ERRORS_SQL = ("CASE WHEN length(normalized_sql) = 0 THEN ['" + TX.MSG_EMPTY + "'] ELSE list_filter(["
                    + f"CASE WHEN contains(normalized_sql, ';') THEN '{TX.MSG_MULTI}' END, "
                    + ", ".join(f"CASE WHEN regexp_matches(lower(normalized_sql), '(^|{_W}){kw}({_W}|$)') "
                                f"THEN 'Unsafe SQL keyword detected: {kw}.' END" for kw in fixed.UNSAFE_KEYWORDS)
                    + ", "
                    + ", ".join(f"CASE WHEN contains(lower(normalized_sql), '{fn}') "
                                f"THEN 'Unsafe SQL function detected: {fn}.' END" for fn in fixed.UNSAFE_FUNCTIONS)
                    + ", CASE WHEN NOT (starts_with(lower(normalized_sql), 'select') OR "
                      "starts_with(lower(normalized_sql), 'with')) THEN '" + TX.MSG_SELECT + "' END"
                    + "], lambda x: x IS NOT NULL) END")
AUDIT_WARN_SQL = (f"CASE WHEN length(normalized_sql) > 0 AND contains(lower(normalized_sql), '*') AND NOT "
                  f"contains(lower(normalized_sql), 'count(*)') THEN ['{TX.MSG_STAR}'] ELSE CAST([] AS VARCHAR[]) END")


@register("sql_audit", f"""WITH {SQLS_SQL}
SELECT sql_id, sql, normalized_sql, {AUDIT_ERRORS_SQL} AS errors, {AUDIT_WARN_SQL} AS warnings,
       len({AUDIT_ERRORS_SQL}) = 0 AS is_valid FROM n""")
def sql_audit(spark, sf):
    return TX.audit_sql(sql_strings(Warehouse(spark, sf)), "sql")


def replies(wh: Warehouse):
    return wh.part.select(F.col("p_partkey").alias("reply_id"),
                          _pick(REPLY_TEMPLATES, F.col("p_partkey"), F.col("p_name")).alias("reply"))


CLEAN_REPLY_SQL = ("regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(reply, '\\x1b\\[[0-9;]*[A-Za-z]', "
                   "'', 'g'), '(?i)```(json)?', '', 'g'), '^\\s+|\\s+$', '', 'g'), '`'), '^\\s+|\\s+$', '', 'g')")


@register("payload_extract", f"""WITH r AS (SELECT p_partkey AS reply_id,
    {_pick_sql(REPLY_TEMPLATES, 'p_partkey', 'p_name')} AS reply FROM part),
c AS (SELECT *, {CLEAN_REPLY_SQL} AS c FROM r),
b AS (SELECT *, regexp_extract(c, '(?s)\\{{.*\\}}', 0) AS blk,
             regexp_extract(c, '(?s)"sql"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1) AS fld,
             regexp_matches(c, '(?s)"sql"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"') AS has_fld FROM c),
m AS (SELECT *, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN 'json'
                     WHEN json_valid(blk) AND json_type(blk) = 'OBJECT' THEN 'block'
                     WHEN has_fld THEN 'sql_field' ELSE 'error' END AS method FROM b)
SELECT reply_id, reply, method,
       CASE WHEN method = 'json' THEN json_extract_string(c, '$.sql')
            WHEN method = 'block' THEN json_extract_string(blk, '$.sql')
            WHEN method = 'sql_field' THEN replace(replace(fld, '\\n', chr(10)), '\\"', '"') END AS sql,
       CASE WHEN method = 'json' THEN json_extract_string(c, '$.chart_hint')
            WHEN method = 'block' THEN json_extract_string(blk, '$.chart_hint') END AS chart_hint
FROM m""")
def payload_extract(spark, sf):
    return TX.extract_payload(replies(Warehouse(spark, sf)), "reply")


GOLD_SQL = "'SELECT value FROM events WHERE event_id = ' || CAST(event_id AS VARCHAR)"


@register("exact_match_score", f"""
WITH g AS (SELECT event_id, {GOLD_SQL} AS gold FROM events),
p AS (SELECT event_id, CASE WHEN event_type = 'click' THEN upper(replace({GOLD_SQL}, ' ', '   '))
                            WHEN event_type = 'view' THEN replace({GOLD_SQL}, 'value', 'ts')
                            ELSE {GOLD_SQL} END AS pred FROM events WHERE event_type <> 'signup')
SELECT COUNT(*) AS n_gold,
       CAST(SUM(CASE WHEN regexp_replace(lower(pred), '\\s+', ' ', 'g') = lower(gold) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_match,
       CAST(SUM(CASE WHEN regexp_replace(lower(pred), '\\s+', ' ', 'g') = lower(gold) THEN 1 ELSE 0 END) AS DOUBLE)
         / COUNT(*) AS score
FROM g LEFT JOIN p USING (event_id)""")
def exact_match_score(spark, sf):
    ev = Warehouse(spark, sf).events
    gold_text = F.concat(F.lit("SELECT value FROM events WHERE event_id = "), F.col("event_id").cast("string"))
    gold = ev.select("event_id", gold_text.alias("sql"))
    pred = ev.filter(F.col("event_type") != "signup").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.upper(F.replace(gold_text, F.lit(" "), F.lit("   "))))
        .when(F.col("event_type") == "view", F.replace(gold_text, F.lit("value"), F.lit("ts")))
        .otherwise(gold_text).alias("sql"))
    return TX.exact_match(pred, gold, "event_id", "sql")


RESULT_A_SQL = f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {money_sum_sql('o_totalprice')} AS total_revenue
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""


@register("result_match", f"""
WITH a AS ({RESULT_A_SQL}), b AS ({RESULT_A_SQL})
SELECT CAST((SELECT COUNT(*) FROM a) AS BIGINT) AS rows_a, CAST((SELECT COUNT(*) FROM b) AS BIGINT) AS rows_b,
       CAST((SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS BIGINT) AS only_in_a,
       CAST((SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS BIGINT) AS only_in_b,
       (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0
       AND (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS same""")
def result_match(spark, sf):
    wh = Warehouse(spark, sf)
    a = R.monthly_trend(wh.orders, "o_orderdate", "o_totalprice", as_money=True)
    wh.register_views()
    b = spark.sql("""SELECT date_format(o_orderdate, 'yyyy-MM') AS month,
                            CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total_revenue
                     FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
    out = TX.result_match(a, b)
    return out.select(*[F.col(c).cast("bigint").alias(c) if c.startswith(("rows", "only")) else F.col(c)
                        for c in out.columns])


@register("slug_keys", """
WITH s AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[^a-zA-Z0-9]+', '_', 'g')
                  AS s0 FROM documents),
t AS (SELECT doc_id, substring(trim(s0, '_'), 1, 50) AS s1 FROM s),
u AS (SELECT doc_id, CASE WHEN length(s1) = 0 THEN 'analysis' ELSE s1 END AS slug FROM t)
SELECT doc_id, slug, COUNT(*) OVER (PARTITION BY slug) AS slug_count FROM u""")
def slug_keys(spark, sf):
    return TX.slug_keys(Warehouse(spark, sf).documents, "text", "doc_id")


def candidates(wh: Warehouse):
    ev = wh.events
    cand = ev.select(
        (F.col("event_id") / 4).cast("bigint").alias("request_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        _pick(SQL_TEMPLATES, F.col("event_id"), F.col("event_type")).alias("sql"),
        _pick(QUESTION_TEMPLATES, (F.col("event_id") / 4).cast("bigint"), F.lit("events")).alias("question"))
    return TX.audit_sql(cand, "sql").select("request_id", "attempt", "normalized_sql", "is_valid", "question")


@register("first_valid_candidate", f"""WITH s AS (
  SELECT CAST(event_id // 4 AS BIGINT) AS request_id, CAST(event_id % 4 + 1 AS INTEGER) AS attempt,
         {_pick_sql(SQL_TEMPLATES, 'event_id', 'event_type')} AS sql,
         {_pick_sql(QUESTION_TEMPLATES, 'event_id // 4', "'events'")} AS question FROM events),
n AS (SELECT *, regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', '') AS normalized_sql FROM s),
v AS (SELECT *, len({AUDIT_ERRORS_SQL}) = 0 AS is_valid FROM n),
g AS (SELECT request_id, MIN(CASE WHEN is_valid AND attempt <= 3 THEN attempt END) AS chosen_attempt,
             arg_min(normalized_sql, CASE WHEN is_valid AND attempt <= 3 THEN attempt END) AS chosen_sql,
             COUNT(CASE WHEN attempt <= 3 THEN 1 END) AS tried, MIN(question) AS question FROM v GROUP BY request_id)
SELECT request_id, chosen_attempt,
       CASE WHEN chosen_attempt IS NOT NULL THEN chosen_sql ELSE 'fallback:' || {ROUTE_SQL} END AS approved_sql,
       CASE WHEN chosen_attempt IS NOT NULL THEN 'model' ELSE 'rule_based_fallback' END AS source,
       CAST(CASE WHEN chosen_attempt IS NOT NULL THEN chosen_attempt - 1 ELSE tried END AS BIGINT) AS failed_attempts
FROM g""")
def first_valid_candidate(spark, sf):
    return TX.first_valid_candidate(candidates(Warehouse(spark, sf)), "request_id", "attempt",
                                    "normalized_sql", "is_valid", "question")
