"""Bound queries: metric facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as text_fn
from shelfmark.operators import facts as fact_ops
from shelfmark.operators import ingest
from shelfmark.plans.bindings import with_sql
from shelfmark.plans.registry import query

FACTS = """facts AS (
  SELECT s_name AS company, CASE l_returnflag WHEN 'A' THEN '收入' WHEN 'R' THEN '净利润' ELSE '毛利率' END AS metric,
         l_extendedprice AS value, CASE l_returnflag WHEN 'N' THEN '%' ELSE '百万美元' END AS unit,
         CAST(year(l_shipdate) AS VARCHAR) AS year, CASE WHEN l_discount > 0.05::DOUBLE THEN 1 ELSE 0 END AS is_estimate,
         l_linenumber % 3 + 1 AS confidence, 'r' || CAST(l_orderkey % 50 AS VARCHAR) || '.pdf' AS source_file,
         l_linenumber AS source_page, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS seq0, l_extendedprice AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def facts(t):
    f = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return f.select(
        F.col("s_name").alias("company"),
        F.when(F.col("l_returnflag") == "A", "收入").when(F.col("l_returnflag") == "R", "净利润").otherwise("毛利率").alias("metric"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") == "N", "%").otherwise("百万美元").alias("unit"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("is_estimate"),
        (F.col("l_linenumber") % 3 + 1).alias("confidence"),
        F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".pdf")).alias("source_file"),
        F.col("l_linenumber").alias("source_page"),
        # arrival order; the value breaks the rare tie
        F.struct(
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("n"),
            F.col("l_extendedprice").alias("v"),
        ).alias("seq"),
        F.col("l_linestatus"),
    )


COLS = ["company", "metric", "value", "unit", "year", "is_estimate", "confidence", "source_file", "source_page"]
COLS_SQL = ", ".join(COLS)


@query("best_fact", with_sql(FACTS) + f"""
SELECT {COLS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY company, metric, year
  ORDER BY confidence DESC, source_page, seq0, price) AS n FROM facts) WHERE n = 1""")
def best_fact(t):
    return fact_ops.best_fact(facts(t).select(*COLS, "seq")).select(*COLS)


FIRST = """first_in AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, metric, year, source_file
  ORDER BY seq0, price) AS n FROM facts) WHERE n = 1)"""


@query("insert_ignore", with_sql(FACTS, FIRST) + f""",
loaded AS (SELECT {COLS_SQL} FROM first_in WHERE year < '1998')
SELECT {COLS_SQL} FROM loaded
UNION ALL SELECT {COLS_SQL} FROM first_in f WHERE NOT EXISTS (SELECT 1 FROM loaded l
  WHERE l.company = f.company AND l.metric = f.metric AND l.year = f.year AND l.source_file = f.source_file)""")
def insert_ignore(t):
    """Older years are loaded already; all facts arrive again."""
    from shelfmark.functions.windows import first_per_key

    all_facts = facts(t).select(*COLS, "seq")
    loaded = first_per_key(all_facts.filter(F.col("year") < "1998"), fact_ops.FACT_KEY, [F.col("seq")]).select(*COLS)
    return ingest.insert_ignore(loaded, all_facts, fact_ops.FACT_KEY, "seq")


@query("insert_replace", """
WITH new_rows AS (SELECT 'r' || CAST(l_orderkey % 50 AS VARCHAR) || '.pdf' AS filename, max(l_shipdate) AS processed_at
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
target AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.pdf' AS filename, TIMESTAMP '1994-01-01 00:00:00' AS processed_at FROM supplier
  UNION ALL SELECT DISTINCT 'r' || CAST(l_orderkey % 50 AS VARCHAR) || '.pdf', TIMESTAMP '1994-01-01 00:00:00' FROM lineitem)
SELECT * FROM new_rows UNION ALL SELECT * FROM target WHERE filename NOT IN (SELECT filename FROM new_rows)""")
def insert_replace(t):
    """Processed files by name; the latest mark wins."""
    start = F.lit("1994-01-01 00:00:00").cast("timestamp_ntz").alias("processed_at")
    report = F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".pdf")).alias("filename")
    other = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("filename")
    target = t["supplier"].select(other, start).unionByName(t["lineitem"].select(report).distinct().select("filename", start))
    new = t["lineitem"].filter("l_linestatus = 'F'").select(
        report, F.col("l_shipdate").alias("processed_at"), F.col("l_shipdate").alias("seq")
    )
    return ingest.upsert(target, new, ["filename"], "seq")


LOOKUP = """SELECT company, metric, value, unit, year, is_estimate, confidence, source_file, source_page
FROM financial_metrics
WHERE company LIKE '%1%' AND metric IN ('收入', '净利润') AND year LIKE '%97%'
ORDER BY confidence DESC, source_page ASC"""
COMPARE = """SELECT company, metric, value, unit, year, source_file, source_page
FROM financial_metrics
WHERE metric = '毛利率' AND year LIKE '%98%'
ORDER BY value DESC"""


@query("metrics_lookup", with_sql(FACTS) + " " + LOOKUP.replace("financial_metrics", "facts"))
def metrics_lookup(t):
    return fact_ops.query_metrics(t.spark, facts(t), LOOKUP)


@query("metrics_compare", with_sql(FACTS) + " " + COMPARE.replace("financial_metrics", "facts"))
def metrics_compare(t):
    return fact_ops.query_metrics(t.spark, facts(t), COMPARE)


@query("fact_lines", with_sql(FACTS) + """
SELECT company || ' | ' || metric || CASE WHEN is_estimate = 1 THEN '（预测值）' ELSE '' END || ' = ' || CAST(value AS VARCHAR) || ' '
  || unit || ' [' || year || ']' || chr(10) || '  📄 来源: ' || source_file || ' · 第 ' || CAST(source_page AS VARCHAR) || ' 页' AS line
FROM facts""")
def fact_lines(t):
    return facts(t).select(fact_ops.fact_lines(None).alias("line"))


@query("facts_from_json", """
SELECT l_orderkey AS doc_id, 0 AS fact_no, 'S' || CAST(l_suppkey AS VARCHAR) AS company, '收入' AS metric, l_extendedprice AS value,
       CAST(year(l_shipdate) AS VARCHAR) AS year, 0 AS is_estimate
FROM lineitem WHERE l_tax > 0
UNION ALL SELECT l_orderkey, 1, 'S' || CAST(l_suppkey AS VARCHAR), '净利润', l_quantity, CAST(year(l_shipdate) + 1 AS VARCHAR), 1
FROM lineitem WHERE l_tax > 0 AND l_returnflag <> 'N'""")
def facts_from_json(t):
    """Fenced JSON arrays; untaxed lines are cut short and thus no JSON, some facts have no company."""
    li = t["lineitem"]
    full = F.format_string(
        '```json\n[{"company": "S%d", "metric": "收入", "value": %s, "year": "%d"}, '
        '{"company": "%s", "metric": "净利润", "value": %s, "year": "%d", "is_estimate": 1}]\n```',
        F.col("l_suppkey"), F.col("l_extendedprice").cast("string"), F.year("l_shipdate"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))),
        F.col("l_quantity").cast("string"), F.year("l_shipdate") + 1,
    )
    text = F.when(F.col("l_tax") > 0, full).otherwise(F.substring(full, 1, 60))
    pages = li.select(F.col("l_orderkey").alias("doc_id"), text.alias("json"))
    return fact_ops.facts_from_json(pages).select("doc_id", "fact_no", "company", "metric", "value", "year", "is_estimate")


@query("norm_period", """
SELECT raw, year, is_estimate FROM (
  SELECT CASE k WHEN 0 THEN y || 'E' WHEN 1 THEN '预计' || y || '年' WHEN 2 THEN 'FY' || substr(y, 3) WHEN 3 THEN '1H' || substr(y, 3) WHEN 4 THEN '未知' ELSE y END AS raw,
         CASE k WHEN 2 THEN 'FY' || substr(y, 3) WHEN 3 THEN '1H' || substr(y, 3) WHEN 4 THEN NULL ELSE y END AS year,
         CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END AS is_estimate
  FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS y, l_linenumber - 1 AS k FROM lineitem))""")
def norm_period(t):
    y = F.year("l_shipdate").cast("string")
    k = F.col("l_linenumber") - 1
    short = F.substring(y, 3, 2)
    raw = (
        F.when(k == 0, F.concat(y, F.lit("E"))).when(k == 1, F.concat(F.lit("预计"), y, F.lit("年")))
        .when(k == 2, F.concat(F.lit("FY"), short)).when(k == 3, F.concat(F.lit("1H"), short)).when(k == 4, "未知").otherwise(y)
    )
    r = t["lineitem"].select(raw.alias("raw"))
    return r.select(
        "raw", fact_ops.period_year(F.col("raw")).alias("year"), fact_ops.period_is_estimate(F.col("raw")).alias("is_estimate")
    )


@query("norm_value", """
SELECT raw, value, unit FROM (
  SELECT CAST(p // 1000 AS VARCHAR) || ',' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') || '.5' ||
         CASE f WHEN 'N' THEN '%' WHEN 'A' THEN '亿元' ELSE '' END AS raw,
         p + 0.5::DOUBLE AS value, CASE f WHEN 'N' THEN '%' WHEN 'A' THEN '亿元' END AS unit
  FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS p, l_returnflag AS f FROM lineitem))""")
def norm_value(t):
    p = F.floor("l_extendedprice")
    unit = F.when(F.col("l_returnflag") == "N", "%").when(F.col("l_returnflag") == "A", "亿元").otherwise("")
    raw = F.concat(
        F.floor(p / 1000).cast("string"), F.lit(","), F.lpad((p % 1000).cast("string"), 3, "0"), F.lit(".5"), unit
    )
    r = t["lineitem"].select(raw.alias("raw"))
    return r.select("raw", fact_ops.number_value(F.col("raw")).alias("value"), fact_ops.number_unit(F.col("raw")).alias("unit"))


@query("extract_facts", """
WITH s AS (SELECT o_orderkey, c_name || '集团' AS company, o_totalprice AS price, abs(c_acctbal) AS acct, year(o_orderdate) AS y,
  CAST(o_custkey % 90 AS BIGINT) AS share FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS doc_id, 0 AS fact_no, company, '收入' AS metric, '收入' AS raw_metric, price AS value, '百万美元' AS unit, CAST(y AS VARCHAR) AS year, 0 AS is_estimate FROM s
UNION ALL SELECT o_orderkey, 1, company, '净利润', '归母净利润', acct, '亿元人民币', CAST(y + 1 AS VARCHAR), 1 FROM s
UNION ALL SELECT o_orderkey, 2, company, '市场份额', '市场份额占比', share + 0.5::DOUBLE, '%', CAST(y AS VARCHAR), 0 FROM s
UNION ALL SELECT o_orderkey, 3, company, 'ROE', 'ROE', 1200.0::DOUBLE + share, '%', CAST(y AS VARCHAR), 0 FROM s
UNION ALL SELECT o_orderkey, 4, company, 'EV/EBITDA', 'EV/EBITDA', share + 0.0::DOUBLE, '倍', CAST(y + 2 AS VARCHAR), 1 FROM s""")
def extract_facts(t):
    """Sentences written from orders and customers; the facts come back out."""
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    y = F.year("o_orderdate")
    share = F.col("o_custkey") % 90
    text = F.concat(
        F.col("c_name"), F.lit("集团"), y.cast("string"), F.lit("年收入为"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.lit("百万美元，预计"), (y + 1).cast("string"), F.lit("年归母净利润达到"),
        F.abs("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("亿元人民币，市场份额占比"), share.cast("string"), F.lit(".5%，ROE为1,2"),
        F.lpad(share.cast("string"), 2, "0"), F.lit("%；"), (y + 2).cast("string"), F.lit("E年EV/EBITDA为"), share.cast("string"), F.lit("倍。"),
    )
    return fact_ops.extract_facts(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), min_chars=50)


@query("fences", """
SELECT event_id,
  CASE event_type WHEN 'click' THEN props WHEN 'purchase' THEN 'sql' || chr(10) || 'SELECT value FROM t WHERE id = ' || CAST(event_id AS VARCHAR)
    WHEN 'error' THEN 'result: ' || props || ' done' WHEN 'signup' THEN 'I suggest select x from y where z = ' || CAST(event_id AS VARCHAR) ELSE props END AS json_fence,
  CASE event_type WHEN 'click' THEN 'json' || chr(10) || props WHEN 'purchase' THEN 'SELECT value FROM t WHERE id = ' || CAST(event_id AS VARCHAR)
    WHEN 'error' THEN 'result: ' || props || ' done' WHEN 'signup' THEN 'select x from y where z = ' || CAST(event_id AS VARCHAR) ELSE props END AS sql_text,
  CASE event_type WHEN 'click' THEN props WHEN 'purchase' THEN 'sql' || chr(10) || 'SELECT value FROM t WHERE id = ' || CAST(event_id AS VARCHAR)
    WHEN 'error' THEN props WHEN 'signup' THEN 'I suggest select x from y where z = ' || CAST(event_id AS VARCHAR) ELSE props END AS json_text
FROM events""")
def fences(t):
    """Model answers built from the event log: fenced JSON, bare JSON, JSON in prose, fenced SQL, SQL in prose."""
    kind, props, eid = F.col("event_type"), F.col("props"), F.col("event_id").cast("string")
    raw = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("```sql\nSELECT value FROM t WHERE id = "), eid, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("result: "), props, F.lit(" done")))
        .when(kind == "signup", F.concat(F.lit("I suggest select x from y where z = "), eid))
        .otherwise(props)
    )
    r = t["events"].select("event_id", raw.alias("raw"))
    return r.select(
        "event_id", text_fn.strip_json_fence(F.col("raw")).alias("json_fence"),
        text_fn.extract_sql(F.col("raw")).alias("sql_text"), text_fn.extract_json_object(F.col("raw")).alias("json_text"),
    )


@query("trim_variants", """
SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 117) || '...' END AS three,
  CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 79) || '…' END AS one,
  CASE WHEN length(s) <= 100 THEN s ELSE regexp_replace(substr(s, 1, 100), '\\s+$', '') || '...' END AS clean
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)""")
def trim_variants(t):
    c = F.col("text")
    return t["documents"].select(
        "doc_id", text_fn.trim_three_dots(c, 120).alias("three"), text_fn.trim_one_dot(c, 80).alias("one"),
        text_fn.trim_clean_end(c, 100).alias("clean"),
    )


@query("clamp", """
SELECT event_id, greatest(1, least(10, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END, 3))) AS top_k FROM events""")
def clamp(t):
    raw = F.when(F.col("event_type") == "error", "many").otherwise(F.get_json_object("props", "$.k"))
    return t["events"].select("event_id", text_fn.clamp_int(raw, 3, 1, 10).alias("top_k"))
