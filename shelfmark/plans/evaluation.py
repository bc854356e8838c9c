"""Bound queries: evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.patterns import first_rule, mentions
from shelfmark.functions.text import tokens
from shelfmark.operators import evaluation as ev
from shelfmark.operators.lexical import bm25_topk
from shelfmark.operators.quality import is_boilerplate, is_noise_question
from shelfmark.plans.bindings import CHUNKS, LEXICAL, QUERIES_SQL, strip_sql, tokens_sql, with_sql
from shelfmark.plans.registry import query
from shelfmark.plans.retrieval import VECTORS, vector_hits

BOILER = (
    "(?s)免责声明|分析师声明|评级说明|风险提示.*本报告|版权所有.*禁止|执业编号|"
    "请务必阅读正文之后的免责|本报告仅供.*客户使用|证券投资咨询业务资格"
)
MARKED = CHUNKS + """,
marked AS (SELECT c.chunk_id, c.industry, c.doc_id, CASE WHEN l.quality = 0 THEN '本报告仅供' || content || '客户使用'
  WHEN l.toxic = 1 THEN content || '免责声明' ELSE content END AS content
  FROM chunks c LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""


def marked(t):
    """Chunks with legal phrases around low-quality and after toxic texts."""
    labels = t["labels"].groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    content = (
        F.when(F.col("quality") == 0, F.concat(F.lit("本报告仅供"), "content", F.lit("客户使用")))
        .when(F.col("toxic") == 1, F.concat("content", F.lit("免责声明")))
        .otherwise(F.col("content"))
    )
    return t.chunks.join(labels, "doc_id", "left").select("chunk_id", "industry", "doc_id", content.alias("content"))


@query("noise_chunks", with_sql(MARKED) + f"""
SELECT chunk_id, regexp_matches(substr(content, 1, 600), '{BOILER}') AS is_noise FROM marked""")
def noise_chunks(t):
    return marked(t).select("chunk_id", is_boilerplate(F.col("content")).alias("is_noise"))


QUESTIONS = """questions AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN text || '联系我们'
  WHEN 'assistant' THEN CASE WHEN length(text) < 100 THEN ' ab ' ELSE text END ELSE text END AS question FROM conversations)"""
NOISE = ("免责声明|版权所有|联系我们|客服电话|扫码关注|转载请注明|本报告仅供|投资者须知|风险提示|请联系|官方网站|邮箱|传真")


def questions(t):
    q = (
        F.when(F.col("role") == "system", F.concat("text", F.lit("联系我们")))
        .when((F.col("role") == "assistant") & (F.length("text") < 100), " ab ")
        .otherwise(F.col("text"))
    )
    return t["conversations"].select("conv_id", "turn", "role", q.alias("question"))


@query("noise_questions", with_sql(QUESTIONS) + f"""
SELECT conv_id, turn, question FROM questions
WHERE length({strip_sql('question')}) >= 5 AND NOT regexp_matches(question, '{NOISE}')""")
def noise_questions(t):
    return questions(t).filter(~is_noise_question(F.col("question"))).select("conv_id", "turn", "question")


@query("filter_counts", with_sql(QUESTIONS) + f""",
r AS (SELECT length({strip_sql('question')}) < 5 OR regexp_matches(question, '{NOISE}') AS noise, role FROM questions)
SELECT count(*) AS total, count(*) FILTER (WHERE noise) AS dropped, count(*) FILTER (WHERE NOT noise) AS kept,
  round(count(*) FILTER (WHERE NOT noise AND role <> 'user')::DOUBLE / count(*) FILTER (WHERE NOT noise), 4) AS empty_ratio FROM r""")
def filter_counts(t):
    """User turns count as answered with one context."""
    return ev.filter_counts(questions(t).withColumn("contexts_count", F.when(F.col("role") == "user", 1).otherwise(0)))


@query("stratified_sample", with_sql(MARKED) + f""",
fit AS (SELECT chunk_id, industry, md5('42-' || chunk_id) AS o FROM marked
  WHERE length({strip_sql('content')}) >= 100 AND NOT regexp_matches(substr(content, 1, 600), '{BOILER}')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY o, chunk_id) AS n FROM fit)
SELECT chunk_id, industry FROM ranked WHERE n <= greatest(1, 150 // (SELECT count(DISTINCT industry) FROM fit))
ORDER BY o, chunk_id LIMIT 150""")
def stratified_sample(t):
    return ev.stratified_sample(marked(t), 150).select("chunk_id", "industry")


@query("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def sample_n(t):
    return ev.sample_n(t["documents"].select("doc_id", "lang"), "doc_id", 100)


@query("prefix_dedup", """
SELECT doc_id, question FROM (SELECT doc_id, text AS question, row_number() OVER (PARTITION BY substr(text, 1, 10) ORDER BY doc_id) AS n
FROM documents) WHERE n = 1""")
def prefix_dedup(t):
    return ev.prefix_dedup(t["documents"].select("doc_id", F.col("text").alias("question")), "doc_id")


@query("industry_dist", "SELECT lang AS industry, count(*) AS n FROM documents GROUP BY ALL")
def industry_dist(t):
    return ev.industry_dist(t["documents"].select(F.col("lang").alias("industry")))


# --- scores of the vector search: same label means relevant ------------------------------

SCORES = """judged AS (SELECT query_id, rank, CASE WHEN want = got THEN 1 ELSE 0 END AS rel FROM top),
prec AS (SELECT *, CAST(sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) * (2520 // rank) AS p FROM judged),
ap AS (SELECT query_id, round(coalesce(CAST(sum(p * rel) AS DOUBLE) / nullif(sum(rel) * 2520, 0), 0.0), 4) AS context_precision FROM prec GROUP BY query_id),
sizes AS (SELECT label, count(*) - 1 AS n_relevant FROM v GROUP BY label),
rec AS (SELECT query_id, sum(rel) > 0 AS hit, round(sum(rel)::DOUBLE / nullif(any_value(n_relevant), 0), 4) AS context_recall
  FROM judged JOIN v ON vec_id = query_id JOIN sizes USING (label) GROUP BY query_id),
best AS (SELECT query_id, score FROM top WHERE rank = 1),
records AS (SELECT query_id, CASE WHEN label = 0 THEN ' ' ELSE 'group ' || CAST(label AS VARCHAR) END AS industry,
  context_precision, context_recall, CASE WHEN score >= 0.35 THEN round(score, 4) END AS faithfulness
  FROM ap JOIN rec USING (query_id) JOIN best USING (query_id) JOIN v ON vec_id = query_id)"""


def vector_judged(t):
    hits = vector_hits(t)
    labels = t.vectors.select("chunk_id", "label")
    named = hits.join(labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    named = named.join(labels, "chunk_id")
    return named.withColumn("rel", F.when(F.col("want") == F.col("label"), 1).otherwise(0))


def relevant_counts(t):
    v = t.vectors.select(F.col("chunk_id").alias("query_id"), "label")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return v.join(sizes, "label").select("query_id", "n_relevant")


@query("eval_precision", with_sql(VECTORS, SCORES) + " SELECT query_id, context_precision FROM ap")
def eval_precision(t):
    return ev.average_precision(vector_judged(t))


@query("eval_recall", with_sql(VECTORS, SCORES) + " SELECT query_id, hit, context_recall FROM rec")
def eval_recall(t):
    return ev.recall(vector_judged(t), relevant_counts(t))


def eval_records(t):
    rows = vector_judged(t)
    best = rows.filter("rank = 1").select(
        "query_id", F.when(F.col("score") >= 0.35, F.round("score", 4)).alias("faithfulness"),
        F.when(F.col("want") == 0, " ").otherwise(F.concat(F.lit("group "), F.col("want").cast("string"))).alias("industry"),
    )
    return ev.average_precision(rows).join(ev.recall(rows, relevant_counts(t)), "query_id").join(best, "query_id")


SUMMARY = SCORES + """,
summary AS (SELECT 'global' AS scope, NULL AS industry, CAST((2 * sum(CAST(round(context_precision * 10000) AS BIGINT)) + count(context_precision)) // (2 * count(context_precision)) AS DOUBLE) / 10000 AS context_precision,
    CAST((2 * sum(CAST(round(context_recall * 10000) AS BIGINT)) + count(context_recall)) // (2 * count(context_recall)) AS DOUBLE) / 10000 AS context_recall, CAST((2 * sum(CAST(round(faithfulness * 10000) AS BIGINT)) + count(faithfulness)) // (2 * count(faithfulness)) AS DOUBLE) / 10000 AS faithfulness, count(*) AS n FROM records
  UNION ALL SELECT 'industry', industry, CAST((2 * sum(CAST(round(context_precision * 10000) AS BIGINT)) + count(context_precision)) // (2 * count(context_precision)) AS DOUBLE) / 10000, CAST((2 * sum(CAST(round(context_recall * 10000) AS BIGINT)) + count(context_recall)) // (2 * count(context_recall)) AS DOUBLE) / 10000, CAST((2 * sum(CAST(round(faithfulness * 10000) AS BIGINT)) + count(faithfulness)) // (2 * count(faithfulness)) AS DOUBLE) / 10000, count(*)
  FROM records WHERE trim(industry) <> '' GROUP BY industry HAVING count(*) >= 3)"""


@query("eval_summary", with_sql(VECTORS, SUMMARY) + " SELECT * FROM summary")
def eval_summary(t):
    return ev.eval_summary(eval_records(t))


@query("eval_flags", with_sql(VECTORS, SUMMARY) + """
SELECT scope, industry, coalesce(context_recall < 0.5, false) AS low_recall, coalesce(context_precision < 0.5, false) AS low_precision,
  coalesce(faithfulness < 0.6, false) AS low_faithfulness FROM summary""")
def eval_flags(t):
    return ev.eval_flags(ev.eval_summary(eval_records(t)))


@query("eval_detail", with_sql(CHUNKS, QUERIES_SQL, LEXICAL) + """,
ctx AS (SELECT query_id, count(*) AS n, '[' || string_agg('{"file":"' || source || '","page":' || CAST(page AS VARCHAR) || '}', ',' ORDER BY rank) || ']' AS sources,
  max(score) AS top FROM bm25 JOIN chunks USING (chunk_id) WHERE rank <= 3 GROUP BY query_id)
SELECT query AS question, 'benchmark' AS industry, query_id + 1 AS page, replace(substr(query, 1, 80), chr(10), ' ') AS chunk_text_preview,
  round(top / 100, 4) AS context_precision, NULL::DOUBLE AS context_recall, 0.5::DOUBLE AS faithfulness, n IS NOT NULL AS retrieve_ok,
  coalesce(n, 0) AS contexts_count, coalesce(sources, '[]') AS sources
FROM queries LEFT JOIN ctx USING (query_id)""")
def eval_detail(t):
    """Report rows for the benchmark questions with their three best passages."""
    top = bm25_topk(t.queries, t.chunks, k=3).join(t.chunks.select("chunk_id", "source", "page"), "chunk_id")
    item = F.struct("rank", "chunk_id", "source", "page", "score")
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"), F.max("score").alias("top"))
    got = lists.select(
        "query_id", "top", F.transform("c", lambda x: x["chunk_id"]).alias("contexts"),
        F.transform("c", lambda x: F.struct(x["source"].alias("file"), x["page"].alias("page"))).alias("sources"),
    )
    empty = F.array().cast("array<string>")
    no_source = F.array().cast("array<struct<file:string,page:bigint>>")
    rows = t.queries.join(got, "query_id", "left").select(
        F.col("query").alias("question"), F.lit("benchmark").alias("industry"), (F.col("query_id") + 1).alias("page"),
        F.col("query").alias("chunk_text"), F.round(F.col("top") / 100, 4).alias("context_precision"),
        F.lit(None).cast("double").alias("context_recall"), F.lit(0.5).alias("faithfulness"),
        F.col("contexts").isNotNull().alias("retrieve_ok"), F.coalesce("contexts", empty).alias("contexts"),
        F.coalesce("sources", no_source).alias("sources"),
    )
    return ev.eval_detail(rows)


# Words of the given texts stand in for the fixed ones, several of them overlapping.
TAG_WORDS = {"first": ["ein", "ción"], "second": ["the", "eau"], "third": ["os", "er"]}


@query("industry_tag", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(text, '{w}')" for w in words)} THEN '{name}'" for name, words in TAG_WORDS.items()) + " END AS industry FROM documents")
def industry_tag(t):
    return t["documents"].select("doc_id", ev.industry_tag(F.col("text"), TAG_WORDS).alias("industry"))


# A large rule table: every longer word of the benchmark is a pattern, its category and precedence come from its hash.
RULES = f"""rules AS (SELECT pattern, 'c' || substr(md5(pattern), 1, 1) AS category, ('0x' || substr(md5(pattern), 3, 6))::BIGINT AS priority
  FROM (SELECT DISTINCT unnest({tokens_sql('text')}) AS pattern FROM benchmark) WHERE length(pattern) >= 6)"""


def rules(t):
    words = t["benchmark"].select(F.explode(tokens(F.col("text"))).alias("pattern")).distinct().filter(F.length("pattern") >= 6)
    md5 = F.md5("pattern")
    return words.select("pattern", F.concat(F.lit("c"), F.substring(md5, 1, 1)).alias("category"), F.conv(F.substring(md5, 3, 6), 16, 10).cast("long").alias("priority"))


@query("rule_tags", with_sql(RULES) + """
SELECT doc_id, arg_min(category, {'p': priority, 'c': category}) AS category FROM documents LEFT JOIN rules ON contains(text, pattern) GROUP BY doc_id""")
def rule_tags(t):
    """The category of the first rule, in order of precedence, that names a word of the document."""
    return t["documents"].select("doc_id", first_rule(F.col("text"), rules(t)).alias("category"))


@query("rule_mentions", with_sql(RULES) + " SELECT doc_id, pattern, CAST(instr(text, pattern) AS INT) AS at FROM documents JOIN rules ON contains(text, pattern)")
def rule_mentions(t):
    """Every rule that a document mentions, and where first."""
    return mentions(t["documents"].select("doc_id", "text"), rules(t)).select("doc_id", "pattern", "at")
