"""Bound queries: request log, limits, usage and cost, stage timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.windows import running
from shelfmark.operators import requests as rq
from shelfmark.plans.bindings import with_sql
from shelfmark.plans.registry import query

# Event density is low, so the tests use one-hour windows.
WINDOW, LIMIT, BUDGET = 3600, 2, 500
ROUTES = ["/api/v1/click/{id}", "/api/v1/view/{id}", "/api/v1/purchase/{id}"]

REQUESTS = """req AS (SELECT event_id AS request_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k,
  'key-' || CAST(user_id % 10 AS VARCHAR) AS bucket, CAST(floor(value) AS BIGINT) AS tokens, value / 10 AS duration_s,
  CASE WHEN event_type = 'signup' THEN '/api/v1/metrics' ELSE '/api/v1/' || event_type || '/' || CAST(user_id AS VARCHAR) END AS path,
  CASE WHEN CAST(props->>'$.k' AS BIGINT) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN CAST(props->>'$.k' AS BIGINT) < 70 THEN 200 WHEN CAST(props->>'$.k' AS BIGINT) < 85 THEN 404 WHEN CAST(props->>'$.k' AS BIGINT) < 95 THEN 429 END AS status,
  CASE CAST(props->>'$.k' AS BIGINT) % 3 WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'deepseek-v4-pro' ELSE 'in-house' END AS model,
  ts + to_microseconds(CAST(floor(value * 100000) AS BIGINT)) AS ended_at FROM events)"""


def requests(t):
    return requests_of(t["events"])


def requests_of(events):
    """The request view of an event table, batch or streaming."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    path = F.when(F.col("event_type") == "signup", rq.METRICS_PATH).otherwise(
        F.concat(F.lit("/api/v1/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    )
    return events.select(
        F.col("event_id").alias("request_id"), "ts", "user_id", "event_type", "value", k.alias("k"),
        F.concat(F.lit("key-"), (F.col("user_id") % 10).cast("string")).alias("bucket"),
        F.floor("value").cast("bigint").alias("tokens"), (F.col("value") / 10).alias("duration_s"), path.alias("path"),
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(k < 70, 200).when(k < 85, 404).when(k < 95, 429).alias("status"),
        F.when(k % 3 == 0, "deepseek-v4-flash").when(k % 3 == 1, "deepseek-v4-pro").otherwise("in-house").alias("model"),
        F.timestamp_add("MICROSECOND", F.floor(F.col("value") * 100000), F.col("ts")).alias("ended_at"),
    )


LIMITED = f"""lim AS (SELECT *, n > {LIMIT} AS rejected, CASE WHEN n > {LIMIT} THEN {WINDOW} + 1 - s % {WINDOW} END AS retry_after FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, window_start ORDER BY ts, request_id) AS n FROM (
    SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) // {WINDOW} * {WINDOW} AS window_start FROM req)))"""
BUDGETED = f"""bud AS (SELECT *, CASE WHEN rejected THEN 'rpm' WHEN used_before >= {BUDGET} THEN 'budget' END AS reason FROM (
  SELECT *, list_reduce(list_concat([0::BIGINT], coalesce(before, [])), lambda used, x: CASE WHEN used >= {BUDGET} THEN used ELSE used + x END) AS used_before FROM (
    SELECT *, list(CAST(CASE WHEN rejected THEN 0 ELSE tokens END AS BIGINT)) OVER (PARTITION BY bucket, CAST(ts AS DATE) ORDER BY ts, request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lim)))"""


@query("bucket_key", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'key-' || CAST(user_id AS VARCHAR) WHEN 'view' THEN 'client:10.0.' || CAST(user_id AS VARCHAR) || '.1'
  WHEN 'error' THEN 'client:172.16.0.' || CAST(user_id AS VARCHAR) ELSE 'client:unknown' END AS bucket FROM events""")
def bucket_key(t):
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    key = F.when(kind == "click", F.concat(F.lit("key-"), u)).otherwise("")
    xff = F.when(kind.isin("click", "view"), F.concat(F.lit(" 10.0."), u, F.lit(".1 , 192.168.0.1"))).otherwise("")
    peer = F.when(kind == "error", F.concat(F.lit("172.16.0."), u))
    return t["events"].select("event_id", rq.bucket_key(key, xff, peer).alias("bucket"))


@query("thread_ns", """
WITH asked AS (SELECT event_id, 'user:key-' || CAST(user_id % 10 AS VARCHAR) || ':s' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS thread_id FROM events),
threads AS (SELECT 'user:key-' || CAST(conv_id % 10 AS VARCHAR) || ':s' || CAST(conv_id AS VARCHAR) AS thread_id, turn, role FROM conversations)
SELECT event_id AS request_id, thread_id, turn, role FROM asked JOIN threads USING (thread_id)""")
def thread_ns(t):
    """Callers ask for sessions by number; only those of their own bucket answer."""
    asked = requests(t).select("request_id", "bucket", F.concat(F.lit("s"), F.col("tokens").cast("string")).alias("session_id"))
    owner = F.concat(F.lit("key-"), (F.col("conv_id") % 10).cast("string"))
    threads = t["conversations"].select(
        rq.thread_id(owner, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("thread_id"), "turn", "role"
    )
    return rq.own_history(asked, threads).select("request_id", "thread_id", "turn", "role")


@query("rate_limit", with_sql(REQUESTS, LIMITED) + " SELECT request_id, bucket, window_start, n, rejected, retry_after FROM lim")
def rate_limit(t):
    return rq.rate_limit(requests(t).select("request_id", "ts", "bucket"), LIMIT, WINDOW).select(
        "request_id", "bucket", "window_start", "n", "rejected", "retry_after"
    )


def verdicts(t):
    limited = rq.rate_limit(requests(t).select("request_id", "ts", "bucket", "tokens"), LIMIT, WINDOW)
    return rq.token_budget(limited, BUDGET)


@query("token_budget", with_sql(REQUESTS, LIMITED, BUDGETED) + " SELECT request_id, bucket, rejected, used_before, reason FROM bud")
def token_budget(t):
    return verdicts(t).select("request_id", "bucket", "rejected", "used_before", "reason")


@query("rejections", with_sql(REQUESTS, LIMITED, BUDGETED) + " SELECT reason, count(*) AS n FROM bud WHERE reason IS NOT NULL GROUP BY reason")
def rejections(t):
    return rq.rejections(verdicts(t))


@query("inflight", with_sql(REQUESTS) + """,
e AS (SELECT request_id, ts, 1 AS delta FROM req UNION ALL SELECT request_id, ended_at, -1 FROM req)
SELECT request_id, ts, delta, CAST(sum(delta) OVER (ORDER BY ts, delta, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM e""")
def inflight(t):
    return rq.inflight(requests(t)).select("request_id", "ts", "delta", "in_flight")


ROUTE = """CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '/api/v1/' || event_type || '/{id}' ELSE 'unmatched' END"""


@query("route_template", with_sql(REQUESTS) + f" SELECT request_id, path, {ROUTE} AS template FROM req")
def route_template(t):
    return requests(t).select("request_id", "path", rq.route_template(F.col("path"), ROUTES).alias("template"))


@query("http_counters", with_sql(REQUESTS) + f"""
SELECT method, {ROUTE} AS template, CAST(coalesce(status, 0) AS VARCHAR) AS status, count(*) AS n FROM req
WHERE event_type <> 'signup' GROUP BY ALL""")
def http_counters(t):
    return rq.http_counters(requests(t), ROUTES)


def hist_sql(labels: str, value: str, bounds: list[float]) -> str:
    cells = ", ".join(f"('{b}', {b}::DOUBLE)" for b in bounds)
    return f""" SELECT {labels}, le, count(*) FILTER (WHERE {value} <= bound) AS bucket_count, round(sum({value}), 4) AS sum, count(*) AS count
FROM req CROSS JOIN (VALUES {cells}, ('+Inf', 'inf'::DOUBLE)) AS b(le, bound) GROUP BY {labels}, le"""


@query("latency_hist", with_sql(REQUESTS) + hist_sql("method, event_type", "duration_s", rq.LATENCY_BOUNDS))
def latency_hist(t):
    return rq.latency_hist(requests(t), ["method", "event_type"], "duration_s", rq.LATENCY_BOUNDS)


@query("ttft_hist", with_sql(REQUESTS) + hist_sql("model", "duration_s", rq.TTFT_BOUNDS))
def ttft_hist(t):
    return rq.latency_hist(requests(t), ["model"], "duration_s", rq.TTFT_BOUNDS)


# --- usage ---------------------------------------------------------------------------------

USAGE = """used AS (SELECT request_id, model, ts, user_id, event_type,
  CASE WHEN event_type IN ('click', 'view') THEN tokens WHEN event_type = 'signup' THEN 0 ELSE tokens END AS cache_hit_tokens,
  CASE WHEN event_type IN ('click', 'view') THEN k WHEN event_type = 'signup' THEN 0 ELSE greatest(0, k - tokens) END AS cache_miss_tokens,
  CASE WHEN event_type = 'signup' THEN 0 ELSE k * 2 END AS completion_tokens,
  CASE WHEN event_type IN ('click', 'view') THEN k // 2 ELSE 0 END AS reasoning_tokens FROM req),
costed AS (SELECT *, coalesce(CASE model WHEN 'deepseek-v4-flash' THEN cache_hit_tokens / 1000000 * 0.0028::DOUBLE + cache_miss_tokens / 1000000 * 0.14::DOUBLE + completion_tokens / 1000000 * 0.28::DOUBLE
  WHEN 'deepseek-v4-pro' THEN cache_hit_tokens / 1000000 * 0.003625::DOUBLE + cache_miss_tokens / 1000000 * 0.435::DOUBLE + completion_tokens / 1000000 * 0.87::DOUBLE END, 0.0) AS cost_usd,
  cache_hit_tokens + cache_miss_tokens AS prompt_tokens, cache_hit_tokens + cache_miss_tokens + completion_tokens AS total_tokens FROM used)"""


def calls(t):
    """Model calls: two kinds carry the full usage record, two the short one, one none at all."""
    r = requests(t)
    full = F.format_string(
        '{"prompt_cache_hit_tokens": %d, "prompt_cache_miss_tokens": %d, "completion_tokens": %d, "completion_tokens_details": {"reasoning_tokens": %d}}',
        F.col("tokens"), F.col("k"), F.col("k") * 2, F.floor(F.col("k") / 2),
    )
    short = F.format_string(
        '{"input_tokens": %d, "output_tokens": %d, "input_token_details": {"cache_read": %d}}',
        F.col("k"), F.col("k") * 2, F.col("tokens"),
    )
    kind = F.col("event_type")
    return r.select(
        "request_id", "model", "ts", "user_id", "event_type",
        F.when(kind.isin("click", "view"), full).when(kind == "error", "{}").alias("token_usage"),
        F.when(kind.isin("error", "purchase"), short).alias("usage_metadata"),
    )


TOKEN_COLS = ["cache_hit_tokens", "cache_miss_tokens", "completion_tokens", "reasoning_tokens", "prompt_tokens", "total_tokens"]


@query("usage_buckets", with_sql(REQUESTS, USAGE) + f" SELECT request_id, {', '.join(TOKEN_COLS)} FROM costed")
def usage_buckets(t):
    return rq.usage_buckets(calls(t)).select("request_id", *TOKEN_COLS)


def costed(t):
    return rq.usage_cost(rq.usage_buckets(calls(t)))


@query("usage_cost", with_sql(REQUESTS, USAGE) + " SELECT request_id, model, round(cost_usd, 12) AS cost_usd FROM costed")
def usage_cost(t):
    return costed(t).select("request_id", "model", F.round("cost_usd", 12).alias("cost_usd"))


@query("llm_counters", with_sql(REQUESTS, USAGE) + """
SELECT 'llm_tokens_total' AS metric, 'prompt' AS type, model, CAST(sum(prompt_tokens) AS DOUBLE) AS value FROM costed GROUP BY model HAVING sum(prompt_tokens) > 0
UNION ALL SELECT 'llm_tokens_total', 'completion', model, CAST(sum(completion_tokens) AS DOUBLE) FROM costed GROUP BY model HAVING sum(completion_tokens) > 0
UNION ALL SELECT 'llm_cost_usd_total', '', model, round(sum(cost_usd), 6) FROM costed GROUP BY model HAVING round(sum(cost_usd), 6) > 0""")
def llm_counters(t):
    return rq.llm_counters(costed(t))


@query("request_rollup", with_sql(REQUESTS) + """
SELECT request_id, CAST(floor(value * 3) AS BIGINT) AS ttft_ms, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS total_ms,
  CASE WHEN k >= 50 THEN 2 ELSE 1 END * (tokens + k) AS total_tokens, round(CASE WHEN k >= 50 THEN 2 ELSE 1 END * (tokens * 0.000001::DOUBLE), 6) AS total_cost, model
FROM req""")
def request_rollup(t):
    """Event rows of each request: start, first tokens, one or two usage frames, end (missing for errors)."""
    r = requests(t)

    def frame(no, kind, factor):
        at = F.floor(F.col("value") * factor).cast("bigint")
        return F.struct(F.lit(no).alias("event_no"), F.lit(kind).alias("kind"), at.alias("at"))

    frames = F.array(
        frame(0, "start", 0), frame(1, "token", 3), frame(2, "token", 4), frame(3, "usage", 50),
        F.when(F.col("k") >= 50, frame(4, "usage", 60)), F.when(F.col("event_type") != "error", frame(5, "end", 100)),
    )
    rows = r.select("request_id", "ts", "tokens", "k", "model", F.explode(F.array_compact(frames)).alias("f"))
    usage = F.col("f.kind") == "usage"
    return rq.request_rollup(
        rows.select(
            "request_id", "f.event_no", "f.kind", F.timestamp_add("MILLISECOND", F.col("f.at"), F.col("ts")).alias("ts"),
            F.when(usage, F.when(F.col("f.event_no") == 3, F.col("model")).otherwise("later")).alias("model"),
            F.when(usage, F.col("tokens")).alias("prompt_tokens"), F.when(usage, F.col("k")).alias("completion_tokens"),
            F.when(usage, F.col("tokens") * 0.000001).alias("cost_usd"),
        )
    )


@query("usage_delta", with_sql(REQUESTS) + " SELECT request_id AS turn_id, user_id AS thread_id, tokens AS total_tokens, k AS prompt_tokens FROM req")
def usage_delta(t):
    """Counters are running sums over each user's requests; the deltas give the single requests back."""
    r = requests(t).select(F.col("user_id").alias("thread_id"), F.col("request_id").alias("turn_id"), "ts", "tokens", "k")
    log = running(
        r, ["thread_id"], rq.minute_of(F.col("ts")), [F.col("ts"), F.col("turn_id")],
        {"total_tokens": F.col("tokens"), "prompt_tokens": F.col("k")},
    ).drop("tokens", "k")
    return rq.usage_delta(log, ["total_tokens", "prompt_tokens"]).select("turn_id", "thread_id", "total_tokens", "prompt_tokens")


def turns(t):
    r = requests(t)
    return r.select(
        F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("username"), F.col("user_id").alias("thread_id"),
        F.col("request_id").alias("turn_id"), "ts", (F.col("value") / 1000).alias("cost_usd"), F.col("tokens").alias("total_tokens"),
        (F.col("k") % 5).alias("llm_calls"), (F.col("k") % 3).alias("tool_runs"), (F.col("value") * 37.3).alias("latency_ms"),
    )


@query("budget_alarm", with_sql(REQUESTS) + """,
c AS (SELECT request_id AS turn_id, user_id AS thread_id, round(sum(value / 1000) OVER (PARTITION BY user_id ORDER BY ts, request_id), 6) AS running_cost FROM req)
SELECT *, running_cost >= 1.0 AS alarm FROM c""")
def budget_alarm(t):
    return rq.budget_alarm(turns(t)).select("turn_id", "thread_id", "running_cost", "alarm")


@query("session_usage", with_sql(REQUESTS) + """
SELECT 'user-' || CAST(user_id % 10 AS VARCHAR) AS username, user_id AS thread_id, round(sum(value / 1000), 6) AS cost_usd, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  CAST(sum(k % 5) AS BIGINT) AS llm_calls, CAST(sum(k % 3) AS BIGINT) AS tool_runs, count(*) AS turns FROM req GROUP BY user_id""")
def session_usage(t):
    return rq.session_usage(turns(t))


@query("usage_text", with_sql(REQUESTS) + """
SELECT request_id AS turn_id, CASE WHEN value / 1000 < 0.001 THEN '< ¥0.01' ELSE '≈ ¥' || printf('%.2f', value / 1000 * 7.2::DOUBLE) END AS cost,
  CASE WHEN value * 37.3::DOUBLE < 1000 THEN printf('%.0f ms', value * 37.3::DOUBLE) ELSE printf('%.1f 秒', value * 37.3::DOUBLE / 1000) END AS elapsed,
  CAST(k % 5 AS VARCHAR) || ' 次' AS calls, CASE WHEN k % 3 > 0 THEN CAST(k % 3 AS VARCHAR) || ' 次' ELSE '未使用' END AS tools,
  CASE WHEN tokens >= 1000 THEN CAST(tokens // 1000 AS VARCHAR) || ',' || lpad(CAST(tokens % 1000 AS VARCHAR), 3, '0') ELSE CAST(tokens AS VARCHAR) END AS tokens FROM req""")
def usage_text(t):
    return rq.usage_text(turns(t))


# --- stages ----------------------------------------------------------------------------------


def stages(t):
    r = requests(t)
    return r.select(
        F.col("event_type").alias("stage"), F.when(F.col("k") < 10, "failed: ValueError").otherwise("success").alias("status"),
        F.col("value").alias("elapsed_s"), F.col("k").alias("token_count"), F.col("tokens").alias("doc_count"), "request_id", "ts",
    )


@query("stage_summary", with_sql(REQUESTS) + """
SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (WHERE k < 10) AS failures, round(sum(value), 2) AS elapsed_s,
  round(sum(value) / (SELECT sum(value) FROM req) * 100, 1) AS pct FROM req GROUP BY event_type""")
def stage_summary(t):
    return rq.stage_summary(stages(t))


@query("throughput", with_sql(REQUESTS) + """
SELECT request_id, CASE WHEN value > 0 THEN round(k / value, 1) END AS tokens_per_sec, CASE WHEN value > 0 THEN round(tokens / value, 3) END AS docs_per_sec FROM req""")
def throughput(t):
    return rq.throughput(stages(t)).select("request_id", "tokens_per_sec", "docs_per_sec")


@query("parallel_ratio", with_sql(REQUESTS) + """
SELECT bucket AS run_id, round(sum(value * 100) / ((max(epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 1000000) - min(epoch_us(ts))) / 1000000), 2) AS parallel_ratio
FROM req GROUP BY bucket""")
def parallel_ratio(t):
    r = requests(t)
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    tasks = r.select(
        F.col("bucket").alias("run_id"), start.alias("started_us"), (start + F.floor(F.col("value") * 100) * 1000000).alias("ended_us"),
        (F.col("value") * 100).alias("elapsed_s"),
    )
    return rq.parallel_ratio(tasks)
