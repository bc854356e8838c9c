"""Request log: admission limits, route and latency metrics, token usage and cost.

``requests(request_id, ts, bucket, tokens, ...)``. Buckets may be very hot; every order
within a bucket is cut into minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fixed_text, strip
from shelfmark.functions.windows import join_back, previous, running

# Limits, histogram bounds, prices (USD per million tokens), text formats.
WINDOW_SECONDS = 60
LATENCY_BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 120.0]
TTFT_BOUNDS = [0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0]
PRICES = {
    "deepseek-v4-flash": (0.0028, 0.14, 0.28),
    "deepseek-v4-pro": (0.003625, 0.435, 0.87),
}
ALARM_USD = 1.0
CNY_PER_USD = 7.2
METRICS_PATH = "/api/v1/metrics"
UNMATCHED = "unmatched"


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def window_start(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the fixed window holding ``ts``, as unix seconds."""
    at = F.unix_seconds(ts.cast("timestamp"))
    return at - F.pmod(at, F.lit(seconds))


def bucket_key(api_key: Column, forwarded: Column, peer: Column, prefix_len: int | None = None) -> Column:
    """The API key, else ``client:`` with the first forwarded address, the peer or unknown."""
    first = strip(F.split_part(F.nullif(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    key = F.coalesce(F.nullif(api_key, F.lit("")), F.concat(F.lit("client:"), F.coalesce(first, peer, F.lit("unknown"))))
    return key if prefix_len is None else F.substring(key, 1, prefix_len)


def thread_id(bucket: Column, session: Column) -> Column:
    return F.concat_ws(":", F.lit("user"), bucket, session)


def own_history(requests: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages of the threads a caller may read; another owner's thread is simply empty."""
    asked = requests.withColumn("thread_id", thread_id(F.col("bucket"), F.col("session_id")))
    return asked.join(threads, "thread_id")


def rate_limit(
    requests: DataFrame, limit: int, seconds: int = WINDOW_SECONDS, carried: DataFrame | None = None
) -> DataFrame:
    """Number each request in its (bucket, window); the ones beyond ``limit`` are rejected.

    Rejected requests still count. ``retry_after`` is the rest of the window plus one second.
    ``carried(bucket, window_start, carried_n)`` holds counts of earlier batches.
    """
    w = requests.withColumn("window_start", window_start(F.col("ts"), seconds))
    numbered = running(
        w, ["bucket", "window_start"], F.date_trunc("second", F.col("ts")), [F.col("ts"), F.col("request_id")], {"n": F.lit(1)}
    )
    if carried is not None:
        numbered = numbered.join(carried, ["bucket", "window_start"], "left").withColumn(
            "n", F.col("n") + F.coalesce("carried_n", F.lit(0))
        ).drop("carried_n")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rejected = F.col("n") > limit
    return numbered.withColumns(
        {"rejected": rejected, "retry_after": F.when(rejected, F.lit(seconds + 1) - F.pmod(at, F.lit(seconds)))}
    )


def token_budget(limited: DataFrame, budget: int, carried: DataFrame | None = None) -> DataFrame:
    """Post-paid daily budget after the rate limit.

    A request is rejected when the tokens used that day by earlier accepted requests of its
    bucket reach ``budget``. Only accepted requests are charged, so ``used_before`` stops at the
    first sum that reaches the budget: tokens are never negative, so that is the smallest such
    sum over all requests that passed the rate limit. ``limited`` is the
    output of ``rate_limit`` with ``tokens``; ``carried(bucket, day, carried_tokens)`` holds
    the sums of earlier batches.
    """
    charged = F.when(F.col("rejected"), F.lit(0)).otherwise(F.col("tokens")).cast("bigint")
    summed = running(
        limited.withColumn("day", F.to_date("ts")), ["bucket", "day"], minute_of(F.col("ts")),
        [F.col("ts"), F.col("request_id")], {"_upto": charged},
    )
    used = F.col("_upto") - charged
    if carried is not None:
        summed = summed.join(carried, ["bucket", "day"], "left")
        used = used + F.coalesce("carried_tokens", F.lit(0))
    summed = summed.withColumn("_used", used)
    spent = summed.filter(F.col("_used") >= budget).groupBy("bucket", "day").agg(F.min("_used").alias("_spent"))
    capped = join_back(summed, spent, ["bucket", "day"]).withColumn("used_before", F.least("_used", "_spent"))
    reason = F.when(F.col("rejected"), "rpm").when(F.col("used_before") >= budget, "budget")
    return capped.select(*limited.columns, "day", "used_before", reason.alias("reason"))


def rejections(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def inflight(requests: DataFrame) -> DataFrame:
    """Requests running right after each start and end: ``(ts, request_id, delta, in_flight)``.

    Ends come before starts at the same instant; a failed request ends too.
    """
    starts = requests.select("request_id", "ts", F.lit(1).alias("delta"))
    ends = requests.select("request_id", F.col("ended_at").alias("ts"), F.lit(-1).alias("delta"))
    return running(
        starts.unionByName(ends), [], minute_of(F.col("ts")), [F.col("ts"), F.col("delta"), F.col("request_id")],
        {"in_flight": F.col("delta")},
    )


def route_template(path: Column, routes: list[str]) -> Column:
    """The declared route a concrete path belongs to; ``{name}`` stands for one segment."""
    import re

    out = None
    for r in routes:
        pattern = "^" + re.sub(r"\\\{[^/]+\\\}", "[^/]+", re.escape(r)) + "$"
        hit = F.regexp_like(path, F.lit(pattern))
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return F.lit(UNMATCHED) if out is None else out.otherwise(UNMATCHED)


def http_counters(requests: DataFrame, routes: list[str]) -> DataFrame:
    """Requests by method, route template and status; scrapes of the metrics page do not count."""
    seen = requests.filter(F.col("path") != METRICS_PATH).withColumn("template", route_template(F.col("path"), routes))
    status = F.coalesce(F.col("status"), F.lit(0)).cast("string")
    return seen.groupBy("method", "template", status.alias("status")).agg(F.count("*").alias("n"))


def bound_index(value: Column, bounds: list[float]) -> Column:
    """Position of the smallest bound not below ``value``; ``len(bounds)`` is +Inf."""
    out = None
    for i, b in enumerate(bounds):
        out = F.when(value <= b, i) if out is None else out.when(value <= b, i)
    return out.otherwise(len(bounds))


def latency_hist(samples: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram per label set: one row per bound and +Inf, with sum and count.

    Samples are counted per bound before the shuffle; the cumulation then runs over at most
    one row per bound. A NULL sample is no observation.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*labels, bound_index(F.col(value), bounds).alias("i")).agg(
        F.count("*").alias("c"), F.sum(value).alias("s")
    )
    return cumulate(counted, labels, bounds)


def cumulate(counted: DataFrame, labels: list[str], bounds: list[float]) -> DataFrame:
    """Histogram rows from counts ``c`` and sums ``s`` per label set and bound position ``i``."""
    per_set = counted.groupBy(*labels).agg(
        F.collect_list(F.struct("i", "c")).alias("cells"), F.round(F.sum("s"), 4).alias("sum"), F.sum("c").alias("count")
    )
    names = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    rows = per_set.select(*labels, "sum", "count", "cells", F.posexplode(names).alias("i", "le"))
    upto = F.aggregate(
        F.filter("cells", lambda c: c["i"] <= F.col("i")), F.lit(0).cast("bigint"), lambda acc, c: acc + c["c"]
    )
    return rows.select(*labels, "le", upto.alias("bucket_count"), "sum", "count")


# --- usage and cost -------------------------------------------------------------------------


def price_column(model: Column, which: int) -> Column:
    """Price by model; NULL for models that are not listed. The table is a handful of constants."""
    out = None
    for name, prices in PRICES.items():
        out = F.when(model == name, F.lit(prices[which])) if out is None else out.when(model == name, F.lit(prices[which]))
    return out


def usage_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd`` from hit, miss and completion tokens; unknown models cost nothing.

    ``prices(model, cache_hit, cache_miss, output)`` replaces the built-in price list; it is
    broadcast only after a size check.
    """
    if prices is None:
        hit, miss, out = (price_column(F.col("model"), i) for i in range(3))
        priced = usage
    else:
        from shelfmark.functions.sizing import broadcast_if_bounded

        priced = usage.join(broadcast_if_bounded(prices), "model", "left")
        hit, miss, out = F.col("cache_hit"), F.col("cache_miss"), F.col("output")
    million = F.lit(1_000_000)
    cost = (
        F.col("cache_hit_tokens") / million * hit
        + F.col("cache_miss_tokens") / million * miss
        + F.col("completion_tokens") / million * out
    )
    return priced.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("cache_hit", "cache_miss", "output")


FULL_USAGE = (
    "struct<prompt_cache_hit_tokens:bigint,prompt_cache_miss_tokens:bigint,completion_tokens:bigint,"
    "completion_tokens_details:struct<reasoning_tokens:bigint>>"
)
SHORT_USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,input_token_details:struct<cache_read:bigint>,"
    "output_token_details:struct<reasoning:bigint,reasoning_tokens:bigint>>"
)


def usage_buckets(calls: DataFrame, full: str = "token_usage", short: str = "usage_metadata") -> DataFrame:
    """Token counts of a model call from the full record, else from the short one."""
    f, s = F.from_json(full, FULL_USAGE), F.from_json(short, SHORT_USAGE)
    has_full = F.coalesce(F.size(F.json_object_keys(full)) > 0, F.lit(False))
    p = calls.withColumns({"_f": f, "_s": s, "_has": has_full})

    def pick(a: Column, b: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.when(F.col("_has"), F.coalesce(a, zero)).otherwise(F.coalesce(b, zero))

    hit = pick(F.col("_f.prompt_cache_hit_tokens"), F.col("_s.input_token_details.cache_read"))
    unread = F.greatest(
        F.lit(0).cast("bigint"),
        F.coalesce("_s.input_tokens", F.lit(0)) - F.coalesce("_s.input_token_details.cache_read", F.lit(0)),
    )
    miss = pick(F.col("_f.prompt_cache_miss_tokens"), unread)
    done = pick(F.col("_f.completion_tokens"), F.col("_s.output_tokens"))
    thought = pick(F.col("_f.completion_tokens_details.reasoning_tokens"), F.col("_s.output_token_details.reasoning_tokens"))
    return p.withColumns(
        {"cache_hit_tokens": hit, "cache_miss_tokens": miss, "completion_tokens": done, "reasoning_tokens": thought,
         "prompt_tokens": hit + miss, "total_tokens": hit + miss + done}
    ).drop("_f", "_s", "_has")


def llm_counters(calls: DataFrame) -> DataFrame:
    """Counters by model: ``(metric, type, model, value)``; zero counters are not written."""
    per = calls.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.sum("prompt_tokens").cast("double").alias("p"), F.sum("completion_tokens").cast("double").alias("c"),
        F.sum("cost_usd").alias("usd"),
    )
    rows = F.array(
        F.struct(F.lit("llm_tokens_total").alias("metric"), F.lit("prompt").alias("type"), F.col("p").alias("value")),
        F.struct(F.lit("llm_tokens_total").alias("metric"), F.lit("completion").alias("type"), F.col("c").alias("value")),
        F.struct(F.lit("llm_cost_usd_total").alias("metric"), F.lit("").alias("type"), F.round("usd", 6).alias("value")),
    )
    return per.select("model", F.explode(rows).alias("r")).select("r.metric", "r.type", "model", "r.value").filter("value > 0")


def request_rollup(events: DataFrame) -> DataFrame:
    """One summary per request from its event rows.

    ``events(request_id, ts, event_no, kind, model, prompt_tokens, completion_tokens, cost_usd)``
    with kind start, token, usage or end. Times are milliseconds; everything combines before
    the shuffle.
    """
    def at(kind: str, pick) -> Column:
        return pick(F.when(F.col("kind") == kind, F.unix_millis(F.col("ts").cast("timestamp"))))

    start = at("start", F.min)
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    named = F.when(F.col("model").isNotNull(), F.struct("ts", "event_no"))
    return events.groupBy("request_id").agg(
        (at("token", F.min) - start).alias("ttft_ms"),
        (at("end", F.max) - start).alias("total_ms"),
        F.sum(total).alias("total_tokens"),
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("total_cost"),
        F.min_by("model", named).alias("model"),
    )


def usage_delta(log: DataFrame, counters: list[str]) -> DataFrame:
    """Per-turn usage from cumulative counters: this row less the one before in its thread."""
    packed = log.withColumn("_c", F.struct(*counters))
    back = previous(packed, ["thread_id"], minute_of(F.col("ts")), ["ts", "turn_id"], "_c", "_before")
    return back.select(
        *[c for c in log.columns if c not in counters],
        *[(F.col(c) - F.coalesce(F.col("_before")[c], F.lit(0))).alias(c) for c in counters],
    )


def budget_alarm(turns: DataFrame, limit: float = ALARM_USD) -> DataFrame:
    """Running cost per thread and whether it has reached ``limit``."""
    out = running(
        turns, ["thread_id"], minute_of(F.col("ts")), [F.col("ts"), F.col("turn_id")], {"running_cost": F.col("cost_usd")}
    )
    return out.withColumn("running_cost", F.round("running_cost", 6)).withColumn("alarm", F.col("running_cost") >= limit)


def session_usage(turns: DataFrame) -> DataFrame:
    return turns.groupBy("username", "thread_id").agg(
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("llm_calls").alias("llm_calls"), F.sum("tool_runs").alias("tool_runs"), F.count("*").alias("turns"),
    )


def usage_text(turns: DataFrame) -> DataFrame:
    """Readable cost, time, calls and tokens of each turn."""
    cost, ms = F.col("cost_usd"), F.col("latency_ms")
    return turns.select(
        "turn_id",
        F.when(cost < 0.001, "< ¥0.01").otherwise(F.concat(F.lit("≈ ¥"), fixed_text(cost * CNY_PER_USD, 2))).alias("cost"),
        F.when(ms < 1000, F.concat(fixed_text(ms, 0), F.lit(" ms"))).otherwise(F.concat(fixed_text(ms / 1000, 1), F.lit(" 秒"))).alias("elapsed"),
        F.format_string("%d 次", F.col("llm_calls")).alias("calls"),
        F.when(F.col("tool_runs") > 0, F.format_string("%d 次", F.col("tool_runs"))).otherwise("未使用").alias("tools"),
        F.format_number("total_tokens", 0).alias("tokens"),
    )


# --- stage timings ---------------------------------------------------------------------------


def stage_summary(stages: DataFrame) -> DataFrame:
    """Per stage: runs, failures, seconds and share of all seconds."""
    per = stages.groupBy("stage").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") != "success").alias("failures"), F.sum("elapsed_s").alias("_s")
    )
    total = stages.agg(F.sum("elapsed_s")).scalar()
    share = F.when(total > 0, F.col("_s") / total * 100).otherwise(0.0)
    return per.select("stage", "runs", "failures", F.round("_s", 2).alias("elapsed_s"), F.round(share, 1).alias("pct"))


def throughput(stages: DataFrame) -> DataFrame:
    """Tokens and documents per second of each record; NULL when no time passed."""
    passed = F.col("elapsed_s") > 0
    return stages.withColumns(
        {
            "tokens_per_sec": F.when(passed, F.round(F.col("token_count") / F.col("elapsed_s"), 1)),
            "docs_per_sec": F.when(passed, F.round(F.col("doc_count") / F.col("elapsed_s"), 3)),
        }
    )


def parallel_ratio(tasks: DataFrame) -> DataFrame:
    """Summed task seconds over wall seconds of each run."""
    wall = (F.max("ended_us") - F.min("started_us")) / 1_000_000
    per = tasks.groupBy("run_id").agg(F.sum("elapsed_s").alias("_cpu"), wall.alias("_wall"))
    ratio = F.when(F.col("_wall") > 0, F.round(F.col("_cpu") / F.col("_wall"), 2)).otherwise(0.0)
    return per.select("run_id", ratio.alias("parallel_ratio"))
