"""Limits, budgets, routes, roll-ups and cost: the boundary cases of the request API."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import requests as rq

T0 = datetime(2024, 5, 1, 10, 0, 5)


def reqs(spark, rows):
    data = [(i, T0 + timedelta(seconds=s), b, t) for i, (s, b, t) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, ts timestamp_ntz, bucket string, tokens long")


def test_fourth_request_of_a_minute_is_rejected(spark):
    out = rq.rate_limit(reqs(spark, [(0, "k", 0), (1, "k", 0), (2, "k", 0), (3, "k", 0), (60, "k", 0)]), 3)
    rows = out.orderBy("request_id").collect()
    assert [r.rejected for r in rows] == [False, False, False, True, False]
    assert 1 <= rows[3].retry_after <= 61 and rows[0].retry_after is None


def test_buckets_do_not_share_a_limit(spark):
    out = rq.rate_limit(reqs(spark, [(0, "client:10.0.0.1", 0), (1, "client:10.0.0.2", 0)]), 1)
    assert not any(r.rejected for r in out.collect())


def test_budget_is_charged_after_the_request(spark):
    out = rq.token_budget(rq.rate_limit(reqs(spark, [(0, "k", 350), (1, "k", 350), (86400, "k", 350)]), 10), 1)
    assert [r.reason for r in out.orderBy("request_id").collect()] == [None, "budget", None]


def test_rejected_requests_are_not_charged(spark):
    rows = [(0, "k", 60), (1, "k", 500), (60, "k", 30), (120, "k", 30), (180, "k", 5)]
    out = rq.token_budget(rq.rate_limit(reqs(spark, rows), 1), 100).orderBy("request_id").collect()
    assert [(r.reason, r.used_before) for r in out] == [(None, 0), ("rpm", 60), (None, 60), (None, 90), ("budget", 120)]


def test_bucket_key(spark):
    rows = [("secret", "1.1.1.1", "9.9.9.9"), ("", " 192.168.1.100 , 10.0.0.1", "9.9.9.9"), (None, "", "9.9.9.9"), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, x string, p string")
    key = rq.bucket_key(F.col("k"), F.col("x"), F.col("p"))
    assert [r[0] for r in df.select(key).collect()] == ["secret", "client:192.168.1.100", "client:9.9.9.9", "client:unknown"]
    short = rq.bucket_key(F.col("k"), F.col("x"), F.col("p"), prefix_len=16)
    assert df.select(short).collect()[1][0] == "client:192.168.1"


def test_foreign_threads_are_empty(spark):
    threads = spark.createDataFrame([("user:key-owner-A:test-session-abc", "hi")], "thread_id string, text string")
    asked = spark.createDataFrame([("key-owner-A", "test-session-abc"), ("key-outsider-B", "test-session-abc")], "bucket string, session_id string")
    assert [r.bucket for r in rq.own_history(asked, threads).collect()] == ["key-owner-A"]


def test_routes(spark):
    routes = ["/api/v1/chat/stream", "/api/v1/sessions/{id}/history"]
    df = spark.createDataFrame([("/api/v1/chat/stream",), ("/api/v1/sessions/a.b/history",), ("/api/v1/sessions/a/b/history",), ("/x",)], "p string")
    got = [r[0] for r in df.select(rq.route_template(F.col("p"), routes)).collect()]
    assert got == [routes[0], routes[1], "unmatched", "unmatched"]


def test_scrapes_do_not_count_and_missing_status_is_zero(spark):
    df = spark.createDataFrame([("GET", rq.METRICS_PATH, 200), ("GET", "/a", None)], "method string, path string, status int")
    assert [tuple(r) for r in rq.http_counters(df, ["/a"]).collect()] == [("GET", "/a", "0", 1)]


def test_histogram_is_cumulative_with_closed_bounds(spark):
    df = spark.createDataFrame([("m", 0.1), ("m", 0.2), ("m", 500.0)], "m string, v double")
    got = {r.le: r.bucket_count for r in rq.latency_hist(df, ["m"], "v", rq.LATENCY_BOUNDS).collect()}
    assert (got["0.1"], got["0.25"], got["120.0"], got["+Inf"]) == (1, 2, 2, 3) and len(got) == 13


def test_one_request_script(spark):
    """Two text frames, a tool call, and one model call of 100 hit, 200 miss and 50 completion tokens."""
    usage = spark.createDataFrame(
        [("deepseek-v4-flash", '{"prompt_cache_hit_tokens": 100, "prompt_cache_miss_tokens": 200, "completion_tokens": 50}', None)],
        "model string, token_usage string, usage_metadata string",
    )
    call = rq.usage_cost(rq.usage_buckets(usage)).first()
    assert (call.prompt_tokens, call.total_tokens) == (300, 350) and call.cost_usd == pytest.approx(4.228e-5)
    ms = lambda n: T0 + timedelta(milliseconds=n)
    events = [
        (1, ms(0), 0, "start", None, None, None, None), (1, ms(120), 1, "token", None, None, None, None),
        (1, ms(150), 2, "token", None, None, None, None), (1, ms(300), 3, "usage", "deepseek-v4-flash", 300, 50, call.cost_usd),
        (1, ms(310), 4, "end", None, None, None, None), (2, ms(0), 0, "start", None, None, None, None),
    ]
    schema = "request_id long, ts timestamp_ntz, event_no int, kind string, model string, prompt_tokens long, completion_tokens long, cost_usd double"
    rows = {r.request_id: r for r in rq.request_rollup(spark.createDataFrame(events, schema)).collect()}
    r = rows[1]
    assert (r.ttft_ms, r.total_ms, r.total_tokens, r.total_cost, r.model) == (120, 310, 350, 0.000042, "deepseek-v4-flash")
    assert (rows[2].ttft_ms, rows[2].total_ms, rows[2].total_tokens) == (None, None, 0)


def test_short_usage_record(spark):
    df = spark.createDataFrame(
        [("m", "{}", '{"input_tokens": 10, "output_tokens": 4, "input_token_details": {"cache_read": 15}}'), ("m", None, None)],
        "model string, token_usage string, usage_metadata string",
    )
    a, b = rq.usage_buckets(df).collect()
    assert (a.cache_hit_tokens, a.cache_miss_tokens, a.completion_tokens, a.total_tokens) == (15, 0, 4, 19)
    assert b.total_tokens == 0


def test_unknown_model_costs_nothing_and_prices_can_be_a_table(spark):
    df = spark.createDataFrame([("x", 1000000, 0, 0)], "model string, cache_hit_tokens long, cache_miss_tokens long, completion_tokens long")
    assert rq.usage_cost(df).first().cost_usd == 0.0
    prices = spark.createDataFrame([("x", 2.0, 0.0, 0.0)], "model string, cache_hit double, cache_miss double, output double")
    assert rq.usage_cost(df, prices).first().cost_usd == 2.0


def test_inflight_falls_back_to_zero(spark):
    rows = [(1, T0, T0 + timedelta(seconds=90)), (2, T0 + timedelta(seconds=30), T0 + timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, ended_at timestamp_ntz")
    assert [r.in_flight for r in rq.inflight(df).orderBy("ts").collect()] == [1, 2, 1, 0]


def test_deltas_and_alarm(spark):
    rows = [("t", 1, T0, 10, 0.6), ("t", 2, T0 + timedelta(minutes=5), 25, 0.4), ("u", 3, T0, 7, 0.1)]
    df = spark.createDataFrame(rows, "thread_id string, turn_id long, ts timestamp_ntz, total_tokens long, cost_usd double")
    assert [r.total_tokens for r in rq.usage_delta(df, ["total_tokens"]).orderBy("turn_id").collect()] == [10, 15, 7]
    assert [r.alarm for r in rq.budget_alarm(df).orderBy("turn_id").collect()] == [False, True, False]


def test_stage_numbers(spark):
    df = spark.createDataFrame([("a", "success", 3.0, 30, 6), ("a", "failed: X", 1.0, 1, 1), ("b", "success", 0.0, 1, 1)], "stage string, status string, elapsed_s double, token_count long, doc_count long")
    got = {r.stage: (r.runs, r.failures, r.pct) for r in rq.stage_summary(df).collect()}
    assert got == {"a": (2, 1, 100.0), "b": (1, 0, 0.0)}
    assert [r.tokens_per_sec for r in rq.throughput(df).collect()] == [10.0, 1.0, None]
