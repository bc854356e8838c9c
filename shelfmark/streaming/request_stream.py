"""Streaming forms of the request-log operators.

Event time and watermarks are needed here: rows later than the watermark are dropped from
the windowed aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.functions.session import work_dir
from shelfmark.operators import requests as rq
from shelfmark.operators.ingest import upsert
from shelfmark.streaming.runner import collect_batches, late_rows, latest, rocksdb_state, run

# A request is over after this many seconds without an event.
REQUEST_TIMEOUT = "120 seconds"
LATENESS = "2 minutes"


def window_counts(requests: DataFrame, limit: int, window: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Requests and rejections per bucket and fixed window; state of a window goes when it is past."""
    counted = requests.withWatermark("ts", lateness).groupBy("bucket", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("n")
    )
    emitted = collect_batches(
        counted.select("bucket", F.unix_seconds("w.start").alias("window_start"), "n"), "update"
    )
    return latest(emitted, ["bucket", "window_start"]).withColumn("rejected", F.greatest(F.lit(0), F.col("n") - limit))


def window_counts_and_late(requests: DataFrame, window: str = "1 minute", lateness: str = LATENESS) -> tuple[DataFrame, int]:
    """Requests per bucket and fixed window ``(bucket, window_start, n)``, and how many rows came too late to be counted.

    The stream observes the rows that come; what no window has counted is late. With rows turned away the operator's own
    report must not be zero, and the other way round.
    """
    came = requests.observe("came", F.count(F.lit(1)).alias("rows"))
    counted = came.withWatermark("ts", lateness).groupBy("bucket", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    with late_rows(requests.sparkSession) as report:
        emitted = collect_batches(counted.select("bucket", F.unix_seconds("w.start").alias("window_start"), "n"), "update")
        report.wait()
    final = latest(emitted, ["bucket", "window_start"])
    late = report.came - (final.agg(F.sum("n")).first()[0] or 0)
    if (late > 0) != (report.dropped > 0):
        raise RuntimeError(f"{late} rows are missing, the stream turned {report.dropped} away")
    return final, late


def sessions(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Sessions per user closed by silence, with what they used; emitted once the watermark passed."""
    spans = requests.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", REQUEST_TIMEOUT).alias("s"))
    closed = spans.agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"))
    return collect_batches(
        closed.select("user_id", F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "events", "tokens"),
        "append",
    ).drop("batch")


def counters(requests: DataFrame, routes: list[str]) -> DataFrame:
    """Running request counters by method, route and status; one state row per label set."""
    emitted = collect_batches(rq.http_counters(requests, routes), "update")
    return latest(emitted, ["method", "template", "status"])


def latency_counts(requests: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Histogram cells (not cumulated) kept by the stream; cumulated when read."""
    cells = requests.groupBy(*labels, rq.bound_index(F.col(value), bounds).alias("i")).agg(
        F.count("*").alias("c"), F.sum(value).alias("s")
    )
    final = latest(collect_batches(cells, "update"), [*labels, "i"])
    return rq.cumulate(final, labels, bounds)


def admission(
    requests: DataFrame, limit: int, budget: int, seconds: int = rq.WINDOW_SECONDS, state_days: int = 2
) -> DataFrame:
    """Verdict for every streamed request: rate limit, then daily budget.

    Each micro-batch is judged with the batch operators plus the counters of earlier
    batches, so a hot bucket is spread over tasks there too. Counters are small tables
    named by batch: batch ``b`` reads those of ``b - 1`` and rewrites only its own, which
    makes a repeated batch harmless. Counters older than ``state_days`` are left behind.
    Requests must arrive in batch order, as they do at a gateway.
    """
    spark = requests.sparkSession
    root = work_dir(spark, "admission")

    def judge(batch: DataFrame, no: int) -> None:
        session = batch.sparkSession
        counts = tokens = None
        if no:
            counts = session.read.parquet(f"{root}/rpm/{no - 1}")
            tokens = session.read.parquet(f"{root}/day/{no - 1}")
        limited = rq.rate_limit(batch, limit, seconds, counts)
        verdicts = rq.token_budget(limited, budget, tokens)
        verdicts.write.mode("overwrite").parquet(f"{root}/out/batch={no}")
        done = session.read.parquet(f"{root}/out/batch={no}")
        newest = done.agg(F.max("day")).scalar()
        new_counts = done.groupBy("bucket", "window_start").agg(F.max("n").alias("carried_n"))
        charged = F.when(F.col("reason").isNotNull(), 0).otherwise(F.col("tokens")).cast("bigint")
        used = done.groupBy("bucket", "day").agg(F.sum(charged).alias("carried_tokens"))
        if no:
            new_counts = upsert(counts, new_counts.withColumn("seq", F.lit(no)), ["bucket", "window_start"], "seq")
            used = tokens.unionByName(used).groupBy("bucket", "day").agg(F.sum("carried_tokens").alias("carried_tokens"))
        day_of = F.to_date(F.timestamp_seconds("window_start"))
        keep_from = F.date_sub(F.coalesce(newest, F.lit("1970-01-01").cast("date")), state_days)
        new_counts.filter(day_of >= keep_from).write.mode("overwrite").parquet(f"{root}/rpm/{no}")
        used.filter(F.col("day") >= keep_from).write.mode("overwrite").parquet(f"{root}/day/{no}")

    run(requests, judge)
    return spark.read.parquet(f"{root}/out")


class WindowCounter(StatefulProcessor):
    """Numbers the requests of one (bucket, window); the counter goes when the window is past."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        if not n:
            self.handle.registerTimer((key[1] + self.seconds) * 1000)
        # one window of one bucket within one micro-batch
        part = pd.concat(list(rows)).sort_values(["ts", "request_id"], ignore_index=True)
        part["n"] = part.index + n + 1
        part["rejected"] = part["n"] > self.limit
        n += len(part)
        yield part[["request_id", "bucket", "window_start", "n", "rejected"]]
        self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def window_admission(requests: DataFrame, limit: int, seconds: int = rq.WINDOW_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Per-request rate-limit verdicts kept as keyed operator state instead of tables.

    Keys are (bucket, window), so one key sees at most one window of one bucket.
    """
    keyed = requests.withWatermark("ts", lateness).withColumn("window_start", rq.window_start(F.col("ts"), seconds))
    verdicts = keyed.groupBy("bucket", "window_start").transformWithStateInPandas(
        statefulProcessor=WindowCounter(limit, seconds),
        outputStructType="request_id long, bucket string, window_start long, n long, rejected boolean",
        outputMode="Append", timeMode="EventTime",
    )
    with rocksdb_state(requests.sparkSession):
        return collect_batches(verdicts, "append").drop("batch")
