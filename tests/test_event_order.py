"""Stateful streams against plain loops: rows out of order, rows too late, endings, expiries."""

import datetime
import random

import pytest

from shelfmark.functions.session import work_dir
from shelfmark.streaming import event_order as eo
from shelfmark.streaming import request_stream as rs
from shelfmark.streaming.runner import arrivals

START = datetime.datetime(2024, 5, 1, 23, 50)
END = datetime.datetime(2024, 6, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def us(seconds):
    return int((at(seconds) - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def stream(spark, parts, schema):
    return arrivals([spark.createDataFrame(p, schema) for p in parts], work_dir(spark, "arrivals"))


def out_of_order(rows, seed, second=1, spread=100, parts=3):
    """``rows`` dealt to files by event time plus a delay below the watermark's lateness."""
    rng = random.Random(seed)
    last = max((r[second] - START).total_seconds() for r in rows)
    dealt = [[] for _ in range(parts)]
    for r in rows:
        when = (r[second] - START).total_seconds() + rng.uniform(0, spread)
        dealt[min(parts - 1, int(when / (last + 1) * parts))].append(r)
    for d in dealt:
        rng.shuffle(d)
    return [d for d in dealt if d]


def test_admission_follows_event_time(spark):
    rng = random.Random(1)
    rows = [(i, at(rng.randrange(0, 1500) + i / 1000), rng.choice(["hot", "hot", "b"]), rng.randrange(0, 30)) for i in range(300)]
    got = eo.admission_in_order(stream(spark, [*out_of_order(rows, 2), [(-1, END, "x", 0)]], "request_id long, ts timestamp, bucket string, tokens long"), 8, 250, 60).collect()
    want, count, used = set(), {}, {}
    for i, ts, bucket, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        minute, day = (bucket, ts.replace(second=0, microsecond=0)), (bucket, ts.date())
        count[minute] = count.get(minute, 0) + 1
        before, rejected = used.get(day, 0), count[minute] > 8
        reason = "rpm" if rejected else "budget" if before >= 250 else None
        if reason is None:
            used[day] = before + tokens
        want.add((i, bucket, count[minute], rejected, before, reason))
    assert {tuple(r) for r in got} == want and len(got) == 300
    assert {r[5] for r in want} == {"rpm", "budget", None}


def test_requests_end_once_whatever_ends_them(spark):
    rows = [
        (1, at(0), "start", 0), (1, at(10), "token", 5), (1, at(20), "done", 1), (1, at(30), "token", 100), (1, at(25), "done", 0),
        (2, at(5), "start", 0), (2, at(6), "token", 7), (2, at(50), "disconnect", 0),
        (3, at(7), "start", 0), (3, at(100), "token", 3), (3, at(127), "token", 4), (3, at(128), "token", 100), (3, at(200), "done", 0),
        (4, at(300), "start", 2), (5, at(310), "error", 9), (5, at(320), "token", 1),
    ]
    parts = [*out_of_order(rows, 3), [(-1, END, "start", 0)]]
    got = eo.request_endings(stream(spark, parts, "request_id long, ts timestamp, kind string, tokens long"), shares=2).collect()
    assert {tuple(r) for r in got} == {
        (1, "done", us(0), us(20), 3, 6), (2, "disconnect", us(5), us(50), 3, 7), (3, "timeout", us(7), us(127), 3, 7),
        (4, "timeout", us(300), us(420), 1, 2), (5, "error", us(310), us(310), 1, 9),
    }
    assert len(got) == 5


def test_cache_entries_expire_and_newer_ones_replace(spark):
    rows = [
        (1, at(0), "admit", "q", at(100)), (2, at(50), "probe", "q", None), (3, at(100), "probe", "q", None), (4, at(150), "probe", "q", None),
        (5, at(160), "admit", "q", at(900)), (6, at(170), "admit", "q", at(180)), (7, at(175), "probe", "q", None), (8, at(190), "probe", "q", None),
        (9, at(10), "probe", "never", None), (10, at(400), "admit", "late", at(500)), (11, at(400), "probe", "late", None),
    ]
    parts = [*out_of_order(rows, 5), [(-1, END, "admit", "tick", END)]]
    got = eo.cache_answers(stream(spark, parts, "id long, ts timestamp, kind string, query_hash string, expires_at timestamp"), shares=2).collect()
    assert {r.query_id: r.entry_id for r in got} == {2: 1, 3: None, 4: None, 7: 6, 8: None, 9: None, 11: 10}


@pytest.mark.parametrize("late", [0, 5])
def test_late_rows_are_reported(spark, late):
    rows = [(i, at(i * 10), "b") for i in range(60)]
    parts = [rows[:40], rows[40:], [(100 + i, at(i), "b") for i in range(late)] + [(200, at(595), "b")]]
    counts, dropped = rs.window_counts_and_late(stream(spark, parts, "request_id long, ts timestamp, bucket string"))
    assert dropped == late and sum(r.n for r in counts.collect()) == 61


def test_many_rows_wait_in_small_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, at(i % 3000 + d), kind, i % 5) for i in range(400) for d, kind in ((0, "start"), (rng.randrange(1, 140), "token"), (rng.randrange(1, 200), "done"))]
    parts = [*out_of_order(rows, 9, parts=4), [(-1, END, "start", 0)]]
    schema = "request_id long, ts timestamp, kind string, tokens long"
    whole = eo.request_endings(stream(spark, parts, schema), shares=1).collect()
    packed = eo._pack
    sizes = []
    processor = eo.Lifecycle()
    processor.schema, processor.waiting, processor.numbers = eo._schema(processor.row), Entries(), Value()
    monkeypatch.setattr(eo, "PIECE", 7)
    monkeypatch.setattr(eo, "_pack", lambda table: sizes.append(len(table)) or packed(table))
    table = eo.pa.Table.from_pylist([{"us": us(i * 37 % 100), "request_id": i, "kind": "token", "tokens": i} for i in range(100)], processor.schema)
    assert processor._keep(table) == us(0) and max(sizes) == 7 and sum(sizes) == 100
    due, rest = processor._due(us(40))
    assert due.column("us").to_pylist() == [us(i) for i in range(40)] and rest == us(40)
    assert processor._due(us(1000))[0].column("us").to_pylist() == [us(i) for i in range(40, 100)] and not processor.waiting.held
    assert len(whole) == 400 and sum(r.frames for r in whole) <= 1200
    for r in whole:
        mine = sorted((t, k, n) for i, t, k, n in rows if i == r.request_id)
        ends = [t for t, k, _ in mine if k == "done" and (t - mine[0][0]).total_seconds() <= 120]
        assert r.outcome == ("done" if ends else "timeout")


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Entries:
    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]
