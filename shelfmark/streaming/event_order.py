"""Operators that must see the rows of a key in the order of their event times, whatever order files arrive in.

Each keeps rows back until the watermark has passed them, then works through them in order: by then no earlier row can
come, as Spark drops rows behind the watermark. State is keyed and lives in the state store; event-time timers wake a key
when its oldest row, or a deadline of its own, is due, so nothing waits for the key's next row and nothing stays for ever.
Rows wait as packed Arrow pieces of bounded size, a state entry each; a timer opens only pieces that hold rows that are due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.streaming.runner import collect_batches, rocksdb_state

MICROS = 1_000_000
DAY = 86_400
# Seconds after which a request that has not ended is over, and how it may end before that.
DEADLINE = 120
ENDINGS = ("done", "disconnect", "error")
#: Rows that are packed into one state entry, and rows that are turned into Python objects at a time.
PIECE = 50_000
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(packed)).read_all()


def _slices(table: pa.Table) -> Iterator[pa.Table]:
    for start in range(0, len(table), PIECE):
        yield table.slice(start, PIECE)


def _tuples(table: pa.Table) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in table.column_names))


class InEventOrder(StatefulProcessor):
    """Hands the rows of a key to ``judge`` in order. ``row`` is their DDL: ``us`` first, then what breaks ties."""

    row = ""
    output = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "no long", "first_us long, last_us long, rows binary")
        self.numbers = handle.getValueState("numbers", "next long")
        self.alarm = handle.getValueState("alarm", "at long")
        self.schema = _schema(self.row)
        self.out = _schema(self.output).names

    def judge(self, key: tuple, rows: pa.Table, watermark_us: int) -> tuple[list[pd.DataFrame], int | None]:
        """Output rows for the sorted ``rows``, and the time (us) at which to be called even without rows."""
        raise NotImplementedError

    def _keep(self, table: pa.Table) -> int | None:
        """Put rows into the state; their first time."""
        if not len(table):
            return None
        table = table.sort_by("us")
        no = self.numbers.get()[0] if self.numbers.exists() else 0
        for piece in _slices(table):
            us = piece.column("us")
            self.waiting.updateValue((no,), (us[0].as_py(), us[-1].as_py(), _pack(piece.combine_chunks())))
            no += 1
        self.numbers.update((no,))
        return table.column("us")[0].as_py()

    def _due(self, watermark_us: int) -> tuple[pa.Table, int | None]:
        """Take the rows before the watermark out of the state, in order; and the first time of those that stay."""
        due, rest, taken, times = [], [], [], []
        for (no,), (first, last, packed) in self.waiting.iterator() if self.waiting.exists() else []:
            if first >= watermark_us:
                times.append(first)
                continue
            taken.append(no)
            table = _unpack(packed)
            at = len(table) if last < watermark_us else int(np.searchsorted(table.column("us").to_numpy(), watermark_us))
            due.append(table.slice(0, at))
            rest.append(table.slice(at))
        for no in taken:
            self.waiting.removeKey((no,))
        if rest and (first := self._keep(pa.concat_tables(rest))) is not None:
            times.append(first)
        if not times:
            self.numbers.clear()
        rows = pa.concat_tables(due) if due else self.schema.empty_table()
        return rows.sort_by([(c, "ascending") for c in self.schema.names]), min(times, default=None)

    def _wake(self, us: int) -> None:
        at = us // 1000 + 1
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, size, firsts = [], 0, []
        for part in rows:
            parts.append(pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False))
            size += len(part)
            if size >= PIECE:
                firsts.append(self._keep(pa.concat_tables(parts)))
                parts, size = [], 0
        if size:
            firsts.append(self._keep(pa.concat_tables(parts)))
        self._wake(min(firsts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = self._due(watermark)
        found, call = self.judge(key, due, watermark)
        self.alarm.clear()  # the timer that rang is gone
        times = [t for t in (rest, call) if t is not None]
        if times:
            self._wake(max(min(times), watermark))
        yield from found

    def close(self) -> None:
        pass


class Admission(InEventOrder):
    """Rate limit, then post-paid daily budget, with both counters of a bucket as state."""

    row = "us long, request_id long, tokens long"
    output = "request_id long, bucket string, n long, rejected boolean, used_before long, reason string"

    def __init__(self, limit: int, budget: int, seconds: int):
        self.limit, self.budget, self.seconds = limit, budget, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start long, n long")
        self.day = handle.getValueState("day", "day long, used long")

    def judge(self, key, rows, watermark_us):
        start, n = self.window.get() if self.window.exists() else (None, 0)
        day, used = self.day.get() if self.day.exists() else (None, 0)
        found = []
        for part in _slices(rows):
            out = []
            for us, request, tokens in _tuples(part):
                second = us // MICROS
                if second - second % self.seconds != start:
                    start, n = second - second % self.seconds, 0
                if second // DAY != day:
                    day, used = second // DAY, 0
                n += 1
                before, rejected = used, n > self.limit
                reason = "rpm" if rejected else "budget" if before >= self.budget else None
                if reason is None:
                    used += tokens
                out.append((request, key[0], n, rejected, before, reason))
            found.append(pd.DataFrame(out, columns=self.out))
        # counters whose window or day the watermark has left are of no use to any row that can still come
        ends = []
        for state, value, end in ((self.window, (start, n), None if start is None else start + self.seconds), (self.day, (day, used), None if day is None else (day + 1) * DAY)):
            if end is None or end * MICROS <= watermark_us:
                state.clear()
            else:
                state.update(value)
                ends.append(end * MICROS)
        return found, min(ends, default=None)


class Lifecycle(InEventOrder):
    """Requests from their first frame to done, disconnect, error or the deadline, whichever comes first.

    Keyed by a share of the request ids. A request that ended is remembered for another deadline, so that its stray
    frames begin no new one.
    """

    row = "us long, request_id long, kind string, tokens long"
    output = "request_id long, outcome string, start_us long, end_us long, frames long, tokens long"
    known = "request_id long, start long, frames long, tokens long, ended boolean"

    def __init__(self, deadline: int = DEADLINE):
        self.deadline = deadline * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "rows binary")

    def judge(self, key, rows, watermark_us):
        known = _unpack(self.open.get()[0]) if self.open.exists() else _schema(self.known).empty_table()
        us, kind = rows.column("us").to_numpy(), rows.column("kind")
        names, at = np.unique(np.concatenate([known.column("request_id").to_numpy(), rows.column("request_id").to_numpy()]), return_inverse=True)
        old, at = at[: len(known)], at[len(known) :]
        start, over = np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names), bool)
        frames, tokens = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.minimum.at(start, at, us)
        start[old], over[old] = known.column("start").to_numpy(), known.column("ended").to_numpy()
        frames[old], tokens[old] = known.column("frames").to_numpy(), known.column("tokens").to_numpy()
        limit = start + self.deadline
        # the first ending frame in time; frames behind it count no more
        place, timely = np.arange(len(us)), ~over[at] & (us <= limit[at])
        ending = timely & pc.is_in(kind, pa.array(ENDINGS)).to_numpy()
        end = np.full(len(names), len(us))
        np.minimum.at(end, at[ending], place[ending])
        counted = timely & (place <= end[at])
        np.add.at(frames, at[counted], 1)
        np.add.at(tokens, at[counted], pc.fill_null(rows.column("tokens"), 0).to_numpy()[counted])
        by_frame = end < len(us)
        timeout = ~over & ~by_frame & (limit < watermark_us)
        found = []
        for which, outcome, when in ((by_frame, kind.take(pa.array(end[by_frame])).to_pylist(), us[end[by_frame]]), (timeout, "timeout", limit[timeout])):
            if which.any():
                found.append(pd.DataFrame({
                    "request_id": names[which], "outcome": outcome, "start_us": start[which], "end_us": when, "frames": frames[which], "tokens": tokens[which],
                }))
        over = over | by_frame | timeout
        kept = start + 2 * self.deadline >= watermark_us
        if not kept.any():
            self.open.clear()
            return found, None
        columns = [pa.array(c[kept]) for c in (names, start, frames, tokens, over)]
        self.open.update((_pack(pa.Table.from_arrays(columns, schema=_schema(self.known))),))
        return found, int((start + np.where(over, 2, 1) * self.deadline)[kept].min())


class ExpiringCache(InEventOrder):
    """Admissions and probes of a result cache, keyed by a share of the query hashes; entries go at their expiry."""

    row = "us long, kind string, id long, query_hash string, expires_us long"
    output = "query_id long, query_hash string, entry_id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "query_hash string", "entry_id long, expires_us long")

    def judge(self, key, rows, watermark_us):
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        entries, found = dict(stored), []
        for part in _slices(rows):
            out = []
            for us, kind, ident, query, expires in _tuples(part):  # at one instant an admission comes before a probe
                if kind == "admit":
                    entries[query] = ident, expires
                else:
                    entry = entries.get(query)
                    out.append((ident, query, entry[0] if entry and entry[1] > us else None))
            if out:
                found.append(pd.DataFrame(out, columns=self.out))
        soonest = None
        for query, entry in entries.items():
            if entry[1] <= watermark_us:
                if query in stored:
                    self.entries.removeKey((query,))
                continue
            if stored.get(query) != entry:
                self.entries.updateValue((query,), entry)
            soonest = entry[1] if soonest is None else min(soonest, entry[1])
        return found, soonest


def _run(stream: DataFrame, key: str, processor: InEventOrder, lateness: str) -> DataFrame:
    keyed = stream.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    judged = keyed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime"
    )
    with rocksdb_state(stream.sparkSession):
        return collect_batches(judged, "append").drop("batch")


def admission_in_order(requests: DataFrame, limit: int, budget: int, seconds: int, lateness: str = "2 minutes") -> DataFrame:
    """Verdict on every request ``(request_id, ts, bucket, tokens)`` that the watermark has passed, in event order.

    A bucket is one key, as its budget depends on every earlier verdict; ``request_stream.admission`` spreads a bucket over
    tasks, for requests that arrive in order.
    """
    return _run(requests, "bucket", Admission(limit, budget, seconds), lateness)


def request_endings(frames: DataFrame, shares: int = 64, deadline: int = DEADLINE, lateness: str = "2 minutes") -> DataFrame:
    """How each request of ``frames(request_id, ts, kind, tokens)`` ended, and what it is charged.

    ``request_id, outcome, start_us, end_us, frames, tokens``: tokens of all frames up to the end are charged, however it
    ended; frames after the end are ignored. Emitted when the watermark has passed the end.
    """
    keyed = frames.withColumn("share", F.pmod(F.xxhash64("request_id"), F.lit(shares)).cast("int"))
    return _run(keyed, "share", Lifecycle(deadline), lateness)


def cache_answers(events: DataFrame, shares: int = 64, lateness: str = "2 minutes") -> DataFrame:
    """``query_id, query_hash, entry_id`` (NULL: a miss) of every probe among ``events(id, ts, kind, query_hash, expires_at)``.

    ``kind`` is ``admit`` or ``probe``. The newest admission of a hash answers until it expires.
    """
    keyed = events.withColumns(
        {"expires_us": F.coalesce(F.unix_micros("expires_at"), F.lit(0).cast("bigint")), "share": F.pmod(F.xxhash64("query_hash"), F.lit(shares)).cast("int")}
    )
    return _run(keyed, "share", ExpiringCache(), lateness)
