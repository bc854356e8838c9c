"""Conversation structure repair: a run-length dynamic program over roles and faults.

A repaired conversation reads ``(s?(ua)+)?`` by role initials: an optional system row, then user and assistant in turn.
Four states follow that pattern; a row with its faults is one of nine symbols, and consuming a symbol (with rows written
before it where that pays) is a min-plus matrix over the states.

* Rows of a conversation are sorted over the whole cluster (ranges of the full row, so a long conversation spans tasks)
  and cut into segments of ``2**SEGMENT`` sorted rows. Equal rows are one row with a number.
* In a segment equal consecutive symbols are one run; a run is advanced by binary powers of its symbol's matrix, which are
  kept per process. The matrices of the segments of a conversation are combined from its end.
* A second pass unrolls the choices: halves of a run down to single rows, kept by power, state and remaining cost, for each
  of the four states in which a segment can begin; the segments are then strung together.

Only numbers and audits (one letter a row) of one conversation meet in a task; texts never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.windows import join_back

SEGMENT = 12  # rows of a segment as a power of two
STATES = range(4)
FAR = 1 << 40
BLANK, OTHER, TRUNCATED = 0, 4, 4
#: Symbols: 0 must go; 1 to 4 initial s, u, a, any other; 5 to 8 the same, cut off.
INITIALS = {1: "s", 2: "u", 3: "a"}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The row that may be written in a state, and the state behind it.
WRITE = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]
#: Least cost from a state to a complete conversation.
FINISH = (0, 4, 2, 0)


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` of the ways to consume one row, by letter."""
    ways = [("D", 3, state)]
    if symbol != BLANK:
        cut = int(symbol > OTHER)
        after = KEEP.get(INITIALS.get(symbol - TRUNCATED * cut, ""), {}).get(state)
        if after is not None:
            ways.append(("K", cut, after))
        ways.append(("R", 2 + cut, WRITE[state][0]))
    return ways


def _times(matrix: tuple, costs: tuple) -> tuple:
    return tuple(min(row[s] + costs[s] for s in STATES) for row in matrix)


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(FAR, min(row[m] + b[m][s] for m in STATES)) for s in STATES) for row in a)


@lru_cache(None)
def power(symbol: int, k: int) -> tuple:
    """Least costs from state to state over ``2**k`` rows of one symbol, rows written before each included."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    rows = []
    for state in STATES:
        row, paid = [FAR] * 4, 0
        for _ in range(3):  # at most two rows are worth writing before one is consumed
            for _, cost, after in choices(symbol, state):
                row[after] = min(row[after], paid + cost)
            state, paid = WRITE[state][0], paid + 2
        rows.append(tuple(row))
    return tuple(rows)


def _powers(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def before_run(symbol: int, n: int, costs: tuple) -> tuple:
    """Least costs to the end from before a run of ``n`` rows, given those from behind it."""
    for k in _powers(n):
        costs = _times(power(symbol, k), costs)
    return costs


@lru_cache(1 << 14)
def _unroll(symbol: int, k: int, state: int, costs: tuple) -> tuple[str, int]:
    """The least letters, among the cheapest ways, over ``2**k`` rows, and the state behind them."""
    if k:
        first, state = _unroll(symbol, k - 1, state, _level(_times(power(symbol, k - 1), costs)))
        second, state = _unroll(symbol, k - 1, state, costs)
        return first + second, state
    here, letters = _times(power(symbol, 0), costs), ""
    while True:
        ways = [(letter, cost + costs[after], after) for letter, cost, after in choices(symbol, state)]
        after = WRITE[state][0]
        letter, _, after = min(w for w in [*ways, ("I", 2 + here[after], after)] if w[1] == here[state])
        letters, state = letters + letter, after
        if letter != "I":
            return letters, state


def _level(costs: tuple) -> tuple:
    """Costs over the least of them: the choices are the same."""
    low = min(costs)
    return tuple(c - low for c in costs)


def unroll_run(symbol: int, n: int, state: int, costs: tuple) -> tuple[str, int]:
    behind = []  # the parts of the run from its end, each with the costs behind it
    for k in _powers(n):
        behind.append((k, _level(costs)))
        costs = _times(power(symbol, k), costs)
    parts = []
    for k, after in reversed(behind):
        part, state = _unroll(symbol, k, state, after)
        parts.append(part)
    return "".join(parts), state


def runs_of(rows: list[dict]) -> list[tuple[int, int]]:
    """Symbols and lengths of the runs of a segment; of ``m`` equal rows all but the first must go."""
    symbols = [x for r in rows for x in ((r["symbol"], 1), (BLANK, r["m"] - 1)) if x[1]]
    return [(s, sum(n for _, n in run)) for s, run in groupby(symbols, key=lambda x: x[0])]


_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's matrix, its first and last initial and its illegal neighbours."""
    for batch in batches:
        matrices, ends = [], []
        for rows in batch.column("rows").to_pylist():
            matrix = tuple(tuple(0 if a == b else FAR for b in STATES) for a in STATES)
            for symbol, n in runs_of(rows):
                for k in _powers(n):
                    matrix = _product(matrix, power(symbol, k))
            illegal = sum(r["m"] - 1 for r in rows) + sum((a["initial"], b["initial"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
            matrices.append([c for row in matrix for c in row])
            ends.append((rows[0]["initial"], rows[-1]["initial"], illegal))
        first, last, illegal = (pa.array([e[x] for e in ends], pa.int64()) for x in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column("head"), batch.column("conv"), pa.array(matrices, pa.list_(pa.int64())), first, last, illegal],
            ["head", "conv", "matrix", "first", "last", "illegal"],
        )


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its cost, its illegal neighbours, and the costs behind each of its segments."""
    for batch in batches:
        out = []
        for segments in batch.column("segments").to_pylist():
            costs, behind = FINISH, []
            for s in reversed(segments):
                behind.append({"head": s["head"], "costs": list(costs), "ends": s is segments[-1]})
                costs = _times(tuple(tuple(s["matrix"][4 * a : 4 * a + 4]) for a in STATES), costs)
            illegal = sum(s["illegal"] for s in segments) + sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(segments, segments[1:]))
            out.append((costs[0], illegal, behind))
        kind = pa.list_(pa.struct({"head": pa.int64(), "costs": pa.list_(pa.int64()), "ends": pa.bool_()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind)],
            ["conv", "cost", "illegal", "behind"],
        )


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state in which a segment can begin: the letters of its choices and the state behind it."""
    for batch in batches:
        out = []
        for rows, costs, ends in zip(batch.column("rows").to_pylist(), batch.column("costs").to_pylist(), batch.column("ends").to_pylist()):
            runs, behind = runs_of(rows), [tuple(costs)]
            for symbol, n in reversed(runs):
                behind.append(before_run(symbol, n, behind[-1]))
            ways = []
            for state in STATES:
                parts = []
                for (symbol, n), after in zip(runs, behind[-2::-1]):
                    part, state = unroll_run(symbol, n, state, after)
                    parts.append(part)
                if ends:
                    parts.append("I" * (FINISH[state] // 2))
                ways.append({"letters": "".join(parts), "state": state})
            out.append(ways)
        kind = pa.list_(pa.struct({"letters": pa.string(), "state": pa.int32()}))
        yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("conv"), pa.array(out, kind)], ["head", "conv", "ways"])


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each conversation, and the letters and first state of each of its segments."""
    for batch in batches:
        out = []
        for segments in batch.column("segments").to_pylist():
            state, pieces = 0, []
            for s in segments:
                way = s["ways"][state]
                pieces.append({"head": s["head"], "letters": way["letters"], "state": state})
                state = way["state"]
            out.append(pieces)
        kind = pa.list_(pa.struct({"head": pa.int64(), "letters": pa.string(), "state": pa.int32()}))
        audits = pa.array(["".join(p["letters"] for p in pieces) for pieces in out], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("conv"), audits, pa.array(out, kind)], ["conv", "audit", "pieces"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each letter but D: the row it keeps or rewrites (``pos``), and the role it writes."""
    for batch in batches:
        for head, conv, rows, letters, state in zip(*(batch.column(c).to_pylist() for c in ("head", "conv", "rows", "letters", "state"))):
            taken = ((r["pos"], r["symbol"]) for r in rows for _ in range(r["m"]))
            out = []
            for no, letter in enumerate(letters):
                pos, symbol = (None, BLANK) if letter == "I" else next(taken)
                if letter == "D":
                    continue
                role = None if letter == "K" else WRITE[state][1]
                out.append((no, letter, pos, role))
                state = WRITE[state][0] if role else KEEP[INITIALS[symbol - TRUNCATED * (symbol > OTHER)]][state]
            if out:
                no, letter, pos, role = (pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(out), batch.schema.field("conv").type), pa.array([head] * len(out), pa.int64()), no, letter, pos, role],
                    ["conv", "head", "no", "edit", "pos", "written"],
                )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by the CRC-32 of ``conv_id:turn`` (a null as one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it a user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(key), F.lit(20)).alias("_d")).filter("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest repair of conversations given as rows: ``(reports, repaired)``.

    Rows of a conversation follow ``turn`` (nulls first), then role and text; a null role or text counts as one space.
    A row's first fault counts: blank (no visible character), duplicate (same role and text as an earlier row),
    truncated (the last visible character is none of ``.!?``). Edits: keep 0, rerole to user or assistant 2, delete 3
    (required for blank and duplicate rows), insert an empty user or assistant row 2; a truncated row that stays
    costs 1 more. A role that begins with none of s, u, a cannot be kept.

    ``reports``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit for every conversation with rows, the null
    conversation included. ``repaired``: conv, head, no, edit, turn, role, text of every row of the repaired
    conversations, in the order ``head, no``; inserted rows have no turn. No rows give two empty tables; other columns
    are ignored.
    """
    narrow = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    counted = narrow.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m"))
    once = materialize(counted.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")}), "rows")
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    seen = once.groupBy("conv", "h1", "h2").agg(F.min(at).alias("_first"))
    visible = r"[^\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(visible)
    repeats = F.col("_first") < at
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(repeats, "duplicate").when(cut, "truncated").otherwise("")
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in INITIALS.items() for x in (pair[1], pair[0])]), F.substring("role", 1, 1)), F.lit(OTHER))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), BLANK).otherwise(F.col("initial") + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    marked = join_back(once, seen, ["conv", "h1", "h2"]).withColumns({"fault": fault, "initial": initial}).withColumn("symbol", symbol)
    turns = materialize(
        marked.select("conv", "turn", "role", "text", "m", "fault", "initial", "symbol").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("pos", F.monotonically_increasing_id()),
        "turns",
    )
    row = F.struct("pos", "symbol", "initial", "m")
    segments = materialize(
        turns.groupBy("conv", F.shiftright("pos", segment).alias("segment")).agg(F.min("pos").alias("head"), F.sort_array(F.collect_list(row)).alias("rows")),
        "segments",
    ).select("conv", "head", "rows")
    kind = turns.schema["conv"].dataType.simpleString()
    advanced = segments.mapInArrow(_advance, f"head long, conv {kind}, matrix array<long>, first long, last long, illegal long")
    costs = materialize(
        advanced.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("head", "matrix", "first", "last", "illegal"))).alias("segments"))
        .mapInArrow(_from_the_end, f"conv {kind}, cost long, illegal long, behind array<struct<head: long, costs: array<long>, ends: boolean>>"),
        "costs",
    )
    behind = costs.select(F.explode("behind").alias("b")).select("b.*")
    ways = segments.join(behind, "head").mapInArrow(_letters, f"head long, conv {kind}, ways array<struct<letters: string, state: int>>")
    audits = materialize(
        ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("head", "ways"))).alias("segments"))
        .mapInArrow(_strung, f"conv {kind}, audit string, pieces array<struct<head: long, letters: string, state: int>>"),
        "audits",
    )
    more = F.col("m") - 1
    faults = turns.groupBy("conv").agg(
        F.coalesce(F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count_distinct("turn")), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("m")).otherwise(more)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).cast("long").alias("truncated"),
    )
    reports = join_back(join_back(faults, costs.select("conv", "illegal", "cost"), ["conv"]), audits.select("conv", "audit"), ["conv"])
    pieces = audits.select(F.explode("pieces").alias("p")).select("p.*")
    edits = segments.join(pieces, "head").mapInArrow(_edits, f"conv {kind}, head long, no long, edit string, pos long, written string")
    repaired = edits.join(turns.select("pos", "turn", "role", "text"), "pos", "left").select(
        "conv", "head", "no", "edit", "turn", F.coalesce("written", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return reports, repaired


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined ``role:text`` of each conversation, row by row as they stream by."""
    now, state, any_row = None, None, False
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if not any_row or conv != now:
                if any_row:
                    done.append((now, state.hexdigest()))
                now, state, any_row = conv, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("conv").type), pa.array([d[1] for d in done], pa.string())], ["conv", "sha256"])
        kind = batch.schema.field("conv").type
    if any_row:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["conv", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, sha256`` of conversations given as by :func:`repair`. A digest reads its rows in order, so one task streams
    a conversation through; it holds one batch of it."""
    kind = repaired.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), "head", "no"]
    return repaired.repartition("conv").sortWithinPartitions(*order).select("conv", "role", "text").mapInArrow(_digest, f"conv {kind}, sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``conversations``, with the repair of its ``rows``.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; a conversation without rows has
    zeros, an empty audit and the digest of the empty text.
    """
    reports, repaired = repair(rows)
    known = conversations.select(F.col("conv_id").alias("conv")).distinct()
    whole = join_back(join_back(known, reports, ["conv"]), digests(materialize(repaired, "repaired")), ["conv"])
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
