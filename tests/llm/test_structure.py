"""Conversation repair against a row-by-row program over whole letter strings."""

import hashlib
import random
import zlib

import pytest

from shelfmark.llm import structure
from tests.llm.conftest import EXTRA

SCHEMA = f"conv_id long, turn long, role string, text string, conv string, pos long, m int, symbol int, head long, fault string, {EXTRA}"
CLASH = ("c", 1, 2, 3, 4, "f", 1, "k", 2, 3, "h", 4, 0.5)
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_report(rows):
    """Faults, least cost, least letters and repaired text of one conversation."""
    rows = sorted(((t is not None, t or 0, r, x) for _, t, r, x in rows), key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
    turns = [t for has, t, _, _ in rows if has]
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    marked, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            count[fault] += 1
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, text) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to is not None:
                        way = (cost + 2, audit + "I", (*text, f"{role}:"))
                        best[to] = min(best.get(to, way), way)
        return best

    for role, text, fault in marked:
        after = {}
        for state, (cost, audit, done) in insert(best).items():
            ways = [(state, 3, "D", done)]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                ways += [(step.get((state, r[0])), 2 + cut, "R", (*done, f"{r}:{text}")) for r in ("user", "assistant")]
                ways.append((step.get((state, role[:1])), cut, "K", (*done, f"{role}:{text}")))
            for to, more, letter, d in ways:
                if to is not None:
                    way = (cost + more, audit + letter, d)
                    after[to] = min(after.get(to, way), way)
        best = after
    cost, audit, text = min(insert(best)[s] for s in (0, 3) if s in insert(best))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


def brute_all(rows):
    after = brute_damage(rows)
    return {(c, *brute_report([r for r in after if r[0] == c])) for c in {r[0] for r in rows}}


def talks(seed=2):
    rng = random.Random(seed)
    texts = ["Fine.", "Why?", "cut off", "", " \n", None, "Go! ", "And then.\n", "so", "ü.", "a.b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in range(60):
        kind = rng.random()
        for turn in range(rng.randint(1, 25)):
            role = rng.choice(roles) if kind < 0.4 else rng.choice(roles[:3]) if kind < 0.7 else "user" if turn % 2 == 0 or kind > 0.9 else "assistant"
            text = rng.choice(texts) if rng.random() < 0.6 else f"Turn {turn}."
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn * 3, 5]), role, text))
    rows += rows[:5]  # repeated rows
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (900, None, None, None), (901, 0, "user", "x" * 70_000 + ".")]
    rows += [(902, t, "user", "same.") for t in range(300)] + [(903, 7, "user", "same.")] * 300 + [(904, t, "user", f"Row {t}.") for t in range(700)]
    return rows


@pytest.mark.parametrize("segment", [1, 3, 12])
def test_report_equals_brute_force(spark, segment, monkeypatch):
    rows = talks()
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)
    repair = structure.repair
    monkeypatch.setattr(structure, "repair", lambda x: repair(x, segment=segment))
    got = structure.repair_report(df, structure.damaged(df)).collect()
    assert {tuple(r) for r in got} == brute_all(rows)
    assert len(got) == len({r[0] for r in rows})


def test_conversations_lost_to_the_damage_and_none_at_all(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    row = structure.repair_report(df, structure.damaged(df)).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    none = df.limit(0)
    assert structure.repair_report(none, structure.damaged(none)).count() == 0


def test_repaired_rows(spark):
    rows = [("x", 1, "system", "Be kind."), ("x", 2, "assistant", "Hello."), ("x", 3, "user", "Bye."), ("x", 4, "user", "Bye.")]
    reports, repaired = structure.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert reports.first()["audit"] == "KIKKDI" and reports.first()["cost"] == 2 + 3 + 2
    got = [tuple(r)[3:] for r in repaired.orderBy("head", "no").collect()]
    assert got == [("K", 1, "system", "Be kind."), ("I", None, "user", ""), ("K", 2, "assistant", "Hello."), ("K", 3, "user", "Bye."), ("I", None, "assistant", "")]


def test_powers_are_repeated_products():
    for symbol in range(9):
        costs = structure.FINISH
        for n in range(1, 40):
            costs = structure._times(structure.power(symbol, 0), costs)
            assert structure.before_run(symbol, n, structure.FINISH) == costs
