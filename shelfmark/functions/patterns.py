"""Tables of very many literal patterns against texts, in one pass over each text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns, and characters of patterns, that travel to the tasks as one automaton.
MAX_PATTERNS, MAX_CHARACTERS = 200_000, 8_000_000
KEPT = 4
_BUILT: dict[str, object] = {}


class Automaton:
    """All occurrences of many patterns: ``(end, number)`` with the last position and the pattern's number.

    An Aho-Corasick automaton where its library is installed, else one search per pattern.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        try:
            import ahocorasick
        except ImportError:
            self.trie = None
            return
        self.trie = ahocorasick.Automaton()
        for number, pattern in enumerate(patterns):
            self.trie.add_word(pattern, number)
        self.trie.make_automaton()

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        if self.trie is not None:
            yield from self.trie.iter(text) if self.patterns else ()
            return
        for number, pattern in enumerate(self.patterns):
            at = text.find(pattern)
            while at >= 0:
                yield at + len(pattern) - 1, number
                at = text.find(pattern, at + 1)


def _automaton(name: str, shipped) -> Automaton:
    """Built once in each Python worker, which keeps the last few."""
    if name not in _BUILT:
        while len(_BUILT) >= KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = Automaton([r[0] for r in shipped.value])
    return _BUILT[name]


def _blocks(rules: DataFrame, columns: list[str]) -> list[tuple]:
    """Named blocks of ``rules`` that may travel, their patterns distinct: of equal patterns the one of least ``columns``."""
    spark = rules.sparkSession
    rest = F.struct(*columns) if columns else F.lit(0)
    distinct = rules.filter(F.col("pattern") != "").groupBy("pattern").agg(F.min(rest).alias("_rest"))
    count, characters = distinct.agg(F.count("*"), F.sum(F.length("pattern"))).first()
    n = max(1, math.ceil(count / MAX_PATTERNS), math.ceil((characters or 0) / MAX_CHARACTERS))
    of = F.pmod(F.xxhash64("pattern"), F.lit(n))
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in distinct.filter(of == i).collect()])) for i in range(n)]


def first_rule(text: Column, rules: DataFrame) -> Column:
    """The ``category`` of the rule of least ``priority`` among ``rules(pattern, category, priority)`` whose pattern stands in
    ``text``; ties by category; NULL if none does. ``priority`` is a whole number. More rules than may travel at once make
    one pass over the text for each block of them."""

    def of(name: str, shipped) -> Column:
        @F.pandas_udf("priority long, category string")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton, rests = _automaton(name, shipped), [r[1] for r in shipped.value]
            for texts in batches:
                best = [min((tuple(rests[n]) for _, n in automaton.occurrences(t or "")), default=(None, None)) for t in texts]
                yield pd.DataFrame(best, columns=["priority", "category"]).astype({"priority": "Int64"})

        found = find(text)
        return F.when(found["priority"].isNotNull(), found)

    found = [of(*b) for b in _blocks(rules, ["priority", "category"])]
    return (found[0] if len(found) == 1 else F.least(*found))["category"]


def mentions(docs: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, exploded to ``pattern, at, n``: each pattern of ``rules(pattern)`` that stands in it, its first
    position (from 1) and how often it stands there, overlaps counted."""
    rest = [c for c in docs.columns if c != text_col]

    def of(name: str, shipped) -> DataFrame:
        @F.pandas_udf("array<struct<pattern: string, at: int, n: int>>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = _automaton(name, shipped)
            for texts in batches:
                rows = []
                for t in texts:
                    seen: dict[int, list[int]] = {}
                    for end, number in automaton.occurrences(t or ""):
                        at = end - len(automaton.patterns[number]) + 2
                        first = seen.setdefault(number, [at, 0])
                        first[1] += 1
                    rows.append([{"pattern": automaton.patterns[k], "at": at, "n": n} for k, (at, n) in seen.items()])
                yield pd.Series(rows)

        return docs.select(*rest, F.explode(find(text_col)).alias("_m")).select(*rest, "_m.*")

    found = [of(*b) for b in _blocks(rules, [])]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
