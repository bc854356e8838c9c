"""The error of every likeness that op3 gives."""

import math
from collections import Counter

from shelfmark.llm import fingerprints
from tests.llm.conftest import edge_rows

ROWS = [(r[0], r[1] or "") for r in edge_rows()]


def test_each_row_is_near_the_weighted_likeness(edge_docs):
    texts = dict(ROWS)
    ids = sorted(texts)
    for r in fingerprints.fingerprints(edge_docs).collect():
        n = len(r["fingerprint"]) // 4
        assert n >= 32
        t, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        q = len(t) // 4
        for other, value in ((t[: len(t) - q] + after[:q], r["near_edited"]), (after, r["near_next"])):
            x, y = Counter(t.encode().split()), Counter(other.encode().split())
            want = sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
            # four standard errors of n samples, and one sample
            assert abs(value - want) <= 4 * math.sqrt(want * (1 - want) / n) + 1 / n
