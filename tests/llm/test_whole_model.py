"""The model of op7 holds every pair of words."""

import math
import zlib
from collections import Counter

import pytest

from shelfmark.llm import queries, scoring
from tests.llm.conftest import edge_rows

ROWS = [(r[0], r[1] or "") for r in edge_rows()]


def full_scores(rows):
    """Scores under the pair model with every pair of the training rows, by dictionaries."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    train = [[*lower(t), "$"] for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    c, pairs, total, after = Counter(), Counter(), Counter(), Counter()
    for w in train:
        c.update(w)
        pairs.update(zip(["^", *w], w))
    for (a, _), x in pairs.items():
        total[a] += x
        after[a] += 1
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    one, two = (sum(x == k for x in pairs.values()) for k in (1, 2))
    d1, d2 = once / v, one / (one + 2 * two)
    single = lambda w: (c[w] - d1) / n if c[w] else d1 * v / n
    back = lambda a: d2 * after[a] / total[a] if a in total else 1.0
    p = lambda a, w: ((pairs[a, w] - d2) / total[a] if pairs[a, w] else 0) + back(a) * single(w)
    assert all(sum(p(a, w) for w in [*c, "unknown"]) == pytest.approx(1) for a in list(total)[:5])
    return Counter((d, round(sum(math.log10(p(a, x)) for a, x in zip(["^", *lower(t)], [*lower(t), "$"])), 6)) for d, t in rows)


@pytest.mark.parametrize("head", [1 << 17, 12, 0])
def test_op7_keeps_pairs_seen_once(spark, edge_docs, tmp_path, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)  # however many of the commonest words travel
    edge_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_backoff_automaton_scores"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == full_scores(ROWS)
    rounded = {(r["doc_id"], round(r["score"], 6)) for r in scoring.log_probabilities(edge_docs, cutoff=2).collect()}
    assert rounded != {(r["doc_id"], round(r["score"], 6)) for r in got}
