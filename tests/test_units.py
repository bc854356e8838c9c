"""A question goes once to the regions that travel together, and a score to reach rules regions out."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cells
from shelfmark.operators.cells import Cells, cell_topk
from tests.test_cells import brute, clustered, table


def sent(spark, monkeypatch, corpus, asked, **how):
    """Rows of ``cell_topk``, and how often a question was sent in the second turn."""
    turns, whole = [], Cells.asked_units

    def counted(self, targets):
        turns.append(whole(self, targets))
        return turns[-1]

    monkeypatch.setattr(Cells, "asked_units", counted)
    got = {tuple(r) for r in cell_topk(table(spark, asked, "query_id"), table(spark, corpus, "chunk_id"), 3, pivots=12, slice_rows=64, **how).collect()}
    assert turns[-1].groupBy("query_id", "unit").count().filter("count > 1").count() == 0
    return got, turns[-1].count(), turns[-1].agg(F.sum(F.size("regions"))).first()[0]


@pytest.mark.parametrize("unit", [100, 400, 1 << 16])
def test_a_question_goes_once_to_a_unit(spark, monkeypatch, unit):
    monkeypatch.setattr(cells, "UNIT", unit)
    monkeypatch.setattr(cells, "REGION", 64)
    monkeypatch.setattr(cells, "ASKED", 40)
    corpus, asked = clustered(900), clustered(80, seed=5)
    got, copies, regions = sent(spark, monkeypatch, corpus, asked)
    assert got == brute(asked, corpus, 3)
    assert copies <= 80 * (len(corpus) // unit + 1) and regions >= copies


def test_a_score_to_reach_rules_regions_out(spark, monkeypatch):
    monkeypatch.setattr(cells, "UNIT", 64)
    corpus, asked = clustered(900), clustered(80, seed=5)
    everything, copies, _ = sent(spark, monkeypatch, corpus, asked)
    got, fewer, _ = sent(spark, monkeypatch, corpus, asked, least=0.97)
    assert {r for r in got if r[2] >= 0.97} == {r for r in everything if r[2] >= 0.97}
    assert fewer < copies
