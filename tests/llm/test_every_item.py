"""op10 searches every text of an item, and items without an id."""

import random

from shelfmark.llm import decontam
from tests.llm.conftest import prose


def test_every_text_of_an_id_and_items_without_id(spark, monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, 20) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (3, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(rng, 15)} {t} {prose(rng, 15)}") for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted([(0, 1), (1, 1), (2, 2), (3, None), (4, None)], key=str)
    for block in (decontam.BLOCK, 1):
        monkeypatch.setattr(decontam, "BLOCK", block)
        assert sorted([(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()], key=str) == want
        assert [r["doc_id"] for r in decontam.without_leaks(docs, items).collect()] == [5]
