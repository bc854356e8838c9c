"""The model of op4 learns from every trusted text."""

import math

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import kneser


@pytest.mark.parametrize("travel", [kneser.TRAVEL, 0])
def test_every_trusted_text_is_learnt(spark, monkeypatch, travel):
    monkeypatch.setattr(kneser, "TRAVEL", travel)  # whether the trusted ids travel or are joined by a shuffle
    n = 4300
    letters = F.concat(*[F.substring(F.lit("abcdefghij"), 1 + F.floor(F.col("id") / 10**i).cast("int") % 10, F.lit(1)) for i in range(4)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), letters.alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(docs.filter("doc_id = 7"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r["doc_id"]: r["log_prob"] for r in kneser.quality(docs, labels).collect()}
    alphabet, model = kneser.fit(docs.select("text"))
    want = {r["doc_id"]: r["log_prob"] for r in kneser.score(docs, alphabet, model).collect()}
    assert len(got) == n and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
