"""Sliced windows against whole-key windows, with one hot key."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfmark.functions.windows import first_per_key, previous, running, turn_slice


def sample():
    rng = np.random.default_rng(1)
    key = np.where(rng.random(400) < 0.6, "hot", rng.choice(list("abc"), 400))
    return pd.DataFrame({"k": key, "seq": rng.permutation(400), "v": rng.integers(0, 9, 400)})


def test_running_up_and_down(spark):
    p = sample()
    df = spark.createDataFrame(p)
    up = running(df, ["k"], turn_slice(F.col("seq"), 16), [F.col("seq")], {"s": F.col("v"), "n": F.lit(1)}).toPandas()
    p = p.sort_values("seq")
    want = p.assign(s=p.groupby("k").v.cumsum(), n=p.groupby("k").cumcount() + 1)
    pd.testing.assert_frame_equal(
        up.sort_values("seq", ignore_index=True)[["k", "seq", "s", "n"]],
        want.reset_index(drop=True)[["k", "seq", "s", "n"]], check_dtype=False,
    )
    down = running(
        df, ["k"], turn_slice(F.col("seq"), 16), [F.col("seq").desc()], {"s": F.col("v")}, descending=True
    ).toPandas().sort_values("seq", ignore_index=True)
    back = p.assign(s=p[::-1].groupby("k").v.cumsum()[::-1]).reset_index(drop=True)
    assert list(down.s) == list(back.s)


def test_running_without_key_and_null_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 30, 7), ("x", 2, 1)], "k string, seq long, v long")
    whole = running(df, [], turn_slice(F.col("seq"), 4), [F.col("seq")], {"s": F.col("v")})
    assert [r.s for r in whole.orderBy("seq").collect()] == [5, 6, 13]
    keyed = running(df, ["k"], turn_slice(F.col("seq"), 4), [F.col("seq")], {"s": F.col("v")})
    assert [r.s for r in keyed.orderBy("seq").collect()] == [5, 1, 12]


def test_previous_crosses_slices(spark):
    p = sample()
    got = previous(spark.createDataFrame(p), ["k"], turn_slice(F.col("seq"), 8), ["seq"], "v", "before").toPandas()
    got = got.sort_values("seq", ignore_index=True)
    p = p.sort_values("seq", ignore_index=True)
    want = p.groupby("k").v.shift(1)
    assert got.before.fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], [F.col("o")]).collect())) == [("a", 1, "y"), ("b", 3, None)]
    assert ("a", 2, "x") in set(map(tuple, first_per_key(df, ["k"], [F.col("o")], last=True).collect()))
