import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from spendtrace.operators.stats import exact_stats, value_counts

Q = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def sample(n=4000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else rng.choice("abc")
        value = None if rng.random() < 0.05 else int(rng.lognormvariate(7, 2))
        rows.append((key, value, f"id{i}" if i % 10 else None))
    return rows + [("empty", None, "x"), ("one", 7, "y"), ("pair", 1, "z"), ("pair", 4, None)]


def test_matches_pandas_per_group(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v bigint, id string")
    hist = value_counts(df, ["k"], "v", counts={"ids": F.count("id")})
    got = {r.k: r for r in exact_stats(hist, ["k"], Q, ["ids"], with_std=True).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v", "id"])
    for key, g in pdf.groupby("k"):
        v, r = g.v.dropna().astype(float), got[key]
        assert r.n == len(v) and r.ids == g.id.notna().sum()
        if len(v) == 0:
            assert r["mean"] is None and r["min"] is None and r["median"] is None
            continue
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12)
        assert (r["min"], r["max"]) == (v.min(), v.max())
        for name, q in Q.items():
            assert r[name] == pytest.approx(np.quantile(v, q), rel=1e-12), (key, name)
        if len(v) > 1:
            assert r["std"] == pytest.approx(v.std(), rel=1e-9)
        else:
            assert r["std"] is None


def test_whole_frame_and_no_rows(spark):
    rows = sample(500)
    df = spark.createDataFrame(rows, "k string, v bigint, id string")
    r = exact_stats(value_counts(df, [], "v"), [], Q).first()
    v = pd.Series([x[1] for x in rows]).dropna()
    assert r["median"] == v.median() and r.n == len(v)
    empty = exact_stats(value_counts(df.filter("k = 'none'"), [], "v"), [], Q).first()
    assert empty.n == 0 and empty["median"] is None


def test_weights_stand_for_rows(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 5, 3), ("a", 9, 1)], "k string, v bigint, w bigint")
    r = exact_stats(value_counts(df, ["k"], "v", F.col("w")), ["k"], {"median": 0.5}).first()
    assert (r.n, r["mean"], r["median"]) == (6, 26 / 6, 5.0)


def test_small_example(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "v bigint")
    r = exact_stats(value_counts(df, [], "v"), [], Q).first()
    assert (r["median"], r["q25"]) == (3.0, 1.75)
