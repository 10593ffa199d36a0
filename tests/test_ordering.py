"""Ranks, carries and quantiles, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import ordering as O
from gridspark.operators import tables as T


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str)), "v": rng.integers(0, 900, n).astype(float), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(13)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rank_is_the_same_on_any_partitioning(spark, skewed, parts):
    pdf, df = skewed
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.ranked(df, ["k"], ["v", "id"], "r", count="n").toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    exp = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got["r"].to_numpy() == exp.sort_index().to_numpy()).all()
    assert (got["n"].to_numpy() == pdf.groupby("k")["k"].transform("size").to_numpy()).all()


def test_hot_key_spans_slices(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = O.sliced(skewed[1], ["k"], ["v", "id"])
        assert s.where("k = 'hot'").select(O.SLICE).distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles(spark, skewed):
    pdf, df = skewed
    got = O.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.975, 1.0], list("abcde")).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k].to_numpy(), np.percentile(g["v"], [0, 10, 50, 97.5, 100]))


@pytest.mark.parametrize("how", ["last", "next", "min", "max", "sum"])
def test_carried(spark, skewed, how):
    pdf, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        val = F.when(F.col("id") % 3 == 0, F.col("v"))
        got = O.carried(df, ["k"], ["v", "id"], val, "c", how, inclusive=False).toPandas().sort_values(["k", "v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    p = pdf.sort_values(["k", "v", "id"]).copy()
    p["x"] = p["v"].where(p["id"] % 3 == 0)

    def ref(s):
        fill = {"last": lambda t: t.ffill().shift(), "next": lambda t: t.bfill().shift(-1), "min": lambda t: t.cummin().ffill().shift(),
                "max": lambda t: t.cummax().ffill().shift(), "sum": lambda t: t.fillna(0).cumsum().where(t.notna().cumsum() > 0).shift()}[how]
        return fill(s)

    exp = p.groupby("k", group_keys=False)["x"].apply(ref)
    assert np.allclose(got["c"].to_numpy(float), exp.to_numpy(float), equal_nan=True)


def test_nearest_in_time_tie_goes_to_the_earlier(spark):
    a = spark.createDataFrame([(10, 1), (20, 2), (95, 3)], "t bigint, a bigint")
    b = spark.createDataFrame([(5, 7), (15, 8), (15, 9), (100, 4)], "t bigint, b bigint")
    got = {r.a: (r.b, r.gap) for r in O.nearest_in_time(a, b, "t", "b").collect()}
    assert got == {1: (7, 5), 2: (8, 5), 3: (4, 5)}


def test_average_rank(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted((r.v, r.r) for r in O.average_rank(df, "v", "r").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_greedy_suppression_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "f": np.arange(300), "s": rng.random(300).round(3)})
    kept, taken = [], {}
    for r in pdf.sort_values(["s", "f"], ascending=[False, True]).itertuples():
        mine = taken.setdefault(r.g, [])
        if len(mine) < 3 and all(abs(r.f - x) >= 40 for x in mine):
            mine.append(r.f)
            kept.append((r.g, r.f))
    got = T.greedy_with_gap(spark.createDataFrame(pdf), "g", "f", "s", 3, 40, 100)
    assert {(r.g, r.f) for r in got.collect()} == set(kept)


def test_log_migration(spark):
    base = ["t", "absrel"]
    vs = [base, [*base, "n"], [*base, "n", "hash"]]
    lines = spark.createDataFrame([("a,.5",), ("b,.6,2",), ("c,.9,0,abc",)], "value string")
    got = sorted(tuple(r) for r in T.by_schema_version(lines, vs, vs[-1]).collect())
    assert got == [("a", ".5", "", ""), ("b", ".6", "2", ""), ("c", ".9", "0", "abc")]
    with pytest.raises(Exception, match="unknown layout of width"):
        T.by_schema_version(spark.createDataFrame([("a,b,c,d,e",)], "value string"), vs, base).collect()
