"""Resamples of clusters: the same draws with and without clusters sent to every task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import tables as T


def means(spark, sizes):
    rows = [(k, f"c{i:03d}", 1.0 + ((i * 7) % 11) / 10, 1.1 + ((i * 5) % 13) / 10) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "zone string, grp string, ref double, cur double")


def test_same_draws_either_way(spark):
    m = means(spark, {"full": 40, "edge": 3, "lone": 1})
    few = T.bootstrap_draws(m, ["zone"], "grp", 50, 0)
    many = T.bootstrap_draws(m, ["zone"], "grp", 50, 0, most=0)
    key = ["zone", "boot", "slot", "grp"]
    a, b = sorted(map(tuple, few.select(key).collect())), sorted(map(tuple, many.select(key).collect()))
    assert a == b and len(a) == 50 * 44
    assert {r[3] for r in a if r[0] == "lone"} == {"c000"}


def test_draws_are_not_shuffled(spark):
    m = means(spark, {"full": 40, "edge": 3})
    d = T.bootstrap_draws(m, ["zone"], "grp", 50, 0)
    b = d.groupBy("zone", "boot").agg(F.avg("cur").alias("v"))
    b.collect()
    plan = b._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the only exchange by hash deals whole resamples, before they become draws
    assert final.count("Exchange hashpartitioning") == 1, final
    assert "REPARTITION_BY_COL" in final and "BroadcastHashJoin" in final


def test_interval_equals_its_draws(spark):
    m = means(spark, {"full": 40, "edge": 3})
    d = T.bootstrap_draws(m, ["zone"], "grp", 200, 3).toPandas()
    for r in T.bootstrap_ci(m, ["zone"], "grp", 200, 3).collect():
        g = d[d.zone == r.zone].groupby("boot")[["ref", "cur"]].mean()
        v = 100.0 * (g.cur / g.ref - 1.0)
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=1e-9)


def test_no_clusters(spark):
    m = means(spark, {"full": 2}).where("false")
    assert T.bootstrap_draws(m, ["zone"], "grp", 10, 0).count() == 0
    assert T.bootstrap_ci(m, ["zone"], "grp", 10, 0).count() == 0
