"""Capped shares, budgets and gaps against plain loops."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions.keyed import uniform
from gridspark.operators import augment as A
from gridspark.operators import tables as T


def pixels(spark, need, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, i // 50, i % 50, 24, 50, float(rng.random() > 0.2), float(v)) for k, vals in enumerate(need) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "frame long, y int, x int, h int, w int, gt double, need double")


@pytest.mark.parametrize("p_max", [0.0, 0.1, 0.31, 1.0])
def test_share_cap_equals_a_full_sort(spark, p_max):
    rng = np.random.default_rng(1)
    px = pixels(spark, [np.zeros(1200), rng.integers(0, 4, 1200), rng.random(1200) * 1e-9, rng.normal(0, 1e6, 1200), np.full(1200, 9.0), np.full(1200, -0.0), np.repeat([1e300, np.inf], 600)])
    close = (F.col("gt") > 0) & ~F.col("need").between(2.9, 3.1)
    got = {(r.frame, r.y, r.x) for r in A.share_cap(px, close, F.col("need"), p_max, "s").where("hole").collect()}
    all_ = px.withColumn("u", A.u_px("s", "cap")).withColumn("c", close).toPandas()
    want = set()
    for f, g in all_.groupby("frame"):
        room = int(np.floor(p_max * (g['gt'] > 0).sum()))
        g["need"] = g.need + 0.0
        want |= {(f, r.y, r.x) for r in g[g.c].sort_values(["need", "u", "y", "x"]).head(room).itertuples()}
    assert got == want


def fold(sizes, room):
    used, out = 0, []
    for s in sizes:
        out.append(used + s <= room)
        used += s if out[-1] else 0
    return out


def test_takes_equals_the_fold():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = rng.integers(0, 50, rng.integers(0, 400))
        room = float(rng.choice([0, 3, 7.5, 200, 1e9]))
        assert A.takes(sizes, room, int(rng.choice([3, 64, 1024]))).tolist() == fold(sizes.tolist(), room)


def test_hundred_thousand_regions_in_one_frame(spark):
    n = 100_000
    sizes = spark.range(n).select(F.lit(1).cast("long").alias("frame"), F.col("id").alias("label"), (1 + F.col("id") * 7919 % 1000).alias("size"), F.lit(10_000_000).cast("long").alias("area"))
    A.budgeted_regions(sizes.limit(10), "0", 0.9, 0.3).count()  # starts the workers
    t = time.perf_counter()
    got = {r.label for r in A.budgeted_regions(sizes, "0", 0.9, 0.3).collect()}
    assert time.perf_counter() - t < 20
    seen = sizes.withColumn("u", uniform("0", F.col("frame"), "pick", F.col("label"))).withColumn("o", uniform("0", F.col("frame"), "order", F.col("label"))).where("u < 0.9").toPandas().sort_values(["o", "label"])
    assert got == set(seen.label[np.array(fold(seen["size"].tolist(), 0.3 * 10_000_000))])
    hard = np.tile([1, 1000], 50_000)  # every second one fails
    hard[1::2] -= np.arange(50_000) // 60
    t = time.perf_counter()
    assert A.takes(hard, 1000.0).tolist() == fold(hard.tolist(), 1000.0)
    assert time.perf_counter() - t < 5


@pytest.mark.parametrize("per,gap,top", [(3, 40, 100), (1, 1, 5), (7, 3, 10), (50, 2, 1000)])
def test_gap_suppression_equals_the_loop(spark, per, gap, top):
    rng = np.random.default_rng(per)
    pdf = pd.DataFrame({"g": np.where(rng.random(600) < 0.4, 0, rng.integers(0, 4, 600)), "f": rng.integers(0, 200, 600), "s": rng.integers(0, 20, 600) / 4.0})
    kept, taken = [], {}
    for r in pdf.sort_values(["s", "f", "g"], ascending=[False, True, True]).itertuples():
        mine = taken.setdefault(r.g, [])
        if len(mine) < per and all(abs(r.f - x) >= gap for x in mine):
            mine.append(r.f)
            kept.append((r.s, r.g, r.f))
    want = sorted(kept, key=lambda r: (-r[0], r[1], r[2]))[:top]
    got = T.greedy_with_gap(spark.createDataFrame(pdf), "g", "f", "s", per, gap, top)
    assert [(r.s, r.g, r.f) for r in got.collect()] == want
