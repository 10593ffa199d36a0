"""Region columns, accepted splits and logged evaluations on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics as M
from gridspark.plans import evaluate as E
from gridspark.plans import reports as R


def test_region_columns_show_per_dataset(spark):
    log = spark.createDataFrame([("a_x", "a", "net", "s1", 1, "0.5"), ("a_y", "a", "fill", "s1", 2, ""), ("b_x", "b", "net", "s1", 3, "n/a"), ("a_x", "a", "net", "s0", 4, "9")],
                                "experiment string, dataset string, method string, stamp string, pos int, holes_rmse string")
    table = spark.createDataFrame([("a", "a_x", "net", 8, "p"), ("a", "a_y", "fill", 8, "p"), ("b", "b_x", "net", 1, "q")], "dataset string, key string, method string, sort_rank int, protocol string")
    got = {r.key: (r.has_regions, r.holes_rmse, r.valid_rmse, r.line) for r in R.with_regions(table, log, ["net"]).collect()}
    # The newest row of a_x counts; a network comes before a floor of the same rank.
    assert got == {"a_x": (True, 0.5, None, 1), "a_y": (True, None, None, 2), "b_x": (False, None, None, 1)}


def test_accepted_ranks_and_unknown_ones(spark):
    c = spark.createDataFrame([(k, f"s{9 - k}") for k in range(1, 6)], "rank int, id string")
    say = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    doc = R.accepted_split(c, say("1 3-4", " 4"), "id", "d", "new").collect()
    assert [json.loads(r.doc) for r in doc] == [{"dataset": "d", "split": "new", "ids": ["s5", "s6", "s8"]}]
    with pytest.raises(Exception, match="no such rank: 7"):
        R.accepted_split(c, say("2 7"), "id", "d", "new").collect()


def frames(spark, rows):
    return spark.createDataFrame(rows, "frame int, h int, w int, gt array<double>, sparse array<double>, seen array<boolean>")


def test_logged_evaluation_equals_numpy_and_counts_unreadable(spark):
    rng = np.random.default_rng(3)
    gt = rng.uniform(0.2, 3, (5, 12))
    seen = rng.random((5, 12)) < 0.6
    rows = [(k, 3, 4, gt[k].tolist(), None if k == 4 else gt[k].tolist(), seen[k].tolist()) for k in range(5)]
    cfg = M.MetricConfig(0.1, 3.5)
    leaves = {"model.name": "m", "dataset.name": "d", "seed": "1"}
    per, row = E.logged_evaluation(frames(spark, rows), lambda d: d * 1.1, cfg, leaves, {"dataset": "d", "method": "m"}, "seen")
    r = row.collect()[0]
    err = np.abs(np.clip(gt[:4] * 1.1, 0.1, 3.5) - gt[:4]) / gt[:4]
    assert per.count() == 4 and r.n_unreadable == 1 and r.n_samples == 4
    assert r.absrel == pytest.approx(err.mean(1).mean()) and r.holes_absrel == pytest.approx(err[~seen[:4]].mean())
    assert r.holes_frac == pytest.approx((~seen[:4]).mean()) and len(r.config_hash) == 12
    again = E.logged_evaluation(frames(spark, rows), lambda d: d * 1.1, cfg, leaves | {"seed": "2"}, {}, "seen")[1].collect()[0]
    assert again.config_hash != r.config_hash
    with pytest.raises(Exception, match="no sample could be read"):
        E.logged_evaluation(frames(spark, [(*x[:4], None, x[5]) for x in rows]), lambda d: d, cfg, leaves, {})[1].collect()


def test_zone_report_counts_frames_with_a_zone(spark):
    px = spark.createDataFrame([(f, 0, x, 1, 4, 1.0, 1.1, f == 0 and x < 2) for f in range(3) for x in range(4)], "frame int, y int, x int, h int, w int, gt double, pred double, tread boolean")
    docs, doc = E.zone_report(px, {"full": F.lit(True), "stairs": F.col("tread")}, M.MetricConfig(0.1, 3.5), missing=F.col("x") == 0)
    d = doc.collect()[0]
    assert (d.full.n, d.stairs.n, d.n_frames, d.input_invalid_frac, d.step_run_abs) == (3, 1, 3, 0.25, None)
    by = {r.frame: r for r in docs.collect()}
    assert by[0].stairs.absrel == pytest.approx(0.1) and np.isnan(by[1].stairs.absrel) and by[1].full.absrel == pytest.approx(0.1)
