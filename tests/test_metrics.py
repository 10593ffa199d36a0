"""Hand-derived values of the metric definitions."""

import math

import pytest

from gridspark.operators import metrics as M


def frame(spark, gt, pred, name=0):
    rows = [(name, y, x, float(g), float(p), len(gt), len(gt[0])) for y, (a, b) in enumerate(zip(gt, pred)) for x, (g, p) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "frame int, y int, x int, gt double, pred double, h int, w int")


CFG = M.MetricConfig(0.1, 100.0)


def one(spark, gt, pred, cfg=CFG):
    return M.per_frame(frame(spark, gt, pred), cfg).collect()[0]


def test_ten_percent_too_far(spark):
    gt = [[1, 2], [4, 8]]
    r = one(spark, gt, [[1.1 * v for v in a] for a in gt])
    assert r.absrel == pytest.approx(0.1)
    assert r.mae == pytest.approx(0.375)
    assert r.rmse == pytest.approx(0.1 * math.sqrt(21.25))
    assert r.sqrel == pytest.approx(0.0375)
    assert r.rmse_log == pytest.approx(math.log(1.1))
    assert r.silog == pytest.approx(0.0, abs=1e-5)
    assert (r.delta1, r.delta2, r.delta3) == (1.0, 1.0, 1.0)


def test_delta_is_strict(spark):
    r = one(spark, [[1, 1], [1, 1]], [[1, 1.2], [1.25, 2]])
    assert (r.delta1, r.delta2, r.delta3) == (0.5, 0.75, 0.75)


def test_invalid_pixels_do_not_count(spark):
    r = one(spark, [[1, 0], [4, 200]], [[1, 9], [4, 9]])
    assert (r.n_valid, r.rmse, r.valid_ratio) == (2, 0.0, 0.5)


def test_nothing_valid_gives_nan_and_a_skip(spark):
    px = frame(spark, [[0, 0]], [[1, 1]])
    r = M.per_frame(px, CFG)
    assert math.isnan(r.collect()[0].absrel)
    s = M.image_pool(r, CFG).collect()[0]
    assert (s.n_samples, s.n_skipped) == (0, 1) and math.isnan(s.rmse)


def test_pooling(spark):
    a = frame(spark, [[1, 1, 1, 1]], [[1.1] * 4], 0)
    b = frame(spark, [[1, 0, 0, 0]], [[1.5] * 4], 1)
    px = a.unionByName(b)
    assert M.image_pool(M.per_frame(px, CFG), CFG).collect()[0].absrel == pytest.approx(0.3)
    assert M.pixel_pool(px, CFG).collect()[0].absrel == pytest.approx(0.18)


def test_border_crop(spark):
    g = [[1.0] * 20] * 20
    r = one(spark, g, g, M.MetricConfig(0.1, 100.0, crop="border6"))
    assert r.n_valid == 64 and r.valid_ratio == 1.0


def test_eigen_crop_needs_its_size(spark):
    with pytest.raises(Exception, match="480x640"):
        one(spark, [[1.0]], [[1.0]], M.MetricConfig(crop="eigen"))


def test_clamp_and_unclamped(spark):
    nan, inf = float("nan"), float("inf")
    cfg = M.MetricConfig(0.1, 4.0)
    assert one(spark, [[2, 2]], [[nan, -inf]], cfg).mae == pytest.approx((2.0 + 1.9) / 2)
    r = one(spark, [[2, 2]], [[nan, 3]], M.MetricConfig(0.1, 4.0, clamp_pred=False))
    assert (r.n_valid, r.mae) == (1, 1.0)


def test_window_must_be_ordered():
    with pytest.raises(ValueError):
        M.MetricConfig(2.0, 1.0)


def test_worst_skips_nan(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, float("nan")), (3, 0.5)], "frame int, absrel double")
    assert [r.frame for r in M.worst(rows, "absrel", 5).collect()] == [3, 1]
