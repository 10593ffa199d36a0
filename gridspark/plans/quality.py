"""Mask quality, worst cases and reference floors: plans that combine operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.layouts import spread
from gridspark.operators import geometry as G
from gridspark.operators import metrics as M
from gridspark.operators import raster as R
from gridspark.operators import stats as ST
from gridspark.operators.ordering import quantiles
from gridspark.session import cut


def mask_quality(px: DataFrame, cam: Sequence, min_px: int = 300, smooth_k: int = 5, max_rel_jump: float = 0.15, bin_m: float = 0.04,
                 level_px: int = 300, min_riser: int = 100) -> DataFrame:
    """Per frame: stair shares, geometric inlier shares, tread levels and the two stair flags.

    Expects ``gt`` and the masks ``tread, riser, band, ignore``.
    """
    share = px.groupBy("frame").agg(F.avg((F.col("tread") | F.col("riser")).cast("double")).alias("stair_share"), F.avg(F.col("riser").cast("double")).alias("riser_share"))
    p = px.withColumn("_meas", F.col("gt") > 0)
    p = R.box_mean_valid(p, "gt", "_meas", smooth_k, "_zs")
    n = G.normals_facing(p, "_zs", cam, F.col("_zs_full"), max_rel_jump)
    n = n.withColumn("_good", F.col("_meas") & ~F.col("band") & ~F.col("ignore") & F.col("n_ok"))
    n = cut(n.select("frame", "tread", "riser", "_good", "nx", "ny", "nz"))
    up = G.robust_up(n, F.col("tread") & F.col("_good"), min_px)
    j = n.where("_good").join(up, "frame")
    cos = F.abs(F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz"))
    inl = j.groupBy("frame").agg(F.avg(F.when(F.col("tread"), (cos > 0.85).cast("double"))).alias("tread_inlier"),
                                 F.when(F.count_if("riser") > min_riser, F.avg(F.when(F.col("riser"), (cos < 0.5).cast("double")))).alias("riser_inlier"))
    lev = G.tread_levels(px, F.col("tread") & (F.col("gt") > 0) & ~F.col("band"), up, "gt", cam, bin_m, level_px)
    q = share.join(inl, "frame", "left").join(lev, "frame", "left").withColumn("n_levels", F.coalesce("n_levels", F.lit(0).cast("bigint")))
    like = (F.col("n_levels") >= 2) & (F.col("riser_share") >= 0.02)
    strict = like & F.coalesce((F.col("tread_inlier") >= 0.8) & (F.col("riser_inlier") >= 0.4), F.lit(False))
    nan = F.lit(float("nan"))
    return q.select("frame", "stair_share", "riser_share", F.coalesce("tread_inlier", nan).alias("tread_inlier"), F.coalesce("riser_inlier", nan).alias("riser_inlier"),
                    F.coalesce("tread_inlier", nan).alias("score"), "n_levels", like.alias("stair_like"), strict.alias("stair_like_strict"))


def quality_distribution(q: DataFrame, thresholds: Sequence[float] = (0.4, 0.6, 0.8)) -> DataFrame:
    """Score percentiles and counts over thresholds, one row."""
    ok = ~F.isnan("score")
    c = q.agg(F.count(F.lit(1)).alias("frames"), F.count_if(~ok).alias("no_score"), F.count_if("stair_like").alias("stair_like"), F.count_if("stair_like_strict").alias("strict"),
              *[F.count_if(ok & (F.col("score") >= t)).alias(f"over_{int(t * 100)}") for t in thresholds]).withColumn("_o", F.lit(1))
    p = quantiles(q, [], "score", [0.1, 0.25, 0.5, 0.75, 0.9], ["p10", "p25", "p50", "p75", "p90"]).withColumn("_o", F.lit(1))
    return c.join(p, "_o", "left").drop("_o")


def worst_report(px: DataFrame, cfg: M.MetricConfig, metric: str, n: int, points: Column) -> DataFrame:
    """The n worst frames with their scores, scale bias, input points and covariates."""
    rows = M.per_frame(px, cfg)
    top = M.worst(rows, metric, n)
    # n frames: a fixed small side
    sel = px.join(F.broadcast(top.select("frame")), "frame")
    ratio = ST.median_ratio(sel, (F.col("gt") > cfg.min_depth) & (F.col("gt") < cfg.max_depth))
    pts = sel.groupBy("frame").agg(F.count_if(points).alias("input_points"))
    cov = ST.covariates(sel, cfg.min_depth, cfg.max_depth)
    return top.select("frame", "absrel", "rmse", "delta1", "n_valid").join(ratio, "frame", "left").join(pts, "frame").join(cov, "frame")


def error_correlations(rows: DataFrame, cov: DataFrame, metric: str, names: Sequence[str]) -> DataFrame:
    """Rank correlation of the per-frame error with each covariate; the pixels are read once, for one stored row per frame."""
    j = cut(rows.select(metric, "frame").join(cov.select("frame", *names), "frame"))
    out = None
    for c in names:
        r = ST.spearman(j, c, metric).select(F.lit(c).alias("property"), "n", "rho")
        out = r if out is None else out.unionByName(r)
    return out


def floor_nearest(px: DataFrame, value: str, lo: float, hi: float, sigma: float = 0.0) -> DataFrame:
    """Reference floor: nearest fill, mid-range where nothing was measured, optional blur, clip."""
    p = R.fill_nearest(px.select("frame", "y", "x", F.col(value).alias("pred")), "pred")
    p = p.withColumn("pred", F.when(F.col("pred") > 0, F.col("pred")).otherwise(0.5 * (lo + hi)))
    if sigma > 0:
        p = R.gaussian(p, "pred", sigma)
    return p.withColumn("pred", F.least(F.greatest("pred", F.lit(lo)), F.lit(hi)))


def floor_bicubic(lr: DataFrame, value: str, out_h: Column, out_w: Column, lo: float, hi: float, antialias: bool = False) -> DataFrame:
    """Reference floor: bicubic upsampling of the low-resolution map, clipped."""
    p = R.resize(lr.withColumn("pred", F.col(value)), "pred", out_h, out_w, "bicubic_aa" if antialias else "bicubic")
    return p.withColumn("pred", F.least(F.greatest("pred", F.lit(lo)), F.lit(hi)))


def floor_nearest_packed(frames: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """The nearest-fill floor on packed frames: one pass, no shuffle. Adds ``pred``."""
    return R.fill_nearest_packed(frames.withColumn("pred", F.col(value)), "pred", 0.5 * (lo + hi), lo, hi)


def floor_bicubic_packed(frames: DataFrame, value: str, out_h: Column, out_w: Column, lo: float, hi: float) -> DataFrame:
    """The bicubic floor on packed low-resolution frames. Adds ``pred`` and rewrites ``h``, ``w``."""
    return R.resize_packed(frames.withColumn("pred", F.col(value)), "pred", out_h, out_w, "bicubic", lo, hi)


def local_calibration(px: DataFrame, rel: str, anchor: str, lo: float, hi: float, min_pixels: int = 10, smooth: str = "bilateral", sigma: float = 15.0,
                      sigma_spatial: float = 6.0, range_scale: float = 0.25, max_radius: int = 10) -> DataFrame:
    """Fit a relative map to sparse anchors per segment, smooth the fit, apply and clip.

    ``px`` has ``label``; a frame without anchors gets the minimum depth and
    ``degenerate`` true.
    """
    if smooth not in ("none", "gaussian", "bilateral"):
        raise ValueError(f"unknown smoothing {smooth!r}")
    fit = ST.affine_per_segment(px, rel, anchor, F.col(anchor) > 0, min_pixels)
    p = px.join(fit.select("frame", "label", "s", "t", "gn"), ["frame", "label"])
    st = p.select("frame", "y", "x", "s", "t")
    if smooth == "gaussian":
        st = R.gaussian(st.select("frame", "y", "x", "s"), "s", sigma).join(spread(R.gaussian(st.select("frame", "y", "x", "t"), "t", sigma)), ["frame", "y", "x"])
    elif smooth == "bilateral":
        st = R.bilateral(st, "s", "t", sigma_spatial, range_scale, max_radius)
    out = p.drop("s", "t").join(spread(st), ["frame", "y", "x"])
    pred = F.least(F.greatest(F.col("s") * F.col(rel) + F.col("t"), F.lit(lo)), F.lit(hi))
    none = F.col("gn") == 0
    return out.select("frame", "y", "x", F.when(none, F.lit(lo)).otherwise(pred).alias("pred"), none.alias("degenerate"))
