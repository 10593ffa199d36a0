"""Statistics over ground truth, masks and per-frame rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.operators import raster as R
from gridspark.operators import segment as SG
from gridspark.operators.ordering import average_rank, quantiles

# Depth bins of the audit and of the hole rates, in metres.
AUDIT_BINS = ((0.5, 1.5), (1.5, 3.0), (3.0, 6.0))
HOLE_BINS = (0.6, 2.0, 4.0, 8.0)
SHARE_EDGES = (0.0, 0.01, 0.02, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 1.0)

NAN = float("nan")


def step_mm(px: DataFrame, lo: float, hi: float) -> DataFrame:
    """Median gap of neighbouring distinct valid depths per frame, in millimetres (NaN with fewer than two)."""
    d = px.where((F.col("gt") > lo) & (F.col("gt") < hi)).select("frame", "gt").distinct()
    gap = F.col("gt") - F.lag("gt").over(W.partitionBy("frame").orderBy("gt"))
    g = d.withColumn("gap", gap).groupBy("frame").agg((F.percentile("gap", F.lit(0.5)) * 1000.0).alias("step_mm"))
    return g.withColumn("step_mm", F.coalesce("step_mm", F.lit(NAN)))


def flat_patches(px: DataFrame, origins: DataFrame, lo: float, hi: float, size: int = 7, smooth: float = 0.08) -> DataFrame:
    """Median depth and RMS plane residual of smooth, fully valid patches: ``(frame, k, med, rms)``.

    On the fixed patch grid x and y are uncorrelated, so the plane fit is two
    covariances.
    """
    p = R.patches(px, origins, size, ["gt"])
    ok = (F.col("gt") > lo) & (F.col("gt") < hi)
    g = p.groupBy("frame", "k").agg(
        F.count_if(ok).alias("n"), F.percentile("gt", F.lit(0.5)).alias("med"), (F.max("gt") - F.min("gt")).alias("span"),
        F.var_pop("gt").alias("v"), F.covar_pop("gt", "dx").alias("cx"), F.covar_pop("gt", "dy").alias("cy"), F.var_pop("dx").alias("vx"), F.var_pop("dy").alias("vy"))
    g = g.where((F.col("n") == size * size) & (F.col("span") < smooth * F.col("med")))
    res = F.col("v") - F.col("cx") * F.col("cx") / F.col("vx") - F.col("cy") * F.col("cy") / F.col("vy")
    return g.select("frame", "k", "med", F.sqrt(F.greatest(res, F.lit(0.0))).alias("rms"))


def audit(px: DataFrame, origins: DataFrame, lo: float, hi: float, min_patches: int = 100, size: int = 7) -> DataFrame:
    """One row: hole and in-range shares, quantisation step, patch count and noise by depth bin."""
    f = px.groupBy("frame").agg(F.avg((F.col("gt") <= 0).cast("double")).alias("holes"), F.avg(((F.col("gt") > lo) & (F.col("gt") < hi)).cast("double")).alias("inr"))
    one = f.agg(F.count(F.lit(1)).alias("frames"), (100 * F.avg("holes")).alias("holes_pct"), (100 * F.avg("inr")).alias("in_range_pct")).withColumn("_o", F.lit(1))
    st = quantiles(step_mm(px, lo, hi), [], "step_mm", [0.5], ["step_mm"]).withColumn("_o", F.lit(1))
    pt = flat_patches(px, origins, lo, hi, size)
    out = one.join(st, "_o", "left").join(pt.agg(F.count(F.lit(1)).alias("patches")).withColumn("_o", F.lit(1)), "_o", "left")
    binned = pt.withColumn("bin", F.coalesce(*[F.when((F.col("med") >= a) & (F.col("med") < b), F.lit(f"noise_mm_{i}")) for i, (a, b) in enumerate(AUDIT_BINS)])).where("bin is not null")
    n = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(binned, ["bin"], "rms", [0.5], ["m"]).join(n, "bin").withColumn("m", F.when(F.col("n") >= min_patches, F.col("m") * 1000.0).otherwise(NAN))
    wide = q.agg(*[F.coalesce(F.max(F.when(F.col("bin") == f"noise_mm_{i}", F.col("m"))), F.lit(NAN)).alias(f"noise_mm_{i}") for i in range(len(AUDIT_BINS))])
    return out.join(wide.withColumn("_o", F.lit(1)), "_o", "left").drop("_o")


def covariates(px: DataFrame, lo: float, hi: float, far_m: float = 4.0, jump: float = 0.10) -> DataFrame:
    """Facts about each frame's ground truth alone; NaN when nothing is valid."""
    g = F.col("gt")
    ok = (g > lo) & (g < hi)
    v = F.when(ok, g)
    p = px.withColumn("_v", v)
    for axis in ("x", "y"):
        back = R.shift(F.col("_v"), axis, -1)
        rel = F.abs(F.col("_v") - back) / F.greatest(back, F.lit(1e-6))
        p = p.withColumn(f"_j{axis}", (rel > jump).cast("double"))
    a = p.groupBy("frame").agg(
        F.percentile("_v", F.lit(0.5)).alias("gt_median"), F.percentile("_v", F.lit(0.95)).alias("gt_p95"), F.avg((F.col("_v") > far_m).cast("double")).alias("far_frac"),
        F.avg((g <= 0).cast("double")).alias("gt_hole_frac"),
        ((F.coalesce(F.avg("_jx"), F.lit(0.0)) + F.coalesce(F.avg("_jy"), F.lit(0.0))) / 2).alias("jump_density"), F.count("_v").alias("_n"))
    cols = ("gt_median", "gt_p95", "far_frac", "gt_hole_frac", "jump_density")
    return a.select("frame", *[F.when(F.col("_n") > 0, F.col(c)).otherwise(NAN).alias(c) for c in cols])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties; NaN under five rows or with a constant side."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(x, y)
    r = average_rank(average_rank(ok, x, "_rx"), y, "_ry")
    g = r.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    flat = (F.col("n") < 5) | (F.col("sx") <= 0) | (F.col("sy") <= 0)
    return g.select("n", F.when(flat, NAN).otherwise(F.col("c") / F.when(flat, 1.0).otherwise(F.col("sx") * F.col("sy"))).alias("rho"))


def hole_rows(px: DataFrame, band: int = 5, edge: float = 0.05, bright: float = 0.92, flat: float = 0.012, box: int = 7) -> DataFrame:
    """Per pixel: hole flag, nearest depth, near-edge band, bright and flat grey. Expects ``grey``, ``h``, ``w``."""
    p = px.withColumn("hole", ~(F.col("gt") > 0)).withColumn("d", F.col("gt"))
    p = R.fill_nearest(p, "d")
    p = SG.depth_edges(p, "d", edge, "near")
    p = R.dilate_cross(p, "near", band) if band <= 2 else _cross_ball(p, "near", band)
    p = R.box_std(p, "grey", box, "_sd")
    return p.withColumn("bright", F.col("grey") > bright).withColumn("flat", F.col("_sd") < flat)


def _cross_ball(px: DataFrame, mask: str, r: int) -> DataFrame:
    """r rounds of 4-neighbour dilation as one city-block distance test.

    Along x every pixel gets its distance to the row's nearest set pixel; along
    y the smallest ``|dy| + distance`` within r decides.
    """
    row = W.partitionBy("frame", "y")
    at = F.when(F.col(mask), F.col("x"))
    left = F.col("x") - F.last(at, ignorenulls=True).over(row.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    right = F.last(at, ignorenulls=True).over(row.orderBy(F.col("x").desc()).rowsBetween(W.unboundedPreceding, 0)) - F.col("x")
    p = px.withColumn("_dx", F.least(left, right))
    up = F.min(F.col("_dx") - F.col("y")).over(R.line("y").rangeBetween(-r, 0)) + F.col("y")
    down = F.min(F.col("_dx") + F.col("y")).over(R.line("y").rangeBetween(0, r)) - F.col("y")
    return p.withColumn(mask, F.coalesce(F.least(up, down) <= r, F.lit(False))).drop("_dx")


def hole_statistics(rows: DataFrame) -> DataFrame:
    """One row: invalid share percentiles and where the holes are, averaged over frames with holes."""
    n = F.count_if("hole")
    f = rows.groupBy("frame").agg(F.avg(F.col("hole").cast("double")).alias("inv"), n.alias("n"), *[
        (F.count_if(F.col("hole") & F.col(c)) / F.when(n > 0, n)).alias(c) for c in ("near", "bright", "flat")], F.avg(F.col("near").cast("double")).alias("area"))
    q = quantiles(f, [], "inv", [0.1, 0.5, 0.9], ["inv_p10", "inv_p50", "inv_p90"]).withColumn("_o", F.lit(1))
    has = (F.col("n") > 0)
    m = f.agg(F.avg("inv").alias("inv_mean"), *[F.avg(F.when(has, F.col(c))).alias(c) for c in ("near", "bright", "flat", "area")]).withColumn("_o", F.lit(1))
    return m.join(q, "_o").drop("_o")


def hole_rate_by_depth(rows: DataFrame) -> DataFrame:
    """Share of holes by the nearest measured depth."""
    edges = [*HOLE_BINS, float("inf")]
    b = F.coalesce(*[F.when((F.col("d") >= lo) & (F.col("d") < hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    g = rows.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count_if("hole").alias("holes"), F.count(F.lit(1)).alias("pixels"))
    return g.withColumn("rate", F.col("holes") / F.greatest("pixels", F.lit(1)))


def severity_ratio(augmented: DataFrame, real: DataFrame) -> DataFrame:
    """Mean invalid share of augmented inputs over that of real frames, per severity."""
    r = real.agg(F.avg("invalid").alias("real")).withColumn("_o", F.lit(1))
    a = augmented.groupBy("severity").agg(F.avg("invalid").alias("invalid")).withColumn("_o", F.lit(1))
    return a.join(r, "_o").select("severity", "invalid", (F.col("invalid") / F.greatest("real", F.lit(1e-9))).alias("ratio"))


def share_histogram(rows: DataFrame, share: str, edges: Sequence[float] = SHARE_EDGES) -> DataFrame:
    """Counts per bin; the last bin is closed."""
    last = len(edges) - 2
    b = F.coalesce(*[F.when((F.col(share) >= lo) & ((F.col(share) < hi) if i < last else (F.col(share) <= hi)), F.lit(i))
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    return rows.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(rows: DataFrame, share: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows below each threshold of a short list: one pass, one counter per threshold."""
    cols = [F.count_if(F.col(share) < t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    one = rows.agg(*cols, F.count(F.lit(1)).alias("_n"))
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])
    return one.select(F.explode(arr).alias("r"), "_n").select("r.threshold", "r.n", (F.col("r.n") / F.greatest("_n", F.lit(1))).alias("share"))


def confusion(df: DataFrame, label: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Counts per (label, prediction) with the class's IoU and the overall accuracy."""
    c = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    # classes x classes rows are left: the sums are tiny windows
    row, col = F.sum("n").over(W.partitionBy("label")), F.sum("n").over(W.partitionBy("pred"))
    d = c.withColumn("_r", row).withColumn("_c", col).withColumn("_all", F.sum("n").over(W.partitionBy(F.lit(1))))
    d = d.withColumn("_ok", F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).over(W.partitionBy(F.lit(1))))
    iou = F.when(F.col("label") == F.col("pred"), F.col("n") / F.greatest(F.col("_r") + F.col("_c") - F.col("n"), F.lit(1)))
    return d.select("label", "pred", "n", iou.alias("iou"), (F.col("_ok") / F.col("_all")).alias("accuracy"))


def spread(df: DataFrame, params: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[(F.max(p) - F.min(p)).alias(p) for p in params])


def linear_fits(df: DataFrame, x: str, y: str, within: float = 0.005) -> DataFrame:
    """``y ~ x``, ``1/y ~ x`` and ``y ~ 1/x``: slope, intercept, R2, RMS and share within a distance, in ``y``."""
    v = F.array(*[F.struct(F.lit(n).alias("fit"), a.alias("u"), b.alias("v")) for n, a, b in (
        ("direct", F.col(x), F.col(y)), ("inverse_y", F.col(x), 1.0 / F.col(y)), ("inverse_x", 1.0 / F.col(x), F.col(y)))])
    e = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.col(y).alias("_y"), F.explode(v).alias("s")).select("_y", "s.*")
    c = e.groupBy("fit").agg(F.regr_slope("v", "u").alias("slope"), F.regr_intercept("v", "u").alias("intercept"), F.regr_r2("v", "u").alias("r2"))
    est = F.col("slope") * F.col("u") + F.col("intercept")
    est = F.when(F.col("fit") == "inverse_y", 1.0 / F.when(est != 0, est)).otherwise(est)
    r = e.join(F.broadcast(c), "fit").withColumn("_e", est - F.col("_y"))
    return r.groupBy("fit").agg(*[F.first(k).alias(k) for k in ("slope", "intercept", "r2")], F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"),
                                F.avg((F.abs("_e") <= within).cast("double")).alias("within"))


def affine_per_segment(px: DataFrame, x: str, y: str, valid: Column, min_pixels: int = 10) -> DataFrame:
    """``y = s x + t`` per ``(frame, label)``; small or degenerate segments take the frame's fit.

    One aggregate of sums per segment; the frame's fit adds the same sums up.
    """
    n = F.when(valid, 1).otherwise(0)
    w = lambda e: F.coalesce(F.sum(F.when(valid, e)), F.lit(0.0))
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    s = px.groupBy("frame", "label").agg(F.sum(n).alias("n"), w(xs).alias("sx"), w(ys).alias("sy"), w(xs * xs).alias("sxx"), w(xs * ys).alias("sxy"))
    g = s.groupBy("frame").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])

    def fit(d: DataFrame) -> DataFrame:
        k = F.greatest(F.col("n").cast("double"), F.lit(1.0))
        d = d.withColumn("mx", F.col("sx") / k).withColumn("my", F.col("sy") / k)
        d = d.withColumn("den", F.col("sxx") - F.col("n") * F.col("mx") * F.col("mx"))
        sl = F.when(F.abs("den") > 1e-8, (F.col("sxy") - F.col("n") * F.col("mx") * F.col("my")) / F.when(F.abs("den") > 1e-8, F.col("den")).otherwise(1.0))
        return d.withColumn("s", sl).withColumn("t", F.col("my") - F.col("s") * F.col("mx"))

    gf = fit(g).select("frame", F.coalesce("s", F.lit(0.0)).alias("gs"), F.when(F.col("s").isNull(), F.col("my")).otherwise(F.col("t")).alias("gt_"), F.col("n").alias("gn"))
    own = (F.col("n") >= min_pixels) & F.col("s").isNotNull()
    return fit(s).join(gf, "frame").select("frame", "label", "n", "gn", F.when(own, F.col("s")).otherwise(F.col("gs")).alias("s"), F.when(own, F.col("t")).otherwise(F.col("gt_")).alias("t"))


def median_ratio(px: DataFrame, valid: Column, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Median of prediction over truth per frame: a scale bias shows as a value off 1."""
    return px.where(valid).groupBy(*by).agg(F.percentile(F.col("pred") / F.col("gt"), F.lit(0.5)).alias("ratio"))


def display_range(df: DataFrame, by: Sequence[str], value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    return quantiles(df, list(by), value, [lo, hi], ["lo", "hi"])
