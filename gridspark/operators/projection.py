"""Row-wise rules on pixel and sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def gt_valid(gt: Column, lo: float, hi: float, mask: Column | None = None) -> Column:
    """Finite and strictly inside the window; an extra mask is ANDed in, absent counts as true."""
    ok = finite(gt) & (gt > lo) & (gt < hi)
    return ok if mask is None else ok & F.coalesce(mask, F.lit(True))


def clean_nonfinite(z: Column, zero_negative: bool = False) -> Column:
    bad = ~finite(z)
    return F.when(bad | (z < 0) if zero_negative else bad, F.lit(0.0)).otherwise(z)


def clamp_pred(p: Column, lo: float, hi: float) -> Column:
    """NaN and +inf go to ``hi``, -inf to ``lo``, the rest is clipped."""
    return F.when(F.isnan(p), F.lit(hi)).otherwise(F.least(F.greatest(p, F.lit(lo)), F.lit(hi)))


def crop(px: DataFrame, mode: str) -> DataFrame:
    """Evaluation crop; needs the grid size columns."""
    y, x = F.col("y"), F.col("x")
    if mode == "none":
        return px
    if mode == "border6":
        return px.where(y.between(6, F.col("h") - 7) & x.between(6, F.col("w") - 7))
    if mode == "eigen":
        # Rows 45..470 and columns 41..600 of a 480 x 640 frame.
        fits = F.when((F.col("h") == 480) & (F.col("w") == 640), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("eigen crop needs 480x640, got "), F.col("h").cast("string"),
                                   F.lit("x"), F.col("w").cast("string"))).cast("boolean"))
        return px.where(fits & y.between(45, 470) & x.between(41, 600))
    raise ValueError(f"unknown crop {mode!r}")


def modulo_crop(px: DataFrame, k: int = 16) -> DataFrame:
    return px.where((F.col("y") < F.col("h") - F.col("h") % k) & (F.col("x") < F.col("w") - F.col("w") % k))


def rect_crop(px: DataFrame, y0, y1, x0, x1) -> DataFrame:
    """Half-open rectangle, re-origined to (0, 0)."""
    y0, y1, x0, x1 = [c if isinstance(c, Column) else F.lit(c) for c in (y0, y1, x0, x1)]
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return px.where(inside).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def lenient_double(c: Column) -> Column:
    """Text to number; what does not parse or is not finite becomes NULL."""
    v = c.try_cast("double")
    return F.when(finite(v), v)


def minmax_normalise(z: Column, lo: Column, hi: Column, min_range: float = 1e-6) -> Column:
    """Map ``[lo, hi]`` to [0, 1]; holes (0) and degenerate ranges give 0."""
    span = hi - lo
    return F.when((z > 0) & (span >= min_range),
                  F.least(F.greatest((z - lo) / span, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def sample_rules(samples: DataFrame) -> DataFrame:
    """Contract check of packed samples as ``(frame, rule, ok)`` rows.

    Expects ``frame, h, w, gt, sparse, mask, rgb_max, unit, lo, hi``.
    """
    n = F.col("h") * F.col("w")
    rules = {
        "gt_shape": F.size("gt") == n,
        "sparse_shape": F.size("sparse") == n,
        "mask_shape": F.size("mask") == n,
        "rgb_range": F.col("rgb_max") <= 1.5,
        "gt_finite": ~F.exists("gt", lambda v: ~finite(v)),
        "gt_nonnegative": ~F.exists("gt", lambda v: v < 0),
        "mask_matches_gt": ~F.exists(F.arrays_zip("mask", "gt"), lambda t: t["mask"] & ~(t["gt"] > 0)),
        "window_ordered": (F.col("lo") >= 0) & (F.col("lo") < F.col("hi")),
        "unit_known": F.col("unit").isNotNull() & (F.col("unit") > 0),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])
    return samples.select("frame", F.explode(rows).alias("r")).select("frame", "r.rule", "r.ok")


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the job when a row breaks the rule."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.lit(message)).cast("boolean")))
