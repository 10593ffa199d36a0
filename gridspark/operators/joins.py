"""Joins between frames, masks, metadata and result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.layouts import spread
from gridspark.operators.projection import require


def gate_masks(px: DataFrame, flags: DataFrame, mode: str = "all") -> DataFrame:
    """Zero the ``stairs``/``edge`` masks of frames whose flag is not true."""
    if mode not in ("all", "edge", "none"):
        raise ValueError(f"unknown gate mode {mode!r}")
    if mode == "none":
        return px
    ok = F.coalesce(F.col("flag"), F.lit(False))
    out = px.join(flags, "frame", "left").withColumn("edge", F.col("edge") & ok)
    if mode == "all":
        out = out.withColumn("stairs", F.col("stairs") & ok)
    return out.drop("flag")


def pair_checked(left: DataFrame, right: DataFrame, stem: Column) -> DataFrame:
    """1:1 pairing on a case-insensitive stem; anything unmatched fails the job."""
    a = left.select(F.lower(stem).alias("stem"), F.col("path").alias("left_path"))
    b = right.select(F.lower(stem).alias("stem"), F.col("path").alias("right_path"))
    both = a.join(b, "stem", "full")
    return require(both, F.col("left_path").isNotNull() & F.col("right_path").isNotNull(), "unmatched file in a pair")


def keep_split(records: DataFrame, split: DataFrame, key: str = "sample_id", strict: bool = True) -> DataFrame:
    """Rows named by the split with their list position; a named row that is absent is an error."""
    j = split.join(records.withColumn("_here", F.lit(True)), key, "left")
    if strict:
        j = require(j, F.col("_here"), "split names a sample that is not on disk")
    else:
        j = j.where(F.col("_here"))
    return j.drop("_here")


def missing_ids(wanted: DataFrame, records: DataFrame, key: str = "sample_id") -> DataFrame:
    return wanted.join(records, key, "left_anti")


def suffix_match(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Match each listed path to a record by path suffix, the longest suffix first."""
    parts = F.split("line", "/")
    tails = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, k + 1, F.size(parts) - k), "/").alias("tail")))
    sfx = lines.select("line", F.explode(tails).alias("t")).select("line", "t.k", "t.tail")
    hit = sfx.join(records.select(F.col("path").alias("tail"), "sample_id"), "tail")
    return hit.groupBy("line").agg(F.min_by("sample_id", F.struct("k", "sample_id")).alias("sample_id"))


def camera_lookup(px: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """Attach camera parameters; a frame without a camera fails the job."""
    j = px.join(cameras.withColumn("_cam", F.lit(True)), key, "left")
    return require(j, F.col("_cam"), "no camera parameters").drop("_cam")


def mask_to_frame(px: DataFrame, masks: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Attach cached class masks; the cached size must equal the frame size."""
    j = px.join(spread(masks.withColumnsRenamed({"h": "_mh", "w": "_mw"})), [*by, "y", "x"], "left")
    ok = F.col("_mh").isNotNull() & (F.col("_mh") == F.col("h")) & (F.col("_mw") == F.col("w"))
    return require(j, ok, "stale or missing mask").drop("_mh", "_mw")


def best_by_pixel_agreement(probe: DataFrame, candidates: DataFrame) -> DataFrame:
    """Compare one probe frame with every candidate frame, pixel by pixel.

    The probe is one frame, joined on the pixel; how is left to the optimizer.
    """
    p = probe.select("y", "x", F.col("z").alias("pz"))
    j = candidates.join(p, ["y", "x"])
    both = (F.col("z") > 0) & (F.col("pz") > 0)
    either = (F.col("z") > 0) | (F.col("pz") > 0)
    return j.groupBy("frame").agg(
        F.avg((F.col("z") == F.col("pz")).cast("double")).alias("equal_share"),
        F.avg(F.when(both, F.abs(F.col("z") - F.col("pz")))).alias("mean_abs"),
        (F.count_if(both) / F.greatest(F.count_if(either), F.lit(1))).alias("iou"))


def points_to_segments(px: DataFrame, segments: DataFrame, radius: float, tile: int = 16) -> DataFrame:
    """Distance from pixels to the segments within ``radius``.

    Segments are bucketed by the tiles of their grown bounding box, so a pixel
    meets only the segments near it.
    """
    r = F.lit(float(radius))

    def tiles(a: str, b: str) -> Column:
        lo = F.floor((F.least(a, b) - r) / tile)
        hi = F.floor((F.greatest(a, b) + r) / tile)
        return F.sequence(lo, hi)

    seg = segments.withColumn("_ty", F.explode(tiles("y1", "y2"))).withColumn("_tx", F.explode(tiles("x1", "x2")))
    p = px.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
    j = p.join(seg, ["frame", "_ty", "_tx"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.greatest(len2, F.lit(1e-12))).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    d = F.hypot(F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy)
    return j.withColumn("d", d).where(F.col("d") <= r).drop("_ty", "_tx")
