"""Unit decoding and geometry of raw frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.augment import rectangles_to_pixels
from gridspark.operators.projection import require


def unit_decode(raw: Column, unit_per_m: Column) -> Column:
    return raw.cast("double") / unit_per_m


def range_decode(raw: Column, lo_mm: Column, hi_mm: Column) -> Column:
    """8-bit value to metres inside the frame's range; 0 stays 0."""
    return F.when(raw > 0, (lo_mm + raw / 255.0 * (hi_mm - lo_mm)) / 1000.0).otherwise(F.lit(0.0))


def minmax_denormalise(px: DataFrame, ranges: DataFrame, value: str = "d", key: str = "frame") -> DataFrame:
    """Back to metres with each frame's min and max; a frame without them fails the job."""
    j = px.join(ranges, key, "left")
    j = require(j, F.col("lo").isNotNull() & F.col("hi").isNotNull(), "no min/max for a frame")
    return j.withColumn(value, F.col(value) * (F.col("hi") - F.col("lo")) + F.col("lo")).drop("lo", "hi")


def zones_to_sparse(zones: DataFrame, whole_area: bool = False) -> DataFrame:
    """Zone rectangles ``y0..x1`` (half open) with ``mean`` to pixels; the later zone wins."""
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.col(n)).cast("int")
    if whole_area:
        r = zones.select("frame", "zone", "mean", clip(F.col("y0"), "h").alias("fy0"), clip(F.col("y1"), "h").alias("fy1"),
                         clip(F.col("x0"), "w").alias("fx0"), clip(F.col("x1"), "w").alias("fx1"))
        return rectangles_to_pixels(r, ["zone"], "mean")
    cy = F.least(F.greatest(F.floor((F.col("y0") + F.col("y1")) / 2), F.lit(0)), F.col("h") - 1).cast("int")
    cx = F.least(F.greatest(F.floor((F.col("x0") + F.col("x1")) / 2), F.lit(0)), F.col("w") - 1).cast("int")
    return zones.groupBy("frame", cy.alias("y"), cx.alias("x")).agg(F.max_by("mean", "zone").alias("z"))
