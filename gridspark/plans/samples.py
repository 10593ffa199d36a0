"""From raw inputs to the sample contract: pick or derive both inputs, masks and provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import projection as P
from gridspark.operators import raster as R

PIX = ["frame", "y", "x"]


def build_samples(px: DataFrame, lo: float, hi: float, model: Callable[[DataFrame], DataFrame] | None = None, simulate_from: str | None = None,
                  force: bool = False, lr_scale: int = 4, has_sparse: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(samples, lr)`` from ``frame, y, x, h, w, gt`` and optional ``sparse`` and ``m``.

    ``simulate_from`` replaces the native input by ``model`` applied to the
    ground truth or to the sensor's own map; ``sensor_mask`` remembers where the
    real sensor measured. The low-resolution input is a nearest-filled,
    nearest-sampled copy of the sparse one.
    """
    if simulate_from not in (None, "gt", "sensor"):
        raise ValueError(f"unknown simulate_from {simulate_from!r}")
    native = has_sparse and "sparse" in px.columns and not force
    if simulate_from == "sensor" and not native:
        raise ValueError("simulate_from='sensor' but there is no sensor input")
    s = px.withColumn("sensor_mask", P.clean_nonfinite(F.col("sparse")) > 0) if native else px.withColumn("sensor_mask", F.lit(None).cast("boolean"))
    if simulate_from or not native:
        if model is None:
            raise ValueError("no input and no sensor model")
        truth = F.col("gt")
        source = F.col("sparse") if simulate_from == "sensor" else truth
        out = model(s.withColumn("_truth", truth).withColumn("gt", source))
        s = out.withColumn("sparse", F.col("z")).withColumn("gt", F.col("_truth")).drop("z", "_truth")
    mask = P.gt_valid(F.col("gt"), lo, hi, F.col("m") if "m" in px.columns else None)
    s = s.withColumn("sparse", P.clean_nonfinite(F.col("sparse"))).withColumn("gt", P.clean_nonfinite(F.col("gt")))
    s = s.withColumn("mask", mask).withColumn("sparse_mask", F.col("sparse") > 0).withColumn("simulated_from", F.lit(simulate_from))
    s = s.withColumn("input_modality", F.lit("sparse" if native and not simulate_from else "synthetic"))
    filled = R.fill_nearest(s.select(*PIX, "h", "w", F.col("sparse").alias("lr")), "lr")
    if lr_scale > 1:
        filled = R.resize_nearest(filled, F.greatest(F.lit(1), F.floor(F.col("h") / lr_scale)), F.greatest(F.lit(1), F.floor(F.col("w") / lr_scale)))
    return s, filled.select(*PIX, "lr")
