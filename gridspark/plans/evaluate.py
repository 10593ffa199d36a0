"""Evaluation plans: from pixels or frames with a predictor to summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.operators import metrics as M


def region_metrics(px: DataFrame, measured: Column, cfg: M.MetricConfig = M.MetricConfig()) -> DataFrame:
    """Pixel-pooled metrics inside and outside the sensor's holes with each region's share."""
    px = px.withColumn("region", F.when(measured, "measured").otherwise("holes"))
    rows = M.pixel_pool(px, cfg, by=["frame"], regions=["region"]).drop("n_samples")
    # two rows at this point, so the share over all of them is a tiny window
    return rows.withColumn("share", F.col("n_valid") / F.sum("n_valid").over(W.partitionBy(F.lit(1))))


def zone_summary(rows: DataFrame) -> DataFrame:
    """Image-pooled zone means; frames where a zone is empty do not count."""
    ok = ~F.isnan("absrel")
    return rows.groupBy("zone").agg(*[F.avg(F.when(ok, F.col(m))).alias(m) for m in ("absrel", "rmse", "delta1")],
                                    F.count_if(ok).alias("n"))


def reconstruction_error(px: DataFrame, weight: float = 0.1) -> DataFrame:
    """Absolute error plus weighted gradient error where the 3x3 window is fully measured."""
    from gridspark.operators import raster as R

    p = px.withColumn("_t", F.when(F.col("gt") > 0, F.col("gt")).otherwise(0.0)).withColumn("_ok", (F.col("gt") > 0).cast("int"))
    p = R.sobel(p, "pred").withColumnsRenamed({"gx": "_px", "gy": "_py"})
    p = R.sobel(p, "_t").withColumnsRenamed({"gx": "_tx", "gy": "_ty"})
    p = R.extreme_filter(p, F.col("_ok"), 3, "_full", "min")
    grad = F.abs(F.col("_px") - F.col("_tx")) + F.abs(F.col("_py") - F.col("_ty"))
    err = F.when(F.col("gt") > 0, F.abs(F.col("pred") - F.col("gt"))).otherwise(0.0) + F.when(F.col("_full") == 1, weight * grad).otherwise(0.0)
    return p.withColumn("err", err).drop("_t", "_ok", "_px", "_py", "_tx", "_ty", "_full")


def step_medians(errors: DataFrame) -> DataFrame:
    """Median over all frames and steps of each error, NaN ignored."""
    from gridspark.operators.ordering import quantiles

    names = ("rise_abs", "rise_rel", "run_abs", "run_rel")
    rows = errors.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in names])).alias("e")).select("e.*")
    q = quantiles(rows, ["what"], "v", [0.5], ["m"])
    return q.agg(*[F.max(F.when(F.col("what") == c, F.col("m"))).alias(c) for c in names])


def plane_quality(regions: DataFrame, cam) -> DataFrame:
    """Plane residuals and plane angles under each camera variant: median and 90th percentile.

    ``regions`` holds the largest few regions per frame: ``(frame, kind, label, y, x, gt)``.
    """
    from gridspark.operators import geometry as G
    from gridspark.operators.ordering import quantiles

    p = G.camera_sweep(regions, cam)
    planes = G.robust_planes(p, ["variant", "frame", "kind", "label"])
    ang = G.plane_angles(planes, ["variant", "frame"], "kind", "label").select("variant", F.col("pair").alias("what"), F.col("angle").alias("value"))
    tread = planes.where("kind = 'tread'")
    rms = tread.select("variant", F.lit("rms_mm").alias("what"), (F.col("rms") * 1000.0).alias("value"))
    rel = tread.select("variant", F.lit("rms_pct").alias("what"), (100.0 * F.col("rms") / F.col("mean_z")).alias("value"))
    return quantiles(ang.unionByName(rms).unionByName(rel), ["variant", "what"], "value", [0.5, 0.9], ["p50", "p90"])


def agreement(px: DataFrame, by, limits) -> DataFrame:
    """Mask overlap, shares within the limits and median difference of ``z`` and ``gt``."""
    from gridspark.operators.ordering import quantiles

    both, either = (F.col("gt") > 0) & (F.col("z") > 0), (F.col("gt") > 0) | (F.col("z") > 0)
    d = F.abs(F.col("z") - F.col("gt"))
    g = px.groupBy(*by).agg((F.count_if(both) / F.greatest(F.count_if(either), F.lit(1))).alias("iou"),
                            *[F.avg(F.when(both, (d <= lim).cast("double"))).alias(n) for n, lim in limits.items()])
    q = quantiles(px.where(both).select(*by, d.alias("_d")), list(by), "_d", [0.5], ["median_abs"])
    return g.join(q, list(by), "left")


def alignment_sweep(px: DataFrame, depth_cam, rotation, translation, colour_cam, distortion, size, limits) -> DataFrame:
    """Reproject under every direction x distortion x depth convention and compare with the reference map.

    The projected pixels come back as one row per target with a column for each of
    the eight variants, which meets the reference by a merge join and is dealt out after it.
    """
    from gridspark.layouts import spread
    from gridspark.operators import geometry as G

    p = G.with_points(px.where("gt > 0"), "gt", depth_cam)
    q = F.array(*[F.struct(F.lit(d).alias("direction"), *[c.alias(n) for n, c in zip(("qx", "qy", "qz"), G.rigid(rotation, translation, d))])
                  for d in ("d2c", "c2d")])
    p = p.select("frame", F.col("gt").alias("z0"), F.explode(q).alias("q")).select("frame", "z0", "q.*").where("qz > 1e-6")
    p = p.select("frame", "z0", "direction", "qz", F.explode(F.array(F.struct((F.col("qx") / F.col("qz")).alias("u"), (F.col("qy") / F.col("qz")).alias("v")))).alias("k"))
    xd, yd = G.distort(F.col("k.u"), F.col("k.v"), distortion)
    uv = F.array(F.struct(F.lit(False).alias("use_dist"), F.col("k.u").alias("u"), F.col("k.v").alias("v")),
                 F.struct(F.lit(True).alias("use_dist"), xd.alias("u"), yd.alias("v")))
    p = p.select("frame", "z0", "direction", "qz", F.explode(uv).alias("t"))
    fx, fy, cx, cy = colour_cam
    h, w = size
    p = p.select("frame", "z0", "direction", "qz", F.col("t.use_dist").alias("use_dist"), F.rint(fx * F.col("t.u") + cx).alias("_x"), F.rint(fy * F.col("t.v") + cy).alias("_y"))
    p = p.where((F.col("_x") >= 0) & (F.col("_x") < w) & (F.col("_y") >= 0) & (F.col("_y") < h))
    by = ["direction", "use_dist", "z_mode"]
    every = [(a, b, c) for a in ("d2c", "c2d") for b in (False, True) for c in ("color", "depth")]
    value = {"color": F.col("qz"), "depth": F.col("z0")}
    seen = p.groupBy("frame", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x")).agg(
        *[F.min(F.when((F.col("direction") == a) & (F.col("use_dist") == b), value[c])).alias(f"_z{i}") for i, (a, b, c) in enumerate(every)])
    variants = F.array(*[F.struct(F.lit(a).alias("direction"), F.lit(b).alias("use_dist"), F.lit(c).alias("z_mode"), F.coalesce(f"_z{i}", F.lit(0.0)).alias("z"))
                         for i, (a, b, c) in enumerate(every)])
    j = px.select("frame", "y", "x", "gt").join(spread(seen), ["frame", "y", "x"], "left").select("gt", F.explode(variants).alias("v")).select("gt", "v.*")
    return agreement(j, by, dict(zip(("within_1", "within_2", "within_5"), limits)))


def predict(frames: DataFrame, fn, modality: str = "sparse") -> DataFrame:
    """Run a user's predictor on packed frames in Arrow batches: adds ``pred``.

    ``fn(depth_in) -> (h, w)`` gets one frame's input; a wrong shape or a
    non-finite result fails the job.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    if modality not in ("sparse", "lr"):
        raise ValueError(f"unknown modality {modality!r}")
    schema = T.StructType([*[f for f in frames.schema.fields], T.StructField("pred", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            preds = []
            for h, w, d in zip(b["h"], b["w"], b[modality]):
                out = np.asarray(fn(np.asarray(d, dtype=float).reshape(h, w)), dtype=float)
                if out.shape != (h, w):
                    raise ValueError(f"predictor returned {out.shape}, expected {(h, w)}")
                if not np.isfinite(out).all():
                    raise ValueError("predictor returned non-finite depth")
                preds.append(out.ravel())
            yield b.assign(pred=pd.Series(preds, index=b.index))

    return frames.mapInPandas(run, schema)


def evaluate(px: DataFrame, cfg: M.MetricConfig, measured: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-sample rows and the summary row, with the sensor-hole split when ``measured`` is given."""
    rows = M.per_frame(px, cfg)
    summary = M.image_pool(rows, cfg).withColumn("_o", F.lit(1))
    if measured is not None:
        reg = region_metrics(px, measured, cfg)
        pick = lambda r, c: F.max(F.when(F.col("region") == r, F.col(c)))
        wide = reg.agg(F.coalesce(pick("holes", "share"), F.lit(0.0)).alias("holes_frac"), *[
            F.coalesce(pick(r, c), F.lit(float("nan"))).alias(f"{n}_{c}") for r, n in (("holes", "holes"), ("measured", "valid")) for c in ("absrel", "rmse", "delta1")])
        summary = summary.join(wide.withColumn("_o", F.lit(1)), "_o")
    return rows, summary.drop("_o")


def zone_document(runs: DataFrame) -> DataFrame:
    """Long zone metrics as one nested document per run and frame."""
    zones = ("full", "stairs", "edge")
    val = lambda z, m: F.max(F.when((F.col("zone") == z) & (F.col("metric") == m) & ~F.isnan("value"), F.col("value"))).alias(m)
    doc = F.struct(*[F.struct(*[val(z, m) for m in ("absrel", "rmse", "delta1")]).alias(z) for z in zones])
    return runs.groupBy("row_id", "frame").agg(doc.alias("doc"))


def zone_report(px: DataFrame, zones: dict[str, Column], cfg: M.MetricConfig, steps: DataFrame | None = None, missing: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents per frame, and the one document of the evaluation.

    Per frame: ``frame`` and a struct of absrel, rmse, delta1 for each zone. The document: per zone the
    averages over frames and ``n``, how many frames have the zone; ``n_frames``; ``input_invalid_frac``,
    the mean over frames of the share of ``missing`` pixels; ``step_*``, the medians of ``steps``
    (see ``geometry.step_geometry_error``) over all frames and steps. Without ``steps`` or
    ``missing`` their fields are null.
    """
    names = ("absrel", "rmse", "delta1")
    rows = M.zone_rows(px, zones, cfg)
    pick = lambda z, c: F.max(F.when(F.col("zone") == z, F.col(c)))
    frames = rows.groupBy("frame").agg(*[F.struct(*[pick(z, c).alias(c) for c in names]).alias(z) for z in zones])
    pooled = zone_summary(rows)
    out = pooled.agg(*[F.struct(*[pick(z, c).alias(c) for c in (*names, "n")]).alias(z) for z in zones])
    gap = F.avg(missing.cast("double")) if missing is not None else F.lit(None).cast("double")
    share = px.groupBy("frame").agg(gap.alias("_gap")).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("_gap").alias("input_invalid_frac"))
    out = out.join(share, F.lit(True))  # one row each
    kinds = ("rise_abs", "rise_rel", "run_abs", "run_rel")
    if steps is None:
        out = out.withColumns({f"step_{k}": F.lit(None).cast("double") for k in kinds})
    else:
        out = out.join(step_medians(steps).withColumnsRenamed({k: f"step_{k}" for k in kinds}), F.lit(True))
    return frames, out


def logged_evaluation(frames: DataFrame, fn, cfg: M.MetricConfig, leaves: dict[str, str], info: dict[str, str], measured: str | None = None, modality: str = "sparse") -> tuple[DataFrame, DataFrame]:
    """From a predictor to the rows per sample and the row of the results log, in one plan.

    ``frames``: packed, with ``gt``, the predictor's input and the flag array ``measured``. A frame
    whose input is null could not be read: it is left out and counted in ``n_unreadable``; if none is left
    the job fails. ``leaves``: the configuration as dotted paths, from which the row's hash is made.
    ``info``: dataset, split, method and what else the log has a column for.
    """
    import json
    from dataclasses import asdict

    from gridspark.functions.scalar import config_hash
    from gridspark.layouts import frames_to_pixels
    from gridspark.sources.sinks import SUMMARY_COLUMNS

    arrays = ["gt", modality, *([measured] if measured else [])]
    read = frames.where(F.col(modality).isNotNull())
    px = frames_to_pixels(predict(read, fn, modality), [*arrays, "pred"])
    rows, summary = evaluate(px, cfg, F.col(measured) if measured else None)
    counts = frames.agg(F.count(F.lit(1)).alias("_all"), F.count(modality).alias("_read"))
    bad = F.when((F.col("_read") == 0) & (F.col("_all") > 0), F.raise_error(F.lit("no sample could be read")).cast("bigint")).otherwise(F.col("_all") - F.col("_read"))
    known = F.create_map(*[F.lit(x) for kv in leaves.items() for x in kv])
    fixed = {**{k: F.lit(v) for k, v in info.items()}, "metric_config": F.lit(json.dumps(asdict(cfg), sort_keys=True)), "config_hash": config_hash(known)}
    row = counts.join(summary, F.lit(True)).withColumn("n_unreadable", bad).drop("_all", "_read").withColumns(fixed)
    return rows, row.select(*[c for c in SUMMARY_COLUMNS if c in row.columns])
