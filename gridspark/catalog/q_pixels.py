"""Pixel rules and per-frame metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import P8, P64, frames8, pixels8, pixels64
from gridspark.catalog.registry import register
from gridspark.functions.keyed import epoch_seed, uniform
from gridspark.operators import metrics as M
from gridspark.operators import projection as P
from gridspark.catalog.fixtures import u_sql

CFG = M.MetricConfig(min_depth=0.1, max_depth=3.5)

SCORED = P8 + """, sc AS (
  SELECT frame, grp, y, x, gt AS g, least(greatest(pred, 0.1::DOUBLE), 3.5::DOUBLE) AS p, cls, conf, e, e2,
         (gt > 0.1 AND gt < 3.5) AS valid FROM pix)"""

AGGS = """
  coalesce(avg(abs(p-g)/greatest(g,1e-6)) FILTER (valid), 'nan'::DOUBLE) AS absrel,
  coalesce(avg((p-g)*(p-g)/greatest(g,1e-6)) FILTER (valid), 'nan'::DOUBLE) AS sqrel,
  coalesce(sqrt(avg((p-g)*(p-g)) FILTER (valid)), 'nan'::DOUBLE) AS rmse,
  coalesce(avg(abs(p-g)) FILTER (valid), 'nan'::DOUBLE) AS mae,
  coalesce(sqrt(avg(pow(ln(p)-ln(g),2)) FILTER (valid)), 'nan'::DOUBLE) AS rmse_log,
  coalesce(100.0*sqrt(greatest(avg(pow(ln(p)-ln(g),2)) FILTER (valid)
     - pow(avg(ln(p)-ln(g)) FILTER (valid),2), 0.0::DOUBLE)), 'nan'::DOUBLE) AS silog,
  coalesce(avg((greatest(p/g,g/p) < 1.25)::INT) FILTER (valid), 'nan'::DOUBLE) AS delta1,
  coalesce(avg((greatest(p/g,g/p) < 1.5625)::INT) FILTER (valid), 'nan'::DOUBLE) AS delta2,
  coalesce(avg((greatest(p/g,g/p) < 1.953125)::INT) FILTER (valid), 'nan'::DOUBLE) AS delta3"""
MET = " ".join(M.METRICS)


@register("gt_validity", "PRJ-01", f"WITH {P8} SELECT frame, y, x, (gt > 0.1 AND gt < 3.5) AS valid FROM pix")
def _(spark, sf):
    return pixels8(spark, sf).select("frame", "y", "x", P.gt_valid(F.col("gt"), 0.1, 3.5).alias("valid"))


@register("gt_validity_masked", "PRJ-02",
          f"WITH {P8} SELECT frame, count(*) FILTER (gt > 0.1 AND gt < 3.5 AND coalesce(CASE WHEN cls = 0 THEN NULL ELSE cls = 1 END, true)) AS n_valid FROM pix GROUP BY frame")
def _(spark, sf):
    mask = F.when(F.col("cls") != 0, F.col("cls") == 1)
    return pixels8(spark, sf).groupBy("frame").agg(
        F.count_if(P.gt_valid(F.col("gt"), 0.1, 3.5, mask)).alias("n_valid"))


def _dirty(spark, sf):
    """Depth with non-finite and negative values where the class says so."""
    z = (F.when(F.col("cls") == 2, F.lit(float("nan"))).when(F.col("conf") > 0.9, F.lit(float("inf")))
         .when((F.col("cls") == 1) & (F.col("conf") > 0.8), -F.col("gt")).otherwise(F.col("gt")))
    return pixels8(spark, sf).withColumn("z", z)


DIRTY = P8 + """, dirty AS (SELECT *, CASE WHEN cls = 2 THEN 'nan'::DOUBLE WHEN conf > 0.9 THEN 'inf'::DOUBLE
  WHEN cls = 1 AND conf > 0.8 THEN -gt ELSE gt END AS z FROM pix)"""


@register("nonfinite_to_zero", "PRJ-03", f"""WITH {DIRTY} SELECT frame, y, x,
  CASE WHEN isnan(z) OR isinf(z) THEN 0.0 ELSE z END AS z_loader,
  CASE WHEN isnan(z) OR isinf(z) OR z < 0 THEN 0.0 ELSE z END AS z_degraded FROM dirty""", "z_loader z_degraded")
def _(spark, sf):
    z = F.col("z")
    return _dirty(spark, sf).select("frame", "y", "x", P.clean_nonfinite(z).alias("z_loader"),
                                    P.clean_nonfinite(z, True).alias("z_degraded"))


@register("prediction_clamp", "PRJ-04", f"""WITH {DIRTY} SELECT frame, y, x,
  CASE WHEN isnan(z) THEN 3.5 ELSE least(greatest(z, 0.1::DOUBLE), 3.5::DOUBLE) END AS p,
  NOT (isnan(z) OR isinf(z)) AS kept_unclamped FROM dirty""", "p")
def _(spark, sf):
    return _dirty(spark, sf).select("frame", "y", "x", P.clamp_pred(F.col("z"), 0.1, 3.5).alias("p"),
                                    P.finite(F.col("z")).alias("kept_unclamped"))


@register("crop_border6", "PRJ-05", f"""WITH {P64}, sz AS (SELECT frame, max(y)+1 AS h, max(x)+1 AS w FROM pix GROUP BY frame)
  SELECT frame, count(*) AS n, sum(gt) AS total FROM pix JOIN sz USING (frame)
  WHERE y BETWEEN 6 AND h-7 AND x BETWEEN 6 AND w-7 GROUP BY frame""", "total")
def _(spark, sf):
    from gridspark.layouts import with_size
    return P.crop(with_size(pixels64(spark, sf)), "border6").groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gt").alias("total"))


@register("crop_eigen", "PRJ-05", f"""WITH {P64}, sz AS (SELECT frame, max(y)+1 AS h, max(x)+1 AS w FROM pix GROUP BY frame),
  g AS (SELECT frame, y.y, x.x, (y.y * h) // 480 AS sy, (x.x * w) // 640 AS sx FROM sz, (SELECT unnest(range(480)) AS y) y, (SELECT unnest(range(640)) AS x) x)
  SELECT g.frame, count(*) AS n, sum(pix.gt) AS total, min(g.y) AS y_min, max(g.x) AS x_max FROM g JOIN pix ON pix.frame = g.frame AND pix.y = g.sy AND pix.x = g.sx
  WHERE g.y BETWEEN 45 AND 470 AND g.x BETWEEN 41 AND 600 GROUP BY g.frame""", "total")
def _(spark, sf):
    from gridspark.layouts import with_size
    from gridspark.operators.raster import resize_nearest
    whole = resize_nearest(with_size(pixels64(spark, sf)), F.lit(480), F.lit(640))
    return P.crop(whole, "eigen").groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gt").alias("total"), F.min("y").alias("y_min"), F.max("x").alias("x_max"))


@register("crop_modulo", "PRJ-06", f"""WITH {P64}, sz AS (SELECT frame, max(y)+1 AS h, max(x)+1 AS w FROM pix GROUP BY frame)
  SELECT frame, count(*) AS n, max(y) AS y_max, max(x) AS x_max FROM pix JOIN sz USING (frame)
  WHERE y < h - h % 24 AND x < w - w % 24 GROUP BY frame""")
def _(spark, sf):
    from gridspark.layouts import with_size
    return P.modulo_crop(with_size(pixels64(spark, sf)), 24).groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("y_max"), F.max("x").alias("x_max"))


@register("crop_rectangle", "PRJ-07", f"WITH {P8} SELECT frame, y-2 AS y, x-1 AS x, gt FROM pix WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 7", "gt")
def _(spark, sf):
    return P.rect_crop(pixels8(spark, sf), 2, 6, 1, 7).select("frame", "y", "x", "gt")


@register("sensor_mask_kept", "PRJ-08", f"""WITH {P8} SELECT frame, count(*) FILTER (gt > 0) AS n_sensor,
  count(*) FILTER (gt > 0 AND conf < 0.8) AS n_input FROM pix GROUP BY frame""")
def _(spark, sf):
    px = pixels8(spark, sf).withColumn("sensor_mask", F.col("gt") > 0)
    px = px.withColumn("input", F.when(F.col("conf") < 0.8, F.col("gt")).otherwise(0.0))
    return px.groupBy("frame").agg(F.count_if("sensor_mask").alias("n_sensor"),
                                   F.count_if(F.col("input") > 0).alias("n_input"))


@register("sparsity", "PRJ-09", f"WITH {P8} SELECT frame, 1 - avg((gt > 0)::INT) AS sparsity FROM pix GROUP BY frame", "sparsity")
def _(spark, sf):
    return pixels8(spark, sf).groupBy("frame").agg((1 - F.avg((F.col("gt") > 0).cast("int"))).alias("sparsity"))


@register("unit_guards", "PRJ-10", f"""WITH {P8} SELECT frame, max(conf) AS rgb_max, max(pred) AS depth_max, count(*) AS n
  FROM pix GROUP BY frame HAVING max(conf) <= 1.5 AND max(pred) < 1000""", "rgb_max depth_max")
def _(spark, sf):
    g = pixels8(spark, sf).groupBy("frame").agg(
        F.max("conf").alias("rgb_max"), F.max("pred").alias("depth_max"), F.count(F.lit(1)).alias("n"))
    g = P.require(g, F.col("rgb_max") <= 1.5, "rgb is not in [0, 1]")
    return P.require(g, F.col("depth_max") < 1000, "depth is not in metres")


@register("contract_validation", "PRJ-11", f"""WITH {P8}, s AS (SELECT frame, grp, count(*) AS n, max(conf) AS rgb_max,
   count(*) FILTER (cls = 1 AND NOT gt > 0) AS bad FROM pix GROUP BY frame, grp)
  SELECT frame, r.rule AS rule, r.ok AS ok FROM (SELECT frame, unnest([
   {{'rule': 'gt_shape', 'ok': n = 64}}, {{'rule': 'sparse_shape', 'ok': n = 64}}, {{'rule': 'mask_shape', 'ok': n = 64}},
   {{'rule': 'rgb_range', 'ok': rgb_max <= 1.5}}, {{'rule': 'gt_finite', 'ok': true}}, {{'rule': 'gt_nonnegative', 'ok': true}},
   {{'rule': 'mask_matches_gt', 'ok': bad = 0}}, {{'rule': 'window_ordered', 'ok': true}},
   {{'rule': 'unit_known', 'ok': grp % 3 <> 0}}]) AS r FROM s)""")
def _(spark, sf):
    from gridspark.layouts import pixels_to_frames
    px = pixels8(spark, sf).withColumn("mask", F.col("cls") == 1).withColumn("sparse", F.col("gt"))
    fr = pixels_to_frames(px, ["gt", "sparse", "mask", "conf"], ["frame", "grp"])
    fr = fr.withColumn("rgb_max", F.array_max("conf")).withColumn("lo", F.lit(0.1)).withColumn("hi", F.lit(10.0))
    return P.sample_rules(fr.withColumn("unit", F.when(F.col("grp") % 3 != 0, 1000.0)))


@register("wide_range_frames", "PRJ-12", f"WITH {P8} SELECT frame, max(gt) - min(gt) FILTER (gt > 0) AS span FROM pix GROUP BY frame HAVING max(gt) - min(gt) FILTER (gt > 0) > 1.6", "span")
def _(spark, sf):
    r = pixels8(spark, sf).where("gt > 0").groupBy("frame").agg((F.max("gt") - F.min("gt")).alias("span"))
    return r.where(F.col("span") > 1.6)


@register("degenerate_range_guard", "PRJ-19", f"""WITH {P8}, mm AS (SELECT frame, min(gt) FILTER (gt > 0) AS lo, max(gt) AS hi FROM pix WHERE cls = 2 GROUP BY frame)
  SELECT frame, CASE WHEN hi - lo < 0.01 OR lo IS NULL THEN 0.1 ELSE lo END AS lo, CASE WHEN hi - lo < 0.01 OR lo IS NULL THEN 10.0 ELSE hi END AS hi FROM mm""", "lo hi")
def _(spark, sf):
    mm = pixels8(spark, sf).where("cls = 2").groupBy("frame").agg(
        F.min(F.when(F.col("gt") > 0, F.col("gt"))).alias("lo"), F.max("gt").alias("hi"))
    bad = F.col("lo").isNull() | (F.col("hi") - F.col("lo") < 0.01)
    return mm.select("frame", F.when(bad, 0.1).otherwise(F.col("lo")).alias("lo"),
                     F.when(bad, 10.0).otherwise(F.col("hi")).alias("hi"))


@register("frame_minmax_normalise", "PRJ-20", f"""WITH {P8}, mm AS (SELECT frame, min(gt) AS lo, max(gt) AS hi FROM pix WHERE gt > 0 AND x % 2 = 0 AND y % 2 = 0 GROUP BY frame)
  SELECT frame, y, x, CASE WHEN gt > 0 AND hi - lo >= 1e-6 THEN least(greatest((gt - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0 END AS norm,
   CASE WHEN gt > 0 AND hi - lo >= 1e-6 THEN least(greatest((gt - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0 END * (hi - lo) + lo AS back
  FROM pix JOIN mm USING (frame)""", "norm back")
def _(spark, sf):
    px = pixels8(spark, sf)
    mm = px.where("gt > 0 and x % 2 = 0 and y % 2 = 0").groupBy("frame").agg(F.min("gt").alias("lo"), F.max("gt").alias("hi"))
    n = P.minmax_normalise(F.col("gt"), F.col("lo"), F.col("hi"))
    return px.join(mm, "frame").select("frame", "y", "x", n.alias("norm"),
                                       (n * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("back"))


@register("channel_standardise", "PRJ-21", f"WITH {P8} SELECT frame, y, x, (conf - 0.485) / 0.229 AS r, (conf - 0.456) / 0.224 AS g, (conf - 0.406) / 0.225 AS b FROM pix", "r g b")
def _(spark, sf):
    # Channel means and deviations of the usual image statistics.
    stats = {"r": (0.485, 0.229), "g": (0.456, 0.224), "b": (0.406, 0.225)}
    return pixels8(spark, sf).select("frame", "y", "x", *[((F.col("conf") - m) / s).alias(c) for c, (m, s) in stats.items()])


@register("seeded_flip", "PRJ-22 SMP-09", f"""WITH {P8} SELECT frame, y, CASE WHEN {u_sql("7919*3+11", "frame", "'flip'")} < 0.5 THEN w-1-x ELSE x END AS x, gt FROM pix""", "gt")
def _(spark, sf):
    u = uniform(epoch_seed(11, 3), F.col("frame"), "flip")
    return pixels8(spark, sf).select("frame", "y", F.when(u < 0.5, F.col("w") - 1 - F.col("x")).otherwise(F.col("x")).alias("x"), "gt")


@register("min_valid_pixels", "PRJ-23", f"""WITH {SCORED}, f AS (SELECT frame, count(*) FILTER (valid) AS n FROM sc GROUP BY frame)
  SELECT count(*) FILTER (n >= 57) AS kept, count(*) FILTER (n < 57) AS skipped FROM f""")
def _(spark, sf):
    s = M.scored(pixels8(spark, sf), CFG).groupBy("frame").agg(F.count_if("valid").alias("n"))
    return s.agg(F.count_if(F.col("n") >= 57).alias("kept"), F.count_if(F.col("n") < 57).alias("skipped"))


@register("stair_gate", "PRJ-24", f"""WITH {P8}, fl AS (SELECT doc_id AS frame, quality = 1 AS flag FROM labels)
  SELECT frame, count(*) FILTER (cls > 0 AND coalesce(flag, false)) AS stairs_all,
   count(*) FILTER (conf >= 0.8 AND coalesce(flag, false)) AS edge_gated, count(*) FILTER (cls > 0) AS stairs_none
  FROM pix LEFT JOIN fl USING (frame) GROUP BY frame""")
def _(spark, sf):
    from gridspark.catalog.fixtures import table
    from gridspark.operators.joins import gate_masks
    fl = table(spark, sf, "labels").select(F.col("doc_id").alias("frame"), (F.col("quality") == 1).alias("flag"))
    px = pixels8(spark, sf).withColumn("stairs", F.col("cls") > 0).withColumn("edge", F.col("conf") >= 0.8)
    out = gate_masks(px, fl, "all").groupBy("frame").agg(
        F.count_if("stairs").alias("stairs_all"), F.count_if("edge").alias("edge_gated"))
    none = gate_masks(px, fl, "none").groupBy("frame").agg(F.count_if("stairs").alias("stairs_none"))
    return out.join(none, "frame")


@register("window_fallback", "PRJ-25", f"""WITH {P8}, f AS (SELECT frame, min(gt) FILTER (gt > 0 AND cls = 2) AS m_lo, max(gt) FILTER (cls = 1) AS m_hi FROM pix GROUP BY frame)
  SELECT frame, coalesce(m_lo, 0.1) AS lo, coalesce(m_hi, 10.0) AS hi FROM f""", "lo hi")
def _(spark, sf):
    f = pixels8(spark, sf).groupBy("frame").agg(
        F.min(F.when((F.col("gt") > 0) & (F.col("cls") == 2), F.col("gt"))).alias("m_lo"),
        F.max(F.when(F.col("cls") == 1, F.col("gt"))).alias("m_hi"))
    return f.select("frame", F.coalesce("m_lo", F.lit(0.1)).alias("lo"), F.coalesce("m_hi", F.lit(10.0)).alias("hi"))


@register("frame_metrics", "AGG-01 AGG-02 AGG-03 AGG-04 AGG-05 AGG-06 AGG-07 AGG-08 AGG-09",
          f"WITH {SCORED} SELECT frame, {AGGS}, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid) / count(*)::DOUBLE AS valid_ratio FROM sc GROUP BY frame", MET + " valid_ratio")
def _(spark, sf):
    return M.per_frame(pixels8(spark, sf), CFG)


FRAME_ROWS = SCORED + f", fr AS (SELECT frame, {AGGS}, count(*) FILTER (valid) AS n_valid FROM sc GROUP BY frame)"


@register("image_pooling", "AGG-10 AGG-12", f"WITH {FRAME_ROWS} SELECT " + ", ".join(f"avg({m}) FILTER (n_valid >= 57) AS {m}" for m in M.METRICS)
          + ", count(*) FILTER (n_valid >= 57) AS n_samples, count(*) FILTER (n_valid < 57) AS n_skipped FROM fr", MET)
def _(spark, sf):
    cfg = M.MetricConfig(min_depth=0.1, max_depth=3.5, min_valid_pixels=57)
    return M.image_pool(M.per_frame(pixels8(spark, sf), cfg), cfg)


@register("pixel_pooling", "AGG-11", f"WITH {SCORED}, keep AS (SELECT frame FROM sc GROUP BY frame HAVING count(*) FILTER (valid) >= 57) SELECT {AGGS}, count(*) FILTER (valid) AS n_valid, count(DISTINCT frame) AS n_samples FROM sc SEMI JOIN keep USING (frame)", MET)
def _(spark, sf):
    return M.pixel_pool(pixels8(spark, sf), M.MetricConfig(min_depth=0.1, max_depth=3.5, min_valid_pixels=57))


@register("region_metrics", "AGG-13", f"""WITH {SCORED}, r AS (SELECT *, CASE WHEN conf < 0.7 THEN 'measured' ELSE 'holes' END AS region FROM sc)
  SELECT region, {AGGS}, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid) / sum(count(*) FILTER (valid)) OVER ()::DOUBLE AS share FROM r GROUP BY region""", MET + " share")
def _(spark, sf):
    from gridspark.plans.evaluate import region_metrics
    return region_metrics(pixels8(spark, sf), F.col("conf") < 0.7, CFG)


@register("zone_metrics", "AGG-14", f"""WITH {SCORED}, z AS (SELECT frame, g, p, q.zone AS zone, (valid AND q.inside) AS valid FROM (SELECT *, unnest([
   {{'zone': 'full', 'inside': true}}, {{'zone': 'stairs', 'inside': cls > 0}}, {{'zone': 'edge', 'inside': conf >= 0.8}}]) AS q FROM sc)),
  fr AS (SELECT frame, zone, {AGGS} FROM z GROUP BY frame, zone)
  SELECT zone, avg(absrel) FILTER (NOT isnan(absrel)) AS absrel, avg(rmse) FILTER (NOT isnan(rmse)) AS rmse, avg(delta1) FILTER (NOT isnan(delta1)) AS delta1,
   count(*) FILTER (NOT isnan(absrel)) AS n FROM fr GROUP BY zone""", "absrel rmse delta1")
def _(spark, sf):
    from gridspark.plans.evaluate import zone_summary
    rows = M.zone_rows(pixels8(spark, sf), {"full": F.lit(True), "stairs": F.col("cls") > 0, "edge": F.col("conf") >= 0.8}, CFG)
    return zone_summary(rows)


@register("worst_frames", "TOP-01", f"WITH {FRAME_ROWS} SELECT frame, absrel, rmse, delta1 FROM fr WHERE NOT isnan(absrel) ORDER BY absrel DESC, frame LIMIT 10", "absrel rmse delta1")
def _(spark, sf):
    return M.worst(M.per_frame(pixels8(spark, sf), CFG), "absrel", 10).select("frame", "absrel", "rmse", "delta1")


@register("worst_frames_by_delta", "TOP-01", f"WITH {FRAME_ROWS} SELECT frame, delta1 FROM fr WHERE NOT isnan(delta1) ORDER BY delta1, frame LIMIT 10", "delta1")
def _(spark, sf):
    return M.worst(M.per_frame(pixels8(spark, sf), CFG), "delta1", 10).select("frame", "delta1")


@register("validity_l1_l2", "RST-21", f"WITH {SCORED} SELECT frame, avg(abs(p-g)) FILTER (valid) AS l1, avg((p-g)*(p-g)) FILTER (valid) AS l2, avg(abs(p-g)) FILTER (valid) + avg((p-g)*(p-g)) FILTER (valid) AS total FROM sc GROUP BY frame", "l1 l2 total")
def _(spark, sf):
    s = M.scored(pixels8(spark, sf), CFG)
    d = F.when(F.col("valid"), F.col("p") - F.col("g"))
    return s.groupBy("frame").agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"),
                                  (F.avg(F.abs(d)) + F.avg(d * d)).alias("total"))


@register("relative_error_map", "SCL-26", f"WITH {P8} SELECT frame, y, x, (pred - gt) / greatest(gt, 1e-6) AS rel FROM pix WHERE gt > 0", "rel")
def _(spark, sf):
    return pixels8(spark, sf).where("gt > 0").select(
        "frame", "y", "x", ((F.col("pred") - F.col("gt")) / F.greatest("gt", F.lit(1e-6))).alias("rel"))


@register("frames_roundtrip", "SRC-18", f"WITH {P8} SELECT frame, x AS y, y AS x, gt FROM pix", "gt")
def _(spark, sf):
    from gridspark.layouts import frames_to_pixels
    return frames_to_pixels(frames8(spark, sf), ["gt"], ["frame"], column_major=True).select("frame", "y", "x", "gt")
