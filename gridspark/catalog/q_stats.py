"""Statistics, mask quality, worst cases and reference floors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import P8, P64, u_sql
from gridspark.catalog.q_augment import base8
from gridspark.catalog.q_geometry import CAM64, normals_sql, up_sql
from gridspark.catalog.q_pixels import CFG, FRAME_ROWS, SCORED
from gridspark.catalog.q_raster import SIZE, bicubic_w, gauss_w, sep, stencil
from gridspark.catalog.registry import register
from gridspark.layouts import with_size
from gridspark.operators import augment as A
from gridspark.operators import metrics as M
from gridspark.operators import ordering as O
from gridspark.operators import sampling as SM
from gridspark.operators import stats as ST
from gridspark.plans import quality as Q

ORG = f"""org AS (SELECT frame, k, floor({u_sql('9', 'frame', "'oy'", 'k')} * (h - 2))::INT AS oy, floor({u_sql('9', 'frame', "'ox'", 'k')} * (w - 2))::INT AS ox FROM (SELECT *, unnest(range(300)) AS k FROM sz)),
 pt AS (SELECT o.frame, o.k, quantile_cont(gt, 0.5) AS med, sqrt(greatest(var_pop(gt) - pow(covar_pop(gt, x - ox), 2) / var_pop(x - ox) - pow(covar_pop(gt, y - oy), 2) / var_pop(y - oy), 0.0::DOUBLE)) AS rms
   FROM org o JOIN pix p ON p.frame = o.frame AND p.y BETWEEN oy AND oy + 2 AND p.x BETWEEN ox AND ox + 2 GROUP BY o.frame, o.k HAVING count(*) FILTER (gt > 0.5 AND gt < 6) = 9 AND max(gt) - min(gt) < 0.35 * quantile_cont(gt, 0.5))"""


def _origins(px):
    s = px.groupBy("frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return SM.patch_origins(s, 300, 3, 9)


@register("flat_patch_noise", "AGG-19", f"WITH {P64}, {SIZE}, {ORG} SELECT frame, k::INT AS k, med, rms FROM pt", "med rms")
def _(spark, sf):
    px = X.pixels64(spark, sf)
    return ST.flat_patches(px, _origins(px), 0.5, 6.0, 3, 0.35)


STEPQ = "stq AS (SELECT frame, quantile_cont(g, 0.5) * 1000 AS step_mm FROM (SELECT frame, gt - lag(gt) OVER (PARTITION BY frame ORDER BY gt) AS g FROM (SELECT DISTINCT frame, gt FROM pix WHERE gt > 0.5 AND gt < 6)) GROUP BY frame)"


@register("quantisation_step", "AGG-18", f"WITH {P8}, {STEPQ} SELECT frame, step_mm FROM stq", "step_mm")
def _(spark, sf):
    return ST.step_mm(X.pixels8(spark, sf), 0.5, 6.0)


@register("ground_truth_audit", "AGG-17", f"""WITH {P64}, {SIZE}, {ORG.replace('0.35 *', '0.08 *')}, {STEPQ}, f AS (SELECT frame, avg((gt <= 0)::INT) AS h, avg((gt > 0.5 AND gt < 6)::INT) AS r FROM pix GROUP BY frame)
  SELECT (SELECT count(*) FROM f) AS frames, (SELECT 100 * avg(h) FROM f) AS holes_pct, (SELECT 100 * avg(r) FROM f) AS in_range_pct, (SELECT quantile_cont(step_mm, 0.5) FROM stq) AS step_mm, (SELECT count(*) FROM pt) AS patches,
   {", ".join(f"(SELECT CASE WHEN count(*) >= 3 THEN 1000 * quantile_cont(rms, 0.5) ELSE 'nan'::DOUBLE END FROM pt WHERE med >= {a} AND med < {b}) AS noise_mm_{i}" for i, (a, b) in enumerate(ST.AUDIT_BINS))}""", "holes_pct in_range_pct step_mm noise_mm_0 noise_mm_1 noise_mm_2")
def _(spark, sf):
    px = X.pixels64(spark, sf)
    return ST.audit(px, _origins(px), 0.5, 6.0, 3, 3)


COV = """cva AS (SELECT frame, quantile_cont(gt, 0.5) FILTER (ok) AS gt_median, quantile_cont(gt, 0.95) FILTER (ok) AS gt_p95, avg((gt > 2.4)::INT) FILTER (ok) AS far_frac, avg((gt <= 0)::INT) AS gt_hole_frac FROM (SELECT *, gt > 0.1 AND gt < 3.5 AS ok FROM pix) GROUP BY frame),
 cvj AS (SELECT a.frame, coalesce(avg((abs(a.gt - b.gt) / b.gt > 0.1)::INT) FILTER (a.y = b.y), 0) AS jx, coalesce(avg((abs(a.gt - b.gt) / b.gt > 0.1)::INT) FILTER (a.x = b.x), 0) AS jy FROM pix a JOIN pix b ON a.frame = b.frame AND ((a.y = b.y AND a.x = b.x + 1) OR (a.x = b.x AND a.y = b.y + 1)) WHERE a.gt > 0.1 AND a.gt < 3.5 AND b.gt > 0.1 AND b.gt < 3.5 GROUP BY a.frame),
 cov AS (SELECT cva.*, (coalesce(jx, 0) + coalesce(jy, 0)) / 2 AS jump_density FROM cva LEFT JOIN cvj USING (frame))"""
COLS = ("gt_median", "gt_p95", "far_frac", "gt_hole_frac", "jump_density")


def _cov(spark, sf):
    return ST.covariates(X.pixels8(spark, sf), 0.1, 3.5, 2.4)


@register("frame_covariates", "AGG-20", f"WITH {P8}, {COV} SELECT * FROM cov", " ".join(COLS))
def _(spark, sf):
    return _cov(spark, sf)


@register("error_covariate_join", "JOIN-25", f"WITH {FRAME_ROWS}, {COV} SELECT frame, absrel, gt_median, jump_density FROM fr JOIN cov USING (frame)", "absrel gt_median jump_density")
def _(spark, sf):
    return M.per_frame(X.pixels8(spark, sf), CFG).select("frame", "absrel").join(_cov(spark, sf).select("frame", "gt_median", "jump_density"), "frame")


def rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


@register("rank_correlation", "AGG-21", f"WITH {FRAME_ROWS}, {COV}, j AS (SELECT absrel, gt_hole_frac FROM fr JOIN cov USING (frame)), r AS (SELECT {rank_sql('gt_hole_frac')} AS a, {rank_sql('absrel')} AS b FROM j) SELECT count(*) AS n, corr(a, b) AS rho FROM r", "rho")
def _(spark, sf):
    j = M.per_frame(X.pixels8(spark, sf), CFG).select("frame", "absrel").join(_cov(spark, sf), "frame")
    return ST.spearman(j, "gt_hole_frac", "absrel")


@register("worst_case_report", "BMK-08", f"""WITH {FRAME_ROWS}, {COV}, t AS (SELECT frame, absrel, rmse, delta1, n_valid FROM fr WHERE NOT isnan(absrel) ORDER BY absrel DESC, frame LIMIT 8),
  x AS (SELECT frame, quantile_cont(pred / gt, 0.5) FILTER (gt > 0.1 AND gt < 3.5) AS ratio, count(*) FILTER (conf < 0.7) AS input_points FROM pix GROUP BY frame) SELECT * FROM t JOIN x USING (frame) JOIN cov USING (frame)""", "absrel rmse delta1 ratio " + " ".join(COLS))
def _(spark, sf):
    r = Q.worst_report(X.pixels8(spark, sf), CFG, "absrel", 8, F.col("conf") < 0.7)
    return r.drop(*COLS).join(_cov(spark, sf), "frame")


@register("error_correlations", "BMK-08", f"""WITH {FRAME_ROWS}, {COV}, j AS (SELECT round(absrel, 9) AS absrel, {", ".join(f"round({c}, 9) AS {c}" for c in COLS)} FROM fr JOIN cov USING (frame)), r AS (SELECT {rank_sql('absrel')} AS e, {", ".join(f"{rank_sql(c)} AS {c}" for c in COLS)} FROM j)
  """ + " UNION ALL ".join(f"SELECT '{c}' AS property, count(*) AS n, corr(e, {c}) AS rho FROM r" for c in COLS), "rho")
def _(spark, sf):
    # values that differ only by rounding noise must tie
    rows = M.per_frame(X.pixels8(spark, sf), CFG).withColumn("absrel", F.round("absrel", 9))
    cov = _cov(spark, sf).select("frame", *[F.round(c, 9).alias(c) for c in COLS])
    return Q.error_correlations(rows, cov, "absrel", COLS)


@register("median_scale_ratio", "AGG-41", f"WITH {P8} SELECT frame, quantile_cont(pred / gt, 0.5) AS ratio FROM pix WHERE gt > 0.1 GROUP BY frame", "ratio")
def _(spark, sf):
    return ST.median_ratio(X.pixels8(spark, sf), F.col("gt") > 0.1)


HOLE = f"""nf AS (SELECT a.frame, a.y, a.x, a.gt, a.conf, CASE WHEN a.gt > 0 THEN a.gt ELSE coalesce(arg_min(b.gt, ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x), 0) END AS d FROM pix a LEFT JOIN pix b ON a.frame = b.frame AND b.gt > 0 GROUP BY a.frame, a.y, a.x, a.gt, a.conf),
 ed AS (SELECT p.frame, p.y, p.x, bool_or(p.d > 0 AND q.d > 0 AND abs(p.d - q.d) > 0.3 * greatest(p.d, q.d, 1e-6)) AS edge FROM nf p JOIN nf q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY ALL),
 nr AS (SELECT p.frame, p.y, p.x, bool_or(q.edge) AS near FROM ed p JOIN ed q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) <= 3 GROUP BY ALL),
 sdv AS ({stencil('pix', 1, 'sqrt(greatest(avg(q.conf * q.conf) - pow(avg(q.conf), 2), 0.0::DOUBLE)) AS sd')}),
 hr AS (SELECT frame, y, x, NOT gt > 0 AS hole, d, near, conf > 0.9 AS bright, sd < 0.1 AS flat FROM nf JOIN nr USING (frame, y, x) JOIN sdv USING (frame, y, x))"""


def _holes(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", "gt", F.col("conf").alias("grey"))
    return ST.hole_rows(px, 3, 0.3, 0.9, 0.1, 3)


@register("hole_statistics", "AGG-22", f"""WITH {P8}, {HOLE}, f AS (SELECT frame, avg(hole::INT) AS inv, count(*) FILTER (hole) AS n, count(*) FILTER (hole AND near) / nullif(count(*) FILTER (hole), 0)::DOUBLE AS near, count(*) FILTER (hole AND bright) / nullif(count(*) FILTER (hole), 0)::DOUBLE AS bright,
   count(*) FILTER (hole AND flat) / nullif(count(*) FILTER (hole), 0)::DOUBLE AS flat, avg(near::INT) AS area FROM hr GROUP BY frame)
  SELECT avg(inv) AS inv_mean, avg(near) AS near, avg(bright) AS bright, avg(flat) AS flat, avg(area) FILTER (n > 0) AS area, quantile_cont(inv, 0.1) AS inv_p10, quantile_cont(inv, 0.5) AS inv_p50, quantile_cont(inv, 0.9) AS inv_p90 FROM f""", "inv_mean near bright flat area inv_p10 inv_p50 inv_p90")
def _(spark, sf):
    return ST.hole_statistics(_holes(spark, sf))


@register("hole_rate_by_depth", "AGG-23", f"""WITH {P8}, {HOLE}, b AS (SELECT hole, CASE WHEN d >= 0.6 AND d < 2 THEN 0 WHEN d >= 2 AND d < 4 THEN 1 WHEN d >= 4 AND d < 8 THEN 2 WHEN d >= 8 THEN 3 END AS bin FROM hr)
  SELECT bin, count(*) FILTER (hole) AS holes, count(*) AS pixels, count(*) FILTER (hole) / count(*)::DOUBLE AS rate FROM b WHERE bin IS NOT NULL GROUP BY bin""", "rate")
def _(spark, sf):
    return ST.hole_rate_by_depth(_holes(spark, sf))


@register("severity_ratio", "AGG-25", f"""WITH {P8}, r AS (SELECT avg(h) AS real FROM (SELECT frame, avg((gt <= 0)::INT) AS h FROM pix GROUP BY frame)), s AS (SELECT * FROM (VALUES ('light', 0.05), ('medium', 0.15), ('strong', 0.35)) t(severity, p)),
  a AS (SELECT severity, frame, avg((gt <= 0 OR {u_sql("'0'", 'frame', "'sev'", 'y', 'x')} < p)::INT) AS h FROM pix, s GROUP BY ALL) SELECT severity, avg(h) AS invalid, avg(h) / (SELECT real FROM r) AS ratio FROM a GROUP BY severity""", "invalid ratio")
def _(spark, sf):
    from gridspark.functions.keyed import uniform
    px = base8(spark, sf)
    real = px.groupBy("frame").agg(F.avg((F.col("gt") <= 0).cast("double")).alias("invalid"))
    sev = F.array(*[F.struct(F.lit(k).alias("severity"), F.lit(v["far_p"]).alias("p")) for k, v in A.SEVERITY.items()])
    aug = px.withColumn("s", F.explode(sev)).withColumn("_h", (F.col("gt") <= 0) | (uniform("0", F.col("frame"), "sev", F.col("y"), F.col("x")) < F.col("s.p")))
    aug = aug.groupBy(F.col("s.severity").alias("severity"), "frame").agg(F.avg(F.col("_h").cast("double")).alias("invalid"))
    return ST.severity_ratio(aug, real)


SHR = P8 + ", shr AS (SELECT frame, grp, avg((cls > 0)::INT) AS s FROM pix GROUP BY frame, grp)"


def _shr(spark, sf):
    return X.pixels8(spark, sf).groupBy("frame", "grp").agg(F.avg((F.col("cls") > 0).cast("int")).alias("s"))


@register("share_percentiles", "AGG-26", f"WITH {SHR} SELECT quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90 FROM shr", "p5 p25 p50 p90")
def _(spark, sf):
    return O.quantiles(_shr(spark, sf), [], "s", [0.05, 0.25, 0.5, 0.9], ["p5", "p25", "p50", "p90"])


@register("share_histogram", "AGG-26", f"WITH {SHR}, b AS (SELECT CASE " + " ".join(f"WHEN s >= {a} AND s <{'=' if b == 1.0 else ''} {b} THEN {i}" for i, (a, b) in enumerate(zip(ST.SHARE_EDGES, ST.SHARE_EDGES[1:]))) + " END AS bin FROM shr) SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin")
def _(spark, sf):
    return ST.share_histogram(_shr(spark, sf), "s")


@register("threshold_sweep", "AGG-26", f"WITH {SHR}, t AS (SELECT unnest([0.3::DOUBLE, 0.4, 0.5]) AS threshold) SELECT threshold, count(*) FILTER (s < threshold) AS n, count(*) FILTER (s < threshold) / count(*)::DOUBLE AS share FROM shr, t GROUP BY threshold", "threshold share")
def _(spark, sf):
    return ST.threshold_sweep(_shr(spark, sf), "s", [0.3, 0.4, 0.5])


@register("confusion_matrix", "AGG-27", """WITH c AS (SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL)
  SELECT label, pred, n, CASE WHEN label = pred THEN n / greatest(sum(n) OVER (PARTITION BY label) + sum(n) OVER (PARTITION BY pred) - n, 1)::DOUBLE END AS iou, sum(CASE WHEN label = pred THEN n ELSE 0 END) OVER () / sum(n) OVER ()::DOUBLE AS accuracy FROM c""", "iou accuracy")
def _(spark, sf):
    return ST.confusion(X.table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@register("pixel_confusion_matrix", "AGG-27", f"""WITH {P64}, c AS (SELECT cls AS label, CASE WHEN pred > 2.4 THEN 1 WHEN pred < 1.6 THEN 2 ELSE 0 END AS pred, count(*) AS n FROM pix GROUP BY ALL)
  SELECT label, pred, n, CASE WHEN label = pred THEN n / greatest(sum(n) OVER (PARTITION BY label) + sum(n) OVER (PARTITION BY pred) - n, 1)::DOUBLE END AS iou, sum(CASE WHEN label = pred THEN n ELSE 0 END) OVER () / sum(n) OVER ()::DOUBLE AS accuracy FROM c""", "iou accuracy")
def _(spark, sf):
    px = X.pixels64(spark, sf).select("cls", F.when(F.col("pred") > 2.4, 1).when(F.col("pred") < 1.6, 2).otherwise(0).alias("p"))
    return ST.confusion(px, "cls", "p", [0, 1, 2])


MQ = f"""{P64}, msk4 AS (SELECT *, cls < 2 AND conf < 0.9 AS tread, cls = 2 AS riser, conf >= 0.97 AS band, conf < 0.51 AS ignore FROM pix),
 bs AS (SELECT p.frame, p.y, p.x, coalesce(avg(q.gt) FILTER (q.gt > 0), 0.0) AS z, bool_and(q.gt > 0) AS v FROM pix p JOIN pix q ON q.frame = p.frame AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL),
 bp AS (SELECT frame, y, x, z, v, (x - 31.5) / 60.0 * z AS px, (y - 31.5) / 60.0 * z AS py, z AS pz FROM bs), {normals_sql('bp', '0.5', 'cx*px + cy*py + cz*pz', valid='{t}.v', floor='greatest(p.pz, 0.001::DOUBLE)')},
 nn AS (SELECT frame, y, x, sg * cx / greatest(m, 1e-12) AS nx, sg * cy / greatest(m, 1e-12) AS ny, sg * cz / greatest(m, 1e-12) AS nz FROM nrm4_m WHERE coalesce(ok0, false)),
 gd AS (SELECT nn.*, tread, riser FROM nn JOIN msk4 USING (frame, y, x) WHERE gt > 0 AND NOT band AND NOT ignore), sel AS (SELECT * FROM gd WHERE tread), {up_sql('sel', 15)},
 inl AS (SELECT frame, avg((abs(nx*ux+ny*uy+nz*uz) > 0.85)::INT) FILTER (tread) AS ti, CASE WHEN count(*) FILTER (riser) > 3 THEN avg((abs(nx*ux+ny*uy+nz*uz) < 0.5)::INT) FILTER (riser) END AS ri FROM gd JOIN up3 USING (frame) GROUP BY frame),
 hh AS (SELECT frame, (x-31.5)/60.0*gt*ux + (y-31.5)/60.0*gt*uy + gt*uz AS hgt FROM msk4 JOIN up3 USING (frame) WHERE tread AND gt > 0 AND NOT band),
 hl AS (SELECT frame, min(hgt) AS lo, count(*) AS n FROM hh GROUP BY frame), hb AS (SELECT frame, floor((hgt - lo) / 0.08)::BIGINT AS bin FROM hh JOIN hl USING (frame) WHERE n >= 60 GROUP BY ALL HAVING count(*) >= 60),
 lv AS (SELECT frame, count(*) AS k FROM (SELECT frame, bin, lag(bin) OVER (PARTITION BY frame ORDER BY bin) AS p FROM hb) WHERE p IS NULL OR bin - p > 1 GROUP BY frame),
 mq AS (SELECT frame, stair_share, riser_share, coalesce(ti, 'nan'::DOUBLE) AS tread_inlier, coalesce(ri, 'nan'::DOUBLE) AS riser_inlier, coalesce(ti, 'nan'::DOUBLE) AS score, coalesce(k, 0) AS n_levels, coalesce(k, 0) >= 2 AND riser_share >= 0.02 AS stair_like,
   coalesce(k, 0) >= 2 AND riser_share >= 0.02 AND coalesce(ti >= 0.8 AND ri >= 0.4, false) AS stair_like_strict
  FROM (SELECT frame, avg((tread OR riser)::INT) AS stair_share, avg(riser::INT) AS riser_share FROM msk4 GROUP BY frame) LEFT JOIN inl USING (frame) LEFT JOIN lv USING (frame))"""


def _mq(spark, sf):
    c = F.col("conf")
    px = X.pixels64(spark, sf).withColumn("tread", (F.col("cls") < 2) & (c < 0.9)).withColumn("riser", F.col("cls") == 2).withColumn("band", c >= 0.97).withColumn("ignore", c < 0.51)
    return Q.mask_quality(px, CAM64, 15, 3, 0.5, 0.08, 60, 3)


@register("mask_quality", "AGG-28", f"WITH {MQ} SELECT * FROM mq", "stair_share riser_share tread_inlier riser_inlier score")
def _(spark, sf):
    return _mq(spark, sf)


@register("quality_distribution", "AGG-29", f"""WITH {MQ} SELECT count(*) AS frames, count(*) FILTER (isnan(score)) AS no_score, count(*) FILTER (stair_like) AS stair_like, count(*) FILTER (stair_like_strict) AS strict, {", ".join(f"count(*) FILTER (NOT isnan(score) AND score >= 0.{t}) AS over_{t}0" for t in (4, 6, 8))},
  {", ".join(f"quantile_cont(score, 0.{p}) FILTER (NOT isnan(score)) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM mq""", "p10 p25 p50 p75 p90")
def _(spark, sf):
    return Q.quality_distribution(_mq(spark, sf))


@register("sequence_summary", "AGG-30", f"WITH {SHR} SELECT grp, count(*) FILTER (s > 0.45) AS strict, count(*) AS frames, quantile_cont(s, 0.5) AS median_share FROM shr GROUP BY grp", "median_share")
def _(spark, sf):
    s = _shr(spark, sf)
    c = s.groupBy("grp").agg(F.count_if(F.col("s") > 0.45).alias("strict"), F.count(F.lit(1)).alias("frames"))
    return c.join(O.quantiles(s, ["grp"], "s", [0.5], ["median_share"]), "grp")


@register("calibration_spread", "AGG-37", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS c_acctbal, max(c_nationkey)::DOUBLE - min(c_nationkey) AS c_nationkey FROM customer GROUP BY c_mktsegment", "c_acctbal c_nationkey")
def _(spark, sf):
    c = X.table(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return ST.spread(c, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])


@register("linear_fits", "AGG-39", f"""WITH {P8}, e AS (SELECT gt AS y0, f.fit AS fit, f.u AS u, f.v AS v FROM (SELECT gt, unnest([{{'fit': 'direct', 'u': pred, 'v': gt}}, {{'fit': 'inverse_y', 'u': pred, 'v': 1/gt}}, {{'fit': 'inverse_x', 'u': 1/pred, 'v': gt}}]) AS f FROM pix WHERE gt > 0 AND pred > 0)),
  c AS (SELECT fit, regr_slope(v, u) AS slope, regr_intercept(v, u) AS intercept, regr_r2(v, u) AS r2 FROM e GROUP BY fit), r AS (SELECT e.fit, slope, intercept, r2, CASE WHEN e.fit = 'inverse_y' THEN 1 / (slope * u + intercept) ELSE slope * u + intercept END - y0 AS err FROM e JOIN c USING (fit))
  SELECT fit, any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(r2) AS r2, sqrt(avg(err * err)) AS rms, avg((abs(err) <= 0.1)::INT) AS within FROM r GROUP BY fit""", "slope intercept r2 rms within")
def _(spark, sf):
    return ST.linear_fits(X.pixels8(spark, sf), "pred", "gt", 0.1)


SEG = """sg0 AS (SELECT frame, y, x, (y // 4) * 2 + x // 4 AS label, pred AS r, CASE WHEN conf > 0.65 THEN gt ELSE 0 END AS a FROM pix),
 sgs AS (SELECT frame, label, count(*) FILTER (a > 0) AS n, regr_slope(a, r) FILTER (a > 0) AS s, regr_intercept(a, r) FILTER (a > 0) AS t, var_pop(r) FILTER (a > 0) * count(*) FILTER (a > 0) AS den FROM sg0 GROUP BY ALL),
 sgg AS (SELECT frame, count(*) FILTER (a > 0) AS gn, CASE WHEN var_pop(r) FILTER (a > 0) * count(*) FILTER (a > 0) > 1e-8 THEN regr_slope(a, r) FILTER (a > 0) ELSE 0 END AS gs, CASE WHEN var_pop(r) FILTER (a > 0) * count(*) FILTER (a > 0) > 1e-8 THEN regr_intercept(a, r) FILTER (a > 0) ELSE coalesce(avg(a) FILTER (a > 0), 0) END AS g0 FROM sg0 GROUP BY frame),
 fit AS (SELECT frame, label, n, CASE WHEN n >= 8 AND den > 1e-8 THEN s ELSE gs END AS s, CASE WHEN n >= 8 AND den > 1e-8 THEN t ELSE g0 END AS t, gn FROM sgs JOIN sgg USING (frame))"""


def _segs(spark, sf):
    lab = (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).alias("label")
    return X.pixels8(spark, sf).select("frame", "y", "x", lab, F.col("pred").alias("r"), F.when(F.col("conf") > 0.65, F.col("gt")).otherwise(0.0).alias("a"))


@register("affine_fit_per_segment", "AGG-40", f"WITH {P8}, {SEG} SELECT frame, label, n, s, t FROM fit", "s t")
def _(spark, sf):
    return ST.affine_per_segment(_segs(spark, sf), "r", "a", F.col("a") > 0, 8).select("frame", "label", "n", "s", "t")


@register("segment_lookup", "JOIN-16", f"WITH {P8}, {SEG} SELECT frame, y, x, s * r + t AS z FROM sg0 JOIN fit USING (frame, label)", "z")
def _(spark, sf):
    px = _segs(spark, sf)
    f = ST.affine_per_segment(px, "r", "a", F.col("a") > 0, 8)
    return px.join(f, ["frame", "label"]).select("frame", "y", "x", (F.col("s") * F.col("r") + F.col("t")).alias("z"))


@register("local_calibration_plain", "BMK-17", f"WITH {P8}, {SEG} SELECT frame, y, x, CASE WHEN gn = 0 THEN 0.5 ELSE least(greatest(s * r + t, 0.5::DOUBLE), 3.0::DOUBLE) END AS pred, gn = 0 AS degenerate FROM sg0 JOIN fit USING (frame, label)", "pred")
def _(spark, sf):
    return Q.local_calibration(_segs(spark, sf), "r", "a", 0.5, 3.0, 8, "none")


@register("local_calibration_gaussian", "BMK-17", f"WITH {P8}, {SEG}, mp AS (SELECT frame, y, x, r, s, t, gn FROM sg0 JOIN fit USING (frame, label)), {gauss_w('wg', 1.0)} SELECT frame, y, x, CASE WHEN gn = 0 THEN 0.5 ELSE least(greatest(a.v * r + b.v, 0.5::DOUBLE), 3.0::DOUBLE) END AS pred, gn = 0 AS degenerate FROM mp JOIN {sep('mp', 's', 'wg', 'wg')} a USING (frame, y, x) JOIN {sep('mp', 't', 'wg', 'wg')} b USING (frame, y, x)", "pred")
def _(spark, sf):
    return Q.local_calibration(_segs(spark, sf), "r", "a", 0.5, 3.0, 8, "gaussian", 1.0)


@register("local_calibration_bilateral", "BMK-17", f"""WITH {P8}, {SEG}, mp AS (SELECT frame, y, x, r, s, t, gn FROM sg0 JOIN fit USING (frame, label)), d AS (SELECT frame, greatest(stddev_pop(s), 1e-9) * 0.25 AS rs, greatest(stddev_pop(t), 1e-9) * 0.25 AS rt FROM mp GROUP BY frame),
  w AS (SELECT p.frame, p.y, p.x, any_value(p.r) AS r, any_value(p.gn) AS gn, sum(g * q.s) / sum(g) AS s, sum(g * q.t) / sum(g) AS t FROM (SELECT p.*, rs, rt, dy, dx FROM mp p JOIN d USING (frame), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)) p
    JOIN mp q ON q.frame = p.frame AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7), LATERAL (SELECT exp(-0.5 * (dy*dy + dx*dx) / (1.0 + 1e-12)) * exp(-0.5 * (pow((q.s - p.s) / rs, 2) + pow((q.t - p.t) / rt, 2))) AS g) GROUP BY p.frame, p.y, p.x)
  SELECT frame, y, x, CASE WHEN gn = 0 THEN 0.5 ELSE least(greatest(s * r + t, 0.5::DOUBLE), 3.0::DOUBLE) END AS pred, gn = 0 AS degenerate FROM w""", "pred")
def _(spark, sf):
    return Q.local_calibration(_segs(spark, sf), "r", "a", 0.5, 3.0, 8, "bilateral", sigma_spatial=1.0)


@register("floor_nearest_fill", "BMK-15", f"""WITH {P8}, s AS (SELECT frame, y, x, CASE WHEN conf > 0.85 THEN gt ELSE 0 END AS z FROM pix), f AS (SELECT a.frame, a.y, a.x, CASE WHEN a.z > 0 THEN a.z ELSE arg_min(b.z, ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x) END AS p FROM s a LEFT JOIN s b ON a.frame = b.frame AND b.z > 0 GROUP BY a.frame, a.y, a.x, a.z),
  g AS (SELECT frame, y, x, coalesce(p, 1.75) AS p FROM f), {gauss_w('wg', 0.8)} SELECT frame, y, x, least(greatest(v, 0.5::DOUBLE), 3.0::DOUBLE) AS pred FROM {sep('g', 'p', 'wg', 'wg')}""", "pred")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", F.when(F.col("conf") > 0.85, F.col("gt")).otherwise(0.0).alias("z"))
    return Q.floor_nearest(px, "z", 0.5, 3.0, 0.8)


@register("floor_bicubic", "BMK-16", f"""WITH {P8}, b AS (SELECT frame, (y // 2)::INT AS y, (x // 2)::INT AS x, CASE WHEN count(*) FILTER (gt > 0) >= 2 THEN avg(gt) FILTER (gt > 0) ELSE 0 END AS lr FROM pix GROUP BY ALL), {bicubic_w('wq', 4, 8)} SELECT frame, y, x, least(greatest(v, 0.5::DOUBLE), 3.0::DOUBLE) AS pred FROM {sep('b', 'lr', 'wq', 'wq')}""", "pred")
def _(spark, sf):
    from gridspark.operators import raster as R
    lr = R.block_mean(X.pixels8(spark, sf), "gt", 2, 0.5).select("frame", F.col("by").alias("y"), F.col("bx").alias("x"), "lr")
    return Q.floor_bicubic(lr, "lr", F.lit(8), F.lit(8), 0.5, 3.0)


@register("floor_nearest_fill_packed", "BMK-15 RST-07", f"""WITH {P64}, s AS (SELECT frame, y, x, CASE WHEN conf > 0.7 THEN gt ELSE 0 END AS z FROM pix), f AS (SELECT a.frame, a.y, a.x, arg_min(b.z, ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x) AS p FROM s a JOIN s b ON a.frame = b.frame AND b.z > 0 AND abs(a.y-b.y) <= 20 AND abs(a.x-b.x) <= 20 WHERE a.z <= 0 GROUP BY ALL)
  SELECT frame, y, x, least(greatest(CASE WHEN z > 0 THEN z ELSE coalesce(p, 1.75) END, 0.5::DOUBLE), 3.0::DOUBLE) AS pred FROM s LEFT JOIN f USING (frame, y, x)""", "pred")
def _(spark, sf):
    from gridspark.layouts import frames_to_pixels, pixels_to_frames
    px = X.pixels64(spark, sf).select("frame", "y", "x", F.when(F.col("conf") > 0.7, F.col("gt")).otherwise(0.0).alias("z"))
    return frames_to_pixels(Q.floor_nearest_packed(pixels_to_frames(px, ["z"]), "z", 0.5, 3.0), ["pred"]).select("frame", "y", "x", "pred")


@register("floor_bicubic_packed", "BMK-16 RST-03", f"""WITH {P8}, {bicubic_w('wq', 8, 16)} SELECT frame, y, x, least(greatest(v, 0.5::DOUBLE), 3.0::DOUBLE) AS pred FROM {sep('pix', 'gt', 'wq', 'wq')}""", "pred")
def _(spark, sf):
    from gridspark.catalog.fixtures import frames8
    from gridspark.layouts import frames_to_pixels
    f = Q.floor_bicubic_packed(frames8(spark, sf).select("frame", "h", "w", "gt"), "gt", F.lit(16), F.lit(16), 0.5, 3.0)
    return frames_to_pixels(f, ["pred"]).select("frame", "y", "x", "pred")


@register("display_percentile_range", "SCL-28", f"WITH {P8} SELECT grp, quantile_cont(gt, 0.02) AS lo, quantile_cont(gt, 0.98) AS hi FROM pix WHERE gt > 0 GROUP BY grp", "lo hi")
def _(spark, sf):
    return ST.display_range(X.pixels8(spark, sf).where("gt > 0").select("grp", "gt"), ["grp"], "gt")


@register("gate_class_shares", "AGG-44", f"""WITH {P8}, f AS (SELECT doc_id AS frame, quality = 1 AS gate FROM labels), s AS (SELECT frame, avg((cls = 1)::INT) AS tread, avg((cls = 2)::INT) AS riser, avg((conf >= 0.9)::INT) AS band FROM pix GROUP BY frame)
  SELECT coalesce(gate, false) AS gate, count(*) AS frames, avg(tread) AS tread, avg(riser) AS riser, avg(band) AS band FROM s LEFT JOIN f USING (frame) GROUP BY 1""", "tread riser band")
def _(spark, sf):
    fl = X.table(spark, sf, "labels").select(F.col("doc_id").alias("frame"), (F.col("quality") == 1).alias("gate"))
    one = lambda c: F.avg(c.cast("int"))
    s = X.pixels8(spark, sf).groupBy("frame").agg(one(F.col("cls") == 1).alias("tread"), one(F.col("cls") == 2).alias("riser"), one(F.col("conf") >= 0.9).alias("band"))
    return s.join(fl, "frame", "left").groupBy(F.coalesce("gate", F.lit(False)).alias("gate")).agg(F.count(F.lit(1)).alias("frames"), *[F.avg(c).alias(c) for c in ("tread", "riser", "band")])


@register("agreement_report", "AGG-38", f"""WITH {P8} SELECT grp, count(*) FILTER (gt > 0 AND pred > 1.5) / greatest(count(*) FILTER (gt > 0 OR pred > 1.5), 1)::DOUBLE AS iou, avg((abs(pred - gt) <= 0.05)::INT) FILTER (gt > 0 AND pred > 1.5) AS within_1, avg((abs(pred - gt) <= 0.1)::INT) FILTER (gt > 0 AND pred > 1.5) AS within_2,
  quantile_cont(abs(pred - gt), 0.5) FILTER (gt > 0 AND pred > 1.5) AS median_abs FROM pix GROUP BY grp""", "iou within_1 within_2 median_abs")
def _(spark, sf):
    from gridspark.plans.evaluate import agreement
    px = X.pixels8(spark, sf).withColumn("z", F.when(F.col("pred") > 1.5, F.col("pred")).otherwise(0.0))
    return agreement(px, ["grp"], {"within_1": 0.05, "within_2": 0.1})
