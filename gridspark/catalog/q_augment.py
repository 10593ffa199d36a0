"""Sensor augmentations and their building blocks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import N8, P8, P64, n_sql, u_sql
from gridspark.catalog.q_geometry import CAM8, plane_edges_sql
from gridspark.catalog.q_raster import bicubic_aa_w, bicubic_w, gauss_w, refl, sep, stencil
from gridspark.catalog.q_segment import PAIR, closing_sql, regions_sql
from gridspark.catalog.registry import register
from gridspark.functions import scalar as S
from gridspark.layouts import spread, with_size
from gridspark.operators import augment as A
from gridspark.operators import geometry as G
from gridspark.operators import raster as R
from gridspark.operators import segment as SG


def base8(spark, sf):
    return X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", "gt")


def up(op: str, seed: str = "0", *extra: str) -> str:
    return u_sql(f"'{seed}'", "frame", f"'{op}'", "y", "x", *extra)


def npx(op: str, seed: str = "0") -> str:
    return n_sql(f"'{seed}'", "frame", f"'{op}'", "y", "x")


def field_sql(name: str, op: str, sigma: float, seed: str = "0") -> str:
    """CTEs of a smooth field ``name(frame, y, x, f)`` on 8x8 frames."""
    return f"""{name}_w AS (SELECT frame, y, x, {npx(op, seed)} AS n FROM pix), {gauss_w(name + '_g', sigma)},
 {name}_s AS (SELECT frame, y, x, v FROM {sep(name + '_w', 'n', name + '_g', name + '_g')}),
 {name} AS (SELECT frame, y, x, v / greatest(stddev_pop(v) OVER (PARTITION BY frame), 1e-9) AS f FROM {name}_s)"""


def erf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0 + 0.3275911 * abs({x})))"
    return f"(sign({x}) * (1.0 - ((((1.061405429::DOUBLE * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}))))"


# ---- formulas --------------------------------------------------------------

@register("disparity_quantise", "SCL-13", f"WITH {P8} SELECT frame, y, x, CASE WHEN gt > 0 THEN 22.8 / greatest(gt, 1e-6) ELSE 0 END AS disp, round_even((CASE WHEN gt > 0 THEN 22.8 / greatest(gt, 1e-6) ELSE 0 END) * 8, 0) / 8 AS quantised FROM pix", "disp quantised")
def _(spark, sf):
    d = S.disparity(F.col("gt"), 22.8)
    return base8(spark, sf).select("frame", "y", "x", d.alias("disp"), S.quantise_disparity(d, 3).alias("quantised"))


ANG = "least(greatest(acos(least(1.0::DOUBLE, abs(nz))) * 8, 0.0::DOUBLE), 1.5533430342749532::DOUBLE)"


@register("axial_sigma", "SCL-14", f"""WITH {P8}, {N8}, a AS (SELECT frame, y, x, CASE WHEN gt > 0 THEN gt ELSE 1 END AS zs, {ANG} AS phi FROM pix JOIN nrm USING (frame, y, x))
  SELECT frame, y, x, least(0.0012 + 0.0019 * (zs - 0.4) * (zs - 0.4) + CASE WHEN phi > 1.0471975511965976 THEN 1e-4 / sqrt(zs) * phi * phi / pow(1.5707963267948966 - phi, 2) ELSE 0 END, 0.1::DOUBLE) AS sigma FROM a""", "sigma")
def _(spark, sf):
    px = base8(spark, sf).join(spread(X.normals8(spark, sf)), ["frame", "y", "x"])
    return px.select("frame", "y", "x", S.axial_sigma(F.col("gt"), G.theta() * 8).alias("sigma"))


@register("lateral_sigma", "SCL-15", f"WITH {N8}, a AS (SELECT frame, y, x, {ANG} AS phi FROM nrm) SELECT frame, y, x, least(0.8 + 0.035 * phi / (1.5707963267948966 - phi), 10.0::DOUBLE) AS sigma FROM a", "sigma")
def _(spark, sf):
    return X.normals8(spark, sf).select("frame", "y", "x", S.lateral_sigma(G.theta() * 8).alias("sigma"))


@register("dropout_probabilities", "SCL-16 SCL-17 SCL-18 SCL-19", f"""WITH {P8}, {N8} SELECT frame, y, x, least(greatest(0.0 + 0.04 * greatest(degrees(acos(least(1.0::DOUBLE, abs(nz))) * 8) - 60, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS p_theta,
  least(greatest(0.02 * pow(greatest(gt, 0.6::DOUBLE) / 1.5, 2), 0.0::DOUBLE), 0.85::DOUBLE) AS p_depth, 0.35 * least(greatest((gt - 2.5) / 3.5, 0.0::DOUBLE), 1.0::DOUBLE) AS p_far, 0.01 + 0.012 * gt AS sigma_range FROM pix JOIN nrm USING (frame, y, x)""", "p_theta p_depth p_far sigma_range")
def _(spark, sf):
    px = base8(spark, sf).join(spread(X.normals8(spark, sf)), ["frame", "y", "x"])
    z = F.col("gt")
    return px.select("frame", "y", "x", S.theta_dropout_p(G.theta() * 8).alias("p_theta"), S.depth_dropout_p(z).alias("p_depth"), S.far_dropout_p(z, 0.35).alias("p_far"), S.range_sigma(z).alias("sigma_range"))


@register("normal_cdf", "SCL-27", f"WITH {P8} SELECT frame, y, x, 0.5 * (1.0 + {erf_sql('(e * 20 / sqrt(2.0::DOUBLE))')}) AS cdf FROM pix", "cdf")
def _(spark, sf):
    return X.pixels8(spark, sf).select("frame", "y", "x", S.normal_cdf(F.col("e") * 20).alias("cdf"))


# ---- noise fields ----------------------------------------------------------

@register("smooth_noise_field", "SMP-04", f"WITH {P8}, {field_sql('fld', 'demo', 2.0)} SELECT frame, y, x, f FROM fld", "f")
def _(spark, sf):
    return A.smooth_field(base8(spark, sf), "0", "demo", 2.0)


def coarse_sql(name: str, op: str, sigma: float, seed: str = "0") -> str:
    """Coarse 2x2 field zoomed to 8x8 as ``name(frame, y, x, f)``."""
    return f"""{name}_w AS (SELECT frame, y, x, {npx(op, seed)} AS n FROM pix WHERE y < 2 AND x < 2), {gauss_w(name + '_g', max(sigma / 4, 0.7), 2)},
 {name}_z AS (SELECT o, i, sum(w) AS w FROM (SELECT o, 0 AS i, 1 - o / 7.0::DOUBLE AS w FROM (SELECT unnest(range(8)) AS o) UNION ALL SELECT o, 1, o / 7.0::DOUBLE FROM (SELECT unnest(range(8)) AS o)) GROUP BY ALL),
 {name}_s AS (SELECT frame, y, x, v FROM {sep(name + '_w', 'n', name + '_g', name + '_g')}),
 {name}_u AS (SELECT frame, y, x, v FROM {sep(name + '_s', 'v', name + '_z', name + '_z')}),
 {name} AS (SELECT frame, y, x, (v - avg(v) OVER (PARTITION BY frame)) / greatest(stddev_pop(v) OVER (PARTITION BY frame), 1e-9) AS f FROM {name}_u)"""


@register("coarse_noise_field", "SMP-04", f"WITH {P8}, {coarse_sql('cf', 'coarse', 4.0)} SELECT frame, y, x, f FROM cf", "f")
def _(spark, sf):
    return A.coarse_field(base8(spark, sf), "0", "coarse", 4.0)


# ---- input derivations -----------------------------------------------------

@register("identity_input", "AUG-00", f"WITH {P8} SELECT frame, avg(0.0::DOUBLE) AS absrel, 1.0 AS delta1 FROM pix WHERE gt > 0.001 AND gt < 10 GROUP BY frame", "absrel delta1")
def _(spark, sf):
    from gridspark.operators.metrics import per_frame
    return per_frame(A.identity(base8(spark, sf)).withColumn("pred", F.col("z"))).select("frame", "absrel", "delta1")


@register("super_resolution_input", "AUG-01", f"""WITH {P8}, {bicubic_w('wq', 8, 2)}, l AS (SELECT frame, y, x, greatest(v + 0.05 * {npx('sr')}, 0.0::DOUBLE) AS z FROM {sep('pix', 'gt', 'wq', 'wq')})
  SELECT p.frame, p.y, p.x, l.z FROM pix p JOIN l ON l.frame = p.frame AND l.y = p.y // 4 AND l.x = p.x // 4""", "z")
def _(spark, sf):
    return A.sr_input(base8(spark, sf), 4, noisy=True, sigma=0.05, seed="0")[1]


@register("super_resolution_filled_antialias", "AUG-01", f"""WITH {P8}, nf AS (SELECT a.frame, a.y, a.x, CASE WHEN a.gt > 0 THEN a.gt ELSE coalesce(arg_min(b.gt, ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x), 0) END AS z FROM pix a LEFT JOIN pix b ON a.frame = b.frame AND b.gt > 0 GROUP BY a.frame, a.y, a.x, a.gt),
  {bicubic_aa_w('wq', 8, 2)} SELECT frame, y, x, greatest(v, 0.0::DOUBLE) AS z FROM {sep('nf', 'z', 'wq', 'wq')}""", "z")
def _(spark, sf):
    return A.sr_input(base8(spark, sf), 4, fill_holes=True, backend="pil")[0]


@register("random_sparse_input", "AUG-02", f"""WITH {P8}, k AS (SELECT frame, y, x, row_number() OVER (PARTITION BY frame ORDER BY {u_sql("'0'", 'frame', "'pick'", 'y', 'x')}, y, x) AS n FROM pix WHERE gt > 0)
  SELECT frame, y, x, CASE WHEN n <= 9 THEN greatest(gt + 0.02 * {npx('sparse')}, 0.0::DOUBLE) ELSE 0 END AS z FROM pix LEFT JOIN k USING (frame, y, x)""", "z")
def _(spark, sf):
    return A.random_sparse(base8(spark, sf), 9, 0.02, "0").select("frame", "y", "x", "z")


@register("block_center_points", "AUG-03", f"""WITH {P8} SELECT frame, least((y // 3) * 3 + 1, 7)::INT AS y, least((x // 3) * 3 + 1, 7)::INT AS x, avg(gt) FILTER (gt > 0) AS z FROM pix GROUP BY frame, y // 3, x // 3 HAVING count(*) FILTER (gt > 0) >= 4.5""", "z")
def _(spark, sf):
    return A.block_center_points(base8(spark, sf), "gt", 3)


@register("zone_center_points", "AUG-04", f"""WITH {P8}, z AS (SELECT *, (SELECT max(i) FROM (SELECT unnest([0, 1, 2]) AS i) WHERE floor(i * 8 / 3.0) <= y) AS zi, (SELECT max(i) FROM (SELECT unnest([0, 1, 2]) AS i) WHERE floor(i * 8 / 3.0) <= x) AS zj FROM pix)
  SELECT frame, ((floor(zi * 8 / 3.0) + floor((zi + 1) * 8 / 3.0))::INT // 2)::INT AS y, ((floor(zj * 8 / 3.0) + floor((zj + 1) * 8 / 3.0))::INT // 2)::INT AS x, quantile_cont(gt, 0.5) FILTER (gt > 0) AS z FROM z GROUP BY frame, zi, zj HAVING count(*) FILTER (gt > 0) >= 0.8 * count(*)""", "z")
def _(spark, sf):
    return A.zone_center_points(base8(spark, sf), "gt", (3, 3), 0.8)


def zone_sql(n: int, peak: str, zmin: float = 1.5, zmax: float = 3.5, frac: float = 0.25) -> str:
    b = "[" + ", ".join(str(int(round(i * 8 / n))) for i in range(n + 1)) + "]"
    pk = {"mean": "avg(v)", "nearest": "min(v)", "strongest": "avg(v) FILTER (v >= a + best * (b - a) / 4 AND v <= a + (best + 1) * (b - a) / 4)"}[peak]
    return f"""zb AS (SELECT i, {b}[i + 1] AS lo, {b}[i + 2] AS hi FROM (SELECT unnest(range({n})) AS i)),
 zp AS (SELECT p.frame, zy.i, zx.i AS j, zy.lo AS ya, zy.hi AS yb, zx.lo AS xa, zx.hi AS xb, CASE WHEN gt > {zmin} AND gt < {zmax} THEN gt END AS v FROM pix p JOIN zb zy ON p.y >= zy.lo AND p.y < zy.hi JOIN zb zx ON p.x >= zx.lo AND p.x < zx.hi),
 ze AS (SELECT *, CASE WHEN a0 = b0 THEN a0 - 0.5 ELSE a0 END AS a, CASE WHEN a0 = b0 THEN b0 + 0.5 ELSE b0 END AS b FROM (SELECT *, min(v) OVER w AS a0, max(v) OVER w AS b0 FROM zp WINDOW w AS (PARTITION BY frame, i, j))),
 zk AS (SELECT *, least(floor((v - a) / (b - a) * 4), 3)::INT AS k FROM ze),
 zc AS (SELECT frame, i, j, k, count(v) AS c FROM zk WHERE k IS NOT NULL GROUP BY ALL),
 zm AS (SELECT frame, i, j, arg_max(k, c * 100 - k) AS best FROM zc GROUP BY ALL),
 zr AS (SELECT frame, i, j, any_value(ya) AS ya, any_value(yb) AS yb, any_value(xa) AS xa, any_value(xb) AS xb, {pk} AS d FROM zk LEFT JOIN zm USING (frame, i, j) GROUP BY frame, i, j HAVING count(v) >= {frac} * count(*) AND count(v) > 0)"""


@register("zone_peaks", "AUG-05", f"""WITH {P8}, {zone_sql(3, 'strongest')} SELECT frame, i::INT AS i, j::INT AS j, d FROM zr""", "d")
def _(spark, sf):
    return A.zone_rows(base8(spark, sf), (3, 3), 1.0, "strongest", 4, 1.5, 3.5).select("frame", "i", "j", "d")


@register("zone_sensor", "AUG-05", f"""WITH {P8}, {zone_sql(3, 'strongest')}, rp AS (SELECT *, d + (0.01 + 0.012 * d) * {n_sql("'0'", 'frame', "'zone'", 'i', 'j')} AS q FROM zr WHERE {u_sql("'0'", 'frame', "'zone'", 'i', 'j')} >= 0.05),
  ft AS (SELECT *, greatest(0, round_even((ya + yb) / 2.0 - greatest(1, round_even((yb - ya) * 0.6, 0)) / 2.0, 0)) AS y0, round_even((ya + yb) / 2.0 - greatest(1, round_even((yb - ya) * 0.6, 0)) / 2.0, 0) + greatest(1, round_even((yb - ya) * 0.6, 0)) AS y1,
    greatest(0, round_even((xa + xb) / 2.0 - greatest(1, round_even((xb - xa) * 0.6, 0)) / 2.0, 0)) AS x0, round_even((xa + xb) / 2.0 - greatest(1, round_even((xb - xa) * 0.6, 0)) / 2.0, 0) + greatest(1, round_even((xb - xa) * 0.6, 0)) AS x1 FROM rp WHERE q > 1.5 AND q < 3.5)
  SELECT p.frame, p.y, p.x, coalesce(arg_max(q, i * 10 + j), 0.0) AS z FROM pix p LEFT JOIN ft ON ft.frame = p.frame AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 GROUP BY p.frame, p.y, p.x""", "z")
def _(spark, sf):
    return A.zone_sensor(base8(spark, sf), "0", (3, 3), hist_bins=4, z_min=1.5, z_max=3.5).select("frame", "y", "x", "z")


@register("zone_peak_mean_nearest", "AUG-05", f"""WITH {P8}, {zone_sql(2, 'mean')} SELECT 'mean' AS peak, frame, i::INT AS i, j::INT AS j, d FROM zr UNION ALL SELECT 'nearest', frame, i::INT, j::INT, d FROM (WITH {zone_sql(2, 'nearest')} SELECT * FROM zr)""", "d")
def _(spark, sf):
    k = dict(zones=(2, 2), z_min=1.5, z_max=3.5)
    one = lambda p: A.zone_rows(base8(spark, sf), peak=p, **k).select(F.lit(p).alias("peak"), "frame", "i", "j", "d")
    return one("mean").unionByName(one("nearest"))


ZONES = """zl AS (SELECT frame, (zi * 2 + zj) AS zone, zi * 4 AS y0, zj * 4 AS x0, zi * 4 + 4 AS y1, zj * 4 + 4 AS x1, m AS mean FROM (
  SELECT frame, y // 4 AS zi, x // 4 AS zj, avg(gt) AS m FROM pix GROUP BY ALL))"""


def _zone_list(spark, sf):
    p = X.pixels8(spark, sf).withColumn("i", F.floor(F.col("y") / 4).cast("int")).withColumn("j", F.floor(F.col("x") / 4).cast("int"))
    g = p.groupBy("frame", "i", "j").agg(F.avg("gt").alias("mean"))
    i, j = F.col("i"), F.col("j")
    return g.select("frame", (i * 2 + j).alias("zone"), (i * 4).alias("y0"), (j * 4).alias("x0"), (i * 4 + 4).alias("y1"), (j * 4 + 4).alias("x1"), "mean", F.lit(8).alias("h"), F.lit(8).alias("w"))


@register("zone_list_to_sparse", "SRC-19 JOIN-28", f"""WITH {P8}, {ZONES}, r AS (SELECT frame, zone, mean, y0 - 1 AS y0, y1 + 1 AS y1, x0 AS x0, x1 + 1 AS x1 FROM zl), c AS (SELECT frame, ((y0 + y1) // 2)::INT AS y, ((x0 + x1) // 2)::INT AS x, mean FROM zl)
  SELECT 'centre' AS mode, frame, y, x, mean AS z FROM c UNION ALL SELECT 'area', p.frame, p.y, p.x, arg_max(mean, zone) FROM pix p JOIN r ON r.frame = p.frame AND p.y >= greatest(y0, 0) AND p.y < least(y1, 8) AND p.x >= x0 AND p.x < least(x1, 8) GROUP BY p.frame, p.y, p.x""", "z")
def _(spark, sf):
    from gridspark.sources.decode import zones_to_sparse
    z = _zone_list(spark, sf)
    grown = z.withColumn("y0", F.col("y0") - 1).withColumn("y1", F.col("y1") + 1).withColumn("x1", F.col("x1") + 1)
    a = zones_to_sparse(z, False).select(F.lit("centre").alias("mode"), "frame", "y", "x", "z")
    return a.unionByName(zones_to_sparse(grown, True).select(F.lit("area").alias("mode"), "frame", "y", "x", "z"))


# ---- active stereo ---------------------------------------------------------

FB = 22.8
DISP = f"(round_even(((CASE WHEN gt > 0 THEN {FB}::DOUBLE / greatest(gt, 1e-6) ELSE 0 END) + 0.08 * {npx('disp')}) * 8, 0) / 8)"
ZM = f"zm0 AS (SELECT frame, y, x, gt, {DISP} AS d FROM pix), zme AS (SELECT frame, y, x, gt, CASE WHEN d > 1e-9 THEN {FB}::DOUBLE / d ELSE 0 END AS z FROM zm0)"


@register("disparity_noise", "AUG-06", f"WITH {P8}, {ZM} SELECT frame, y, x, z FROM zme", "z")
def _(spark, sf):
    return A.disparity_noise(base8(spark, sf), FB, 0.08, 3, "0").select("frame", "y", "x", "z")


OCC = """oc AS (SELECT frame, y, x, ok AND row_number() OVER (PARTITION BY frame, y, ok, CASE WHEN ok THEN t ELSE x END ORDER BY gt, x) > 1 AS occluded FROM (
  SELECT frame, y, x, gt, round_even(x - {fb}::DOUBLE / greatest(gt, 1e-6), 0) AS t, gt > 0 AND round_even(x - {fb}::DOUBLE / greatest(gt, 1e-6), 0) >= 0 AND round_even(x - {fb}::DOUBLE / greatest(gt, 1e-6), 0) < 8 AS ok FROM pix))"""


@register("occlusion_shadow", "AUG-07 JOIN-13", f"WITH {P8}, {OCC.format(fb=4.0)} SELECT frame, y, x, occluded FROM oc")
def _(spark, sf):
    return A.occlusion_shadow(base8(spark, sf), 4.0).select("frame", "y", "x", "occluded")


EDG = "edg AS (SELECT p.frame, p.y, p.x, bool_or(p.gt > 0 AND q.gt > 0 AND abs(p.gt - q.gt) > {thr} * greatest(p.gt, q.gt, 1e-6)) AS edge FROM pix p JOIN pix q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY ALL)"


@register("depth_edge_mask", "WIN-10", f"WITH {P64}, {EDG.format(thr=0.1)} SELECT frame, y, x, edge FROM edg")
def _(spark, sf):
    return SG.depth_edges(X.pixels64(spark, sf).select("frame", "y", "x", "gt"), "gt", 0.1).select("frame", "y", "x", "edge")


FAT = f"""{EDG.format(thr=0.3)}, bnd AS (SELECT p.frame, p.y, p.x, bool_or(q.edge) AS band FROM edg p JOIN edg q ON q.frame = p.frame AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL),
 zv AS (SELECT frame, y, x, CASE WHEN gt > 0 THEN z ELSE 0 END AS zz, (gt > 0)::INT AS vv FROM zme), sm AS ({stencil('zv', 1, 'sum(q.zz) AS s, sum(q.vv) AS n', '8', '8')}),
 fat AS (SELECT zme.frame, zme.y, zme.x, zme.gt, CASE WHEN band AND n > 0 THEN s / n ELSE z END AS z, band AND {u_sql("'0'", 'zme.frame', "'fat'", 'zme.y', 'zme.x')} < 0.35 AS lost FROM zme JOIN bnd USING (frame, y, x) JOIN sm USING (frame, y, x))"""


@register("edge_fattening", "AUG-08", f"WITH {P8}, {ZM}, {FAT} SELECT frame, y, x, z, lost FROM fat", "z")
def _(spark, sf):
    px = A.disparity_noise(base8(spark, sf), FB, 0.08, 3, "0")
    return A.edge_fattening(px, "z", 1, "0", 0.35, 0.3).select("frame", "y", "x", "z", F.col("fat_lost").alias("lost"))


DRP = f"""dw AS (SELECT frame, y, x, {up('drop')} AS n FROM pix), {gauss_w('dg', 1.5)}, ds AS (SELECT * FROM {sep('dw', 'n', 'dg', 'dg')}),
 drp AS (SELECT frame, y, x, (v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-9) < least(greatest(0.2 * pow(greatest(gt, 0.6::DOUBLE) / 1.5, 2), 0.0::DOUBLE), 0.85::DOUBLE) AS dropped FROM ds JOIN pix USING (frame, y, x) WINDOW w AS (PARTITION BY frame))"""


@register("correlated_dropout", "AUG-09", f"WITH {P8}, {DRP} SELECT frame, y, x, dropped FROM drp")
def _(spark, sf):
    return A.correlated_dropout(base8(spark, sf), "0", 0.2, blob_sigma=1.5).select("frame", "y", "x", "dropped")


@register("operating_range", "AUG-10", f"WITH {P8} SELECT frame, y, x, CASE WHEN gt < 1.6 OR gt > 2.4 THEN 0 ELSE gt END AS z FROM pix", "z")
def _(spark, sf):
    g = F.col("gt")
    return base8(spark, sf).select("frame", "y", "x", F.when((g < 1.6) | (g > 2.4), 0.0).otherwise(g).alias("z"))


STEREO = f"""{ZM}, {FAT}, {DRP}, {OCC.format(fb=FB)}, chn AS (SELECT frame, y, x, CASE WHEN NOT gt > 0 OR occluded OR lost OR dropped OR z < 0.6 OR z > 8 THEN 0 ELSE z END AS z FROM fat JOIN drp USING (frame, y, x) JOIN oc USING (frame, y, x))"""


@register("active_stereo_chain", "AUG-11", f"WITH {P8}, {STEREO} SELECT frame, y, x, z FROM chn", "z")
def _(spark, sf):
    return A.active_stereo(base8(spark, sf), "0", edge_fatten_px=1, depth_edge_threshold=0.3, dropout_base=0.2, blob_sigma=1.5).select("frame", "y", "x", "z")


@register("active_stereo_valid_ratio", "AUG-11 AUG-25", f"WITH {P8}, {STEREO} SELECT frame, avg((c.z > 0)::INT) AS valid_ratio, count(*) FILTER (p.gt > 0 AND NOT c.z > 0) / greatest(count(*) FILTER (p.gt > 0), 1)::DOUBLE AS missing_fraction, avg((NOT c.z > 0)::INT) AS input_invalid FROM chn c JOIN pix p USING (frame, y, x) GROUP BY frame", "valid_ratio missing_fraction input_invalid")
def _(spark, sf):
    return A.report(A.active_stereo(base8(spark, sf), "0", edge_fatten_px=1, depth_edge_threshold=0.3, dropout_base=0.2, blob_sigma=1.5))


# ---- angle-driven models ---------------------------------------------------

TH = f"""{N8}, th0 AS (SELECT p.frame, p.y, p.x, p.gt, CASE WHEN nx > -0.15 THEN acos(least(1.0::DOUBLE, abs(nz))) * 8 ELSE 'nan'::DOUBLE END AS theta FROM pix p JOIN nrm USING (frame, y, x)),
 thf AS (SELECT a.frame, a.y, a.x, arg_min(b.theta, ((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x) AS nt FROM th0 a JOIN th0 b ON a.frame = b.frame AND NOT isnan(b.theta) WHERE isnan(a.theta) AND a.gt > 0 GROUP BY ALL),
 tht AS (SELECT frame, y, x, gt, CASE WHEN NOT isnan(theta) THEN theta WHEN gt > 0 THEN coalesce(nt, 0) ELSE 0 END AS theta FROM th0 LEFT JOIN thf USING (frame, y, x)), thp AS (SELECT *, least(greatest(theta, 0.0::DOUBLE), 1.5533430342749532::DOUBLE) AS phi FROM tht)"""


def theta8(spark, sf):
    n = X.normals8(spark, sf).select("frame", "y", "x", F.when(F.col("nx") > -0.15, G.theta() * 8).otherwise(float("nan")).alias("theta"))
    return A.filled_theta(base8(spark, sf).join(spread(n), ["frame", "y", "x"]))


@register("axial_noise", "AUG-12", f"""WITH {P8}, {TH}, s AS (SELECT *, CASE WHEN gt > 0 THEN gt ELSE 1 END AS zs FROM thp)
  SELECT frame, y, x, CASE WHEN gt > 0 THEN gt + {npx('axial')} * least(0.0012 + 0.0019 * (zs - 0.4) * (zs - 0.4) + CASE WHEN phi > 1.0471975511965976 THEN 1e-4 / sqrt(zs) * phi * phi / pow(1.5707963267948966 - phi, 2) ELSE 0 END, 0.1::DOUBLE) ELSE 0 END AS z FROM s""", "z")
def _(spark, sf):
    return A.axial_noise(theta8(spark, sf), "0").select("frame", "y", "x", "z")


@register("lateral_jitter", "AUG-13", f"""WITH {P8}, {TH}, s AS (SELECT frame, y, x, least(0.8 + 0.035 * phi / (1.5707963267948966 - phi), 10.0::DOUBLE) AS sg FROM thp),
  t AS (SELECT frame, y, x, least(greatest(round_even(x + {npx('latx')} * sg, 0), 0), 7)::INT AS sx, least(greatest(round_even(y + {npx('laty')} * sg, 0), 0), 7)::INT AS sy FROM s)
  SELECT t.frame, t.y, t.x, p.gt AS z FROM t JOIN pix p ON p.frame = t.frame AND p.y = sy AND p.x = sx""", "z")
def _(spark, sf):
    return A.lateral_jitter(theta8(spark, sf), "0").select("frame", "y", "x", "z")


@register("lateral_jitter_correlated", "AUG-13", f"""WITH {P8}, {TH}, {field_sql('fx', 'latx', 1.0)}, {field_sql('fy', 'laty', 1.0)}, s AS (SELECT frame, y, x, least(0.8 + 0.035 * phi / (1.5707963267948966 - phi), 10.0::DOUBLE) AS sg FROM thp),
  t AS (SELECT s.frame, s.y, s.x, least(greatest(round_even(s.x + fx.f * sg, 0), 0), 7)::INT AS sx, least(greatest(round_even(s.y + fy.f * sg, 0), 0), 7)::INT AS sy FROM s JOIN fx USING (frame, y, x) JOIN fy USING (frame, y, x))
  SELECT t.frame, t.y, t.x, p.gt AS z FROM t JOIN pix p ON p.frame = t.frame AND p.y = sy AND p.x = sx""", "z")
def _(spark, sf):
    return A.lateral_jitter(theta8(spark, sf), "0", 1.0).select("frame", "y", "x", "z")


@register("theta_dropout", "AUG-15", f"WITH {P8}, {TH} SELECT frame, y, x, CASE WHEN gt > 0 AND NOT {up('theta')} < least(greatest(0.04 * greatest(degrees(theta) - 60, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) THEN gt ELSE 0 END AS z FROM tht", "z")
def _(spark, sf):
    return A.theta_dropout(theta8(spark, sf), "0").select("frame", "y", "x", "z")


# ---- projector shadow ------------------------------------------------------

STEPQ = """stp AS (SELECT p.frame, p.y, p.x, sqrt(pow(coalesce(least(abs(p.z - l.z), abs(r.z - p.z)), 0), 2) + pow(coalesce(least(abs(p.z - u.z), abs(d.z - p.z)), 0), 2)) AS step FROM nz p
  LEFT JOIN nz l ON l.frame = p.frame AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN nz r ON r.frame = p.frame AND r.y = p.y AND r.x = p.x + 1
  LEFT JOIN nz u ON u.frame = p.frame AND u.y = p.y - 1 AND u.x = p.x LEFT JOIN nz d ON d.frame = p.frame AND d.y = p.y + 1 AND d.x = p.x)"""


@register("local_depth_step", "WIN-11", f"WITH {P8}, nz AS (SELECT frame, y, x, CASE WHEN gt > 0 THEN gt END AS z FROM pix), {STEPQ} SELECT frame, y, x, step FROM stp", "step")
def _(spark, sf):
    return A.depth_step(base8(spark, sf), "gt").select("frame", "y", "x", "step")


def shadow_sql(clip: bool) -> str:
    return f"""nz AS (SELECT frame, y, x, CASE WHEN gt > 0 THEN gt END AS z FROM pix), {STEPQ},
 pj AS (SELECT frame, y, x, gt AS zp, round_even(9.0 * ((x - 3.5) * gt / 9.0) / gt + 3.5, 0) AS iu, round_even(9.0 * ((y - 3.5) * gt / 9.0 + 0.75) / gt + 3.5, 0) AS iv FROM pix WHERE gt > 0),
 zb AS (SELECT iv, iu, frame, min(zp) AS zmin FROM pj WHERE iu BETWEEN 0 AND 7 AND iv BETWEEN 0 AND 7 GROUP BY ALL),
 sh AS (SELECT pj.frame, pj.y, pj.x, CASE WHEN zmin IS NULL THEN {str(clip).lower()} ELSE NOT zp <= zmin + 0.01 * zp + 0.2 * step END AS shadow FROM pj LEFT JOIN zb USING (frame, iv, iu) JOIN stp ON stp.frame = pj.frame AND stp.y = pj.y AND stp.x = pj.x)"""


@register("projector_shadow", "AUG-14", f"WITH {P8}, {shadow_sql(True)} SELECT frame, y, x, coalesce(shadow, false) AS shadow, CASE WHEN coalesce(shadow, false) OR NOT gt > 0 THEN 0 ELSE gt END AS z FROM pix LEFT JOIN sh USING (frame, y, x)", "z")
def _(spark, sf):
    return A.projector_shadow(base8(spark, sf), CAM8, slope_bias=0.2).select("frame", "y", "x", "shadow", "z")


@register("projector_shadow_no_clip", "AUG-14 AUG-25", f"WITH {P8}, {shadow_sql(False)} SELECT frame, count(*) FILTER (shadow) / greatest(count(*) FILTER (gt > 0), 1)::DOUBLE AS shadow_ratio FROM pix LEFT JOIN sh USING (frame, y, x) GROUP BY frame", "shadow_ratio")
def _(spark, sf):
    s = A.projector_shadow(base8(spark, sf), CAM8, slope_bias=0.2, fov_clip=False)
    return s.groupBy("frame").agg((F.count_if("shadow") / F.greatest(F.count_if(F.col("gt") > 0), F.lit(1))).alias("shadow_ratio"))


# ---- holes -----------------------------------------------------------------

@register("share_cap_with_ties", "WIN-14", f"""WITH {P8}, n AS (SELECT frame, y, x, gt, round(conf, 1) AS need FROM pix), b AS (SELECT frame, floor(0.3 * count(*) FILTER (gt > 0)) AS b FROM pix GROUP BY frame),
  k AS (SELECT frame, y, x, row_number() OVER (PARTITION BY frame ORDER BY need, {up('cap')}, y, x) AS k FROM n WHERE gt > 0 AND need <= 0.7) SELECT frame, y, x, coalesce(k <= b, false) AS hole FROM pix LEFT JOIN k USING (frame, y, x) JOIN b USING (frame)""")
def _(spark, sf):
    px = X.pixels8(spark, sf).withColumn("need", F.round("conf", 1))
    return A.share_cap(px, (F.col("gt") > 0) & (F.col("need") <= 0.7), F.col("need"), 0.3, "0").select("frame", "y", "x", "hole")


def dist_sql(mask: str, name: str) -> str:
    """Distance to ``mask`` pixels: ``name(frame, y, x, d)``; NULL where a frame has none."""
    return f"{name} AS (SELECT a.frame, a.y, a.x, sqrt(min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x))) AS d FROM pix a LEFT JOIN {mask} b ON b.frame = a.frame GROUP BY a.frame, a.y, a.x)"


@register("edge_dropout", "AUG-16", f"""WITH RECURSIVE {P8}, {N8}, {plane_edges_sql(2, 0.3, 12.0, False)}, src AS (SELECT frame, y, x, 8 AS h, 8 AS w, edge AS m FROM pe), {closing_sql('src', 'clo').replace('range(-1, 65)', 'range(-1, 9)')},
  msk AS (SELECT pix.frame, pix.y, pix.x FROM pix JOIN clo ON clo.frame = pix.frame AND clo.y = pix.y AND clo.x = pix.x WHERE clo.m AND gt > 0), {regions_sql('msk', 8)},
  big AS (SELECT frame, label FROM lab GROUP BY ALL HAVING count(*) >= 4), eg AS (SELECT frame, y, x FROM lab SEMI JOIN big USING (frame, label)), {dist_sql('eg', 'dst')}, {coarse_sql('cf', 'radius', 4.0)},
  nd AS (SELECT frame, y, x, gt, d / greatest(1 + 0.5 * f, 0.1::DOUBLE) AS need FROM pix JOIN dst USING (frame, y, x) JOIN cf USING (frame, y, x)), b AS (SELECT frame, floor(0.3 * count(*) FILTER (gt > 0)) AS b FROM pix GROUP BY frame),
  k AS (SELECT frame, y, x, row_number() OVER (PARTITION BY frame ORDER BY need, {up('cap')}, y, x) AS k FROM nd WHERE gt > 0 AND need <= 1.5)
  SELECT frame, y, x, CASE WHEN coalesce(k <= b, false) OR NOT gt > 0 THEN 0 ELSE gt END AS z FROM pix LEFT JOIN k USING (frame, y, x) JOIN b USING (frame)""", "z")
def _(spark, sf):
    px = base8(spark, sf).join(spread(X.normals8(spark, sf)), ["frame", "y", "x"])
    return A.edge_dropout(px, CAM8, "0", 0.3, 2, 12.0, 2, 1, 3, 4, 1.5, radius_noise_sigma=4.0).select("frame", "y", "x", "z")


GATE = f"{A.S.normal_quantile(0.85)!r}::DOUBLE"
EHOLE = f"""{field_sql('fw', 'width', 2.0)}, {field_sql('fg', 'gate', 1.0)}, eh AS (SELECT frame, y, x, coalesce(d <= (1.0 + 3.0 * (0.5 + 0.5 * tanh(fw.f))) / 2 AND fg.f < {GATE}, false) AS edge_hole FROM dst JOIN fw USING (frame, y, x) JOIN fg USING (frame, y, x))"""


@register("edge_holes_depth", "AUG-17", f"WITH {P8}, {EDG.format(thr=0.3)}, eg AS (SELECT frame, y, x FROM edg WHERE edge), {dist_sql('eg', 'dst')}, {EHOLE} SELECT frame, y, x, edge_hole, 'depth_edges' AS edge_source FROM eh")
def _(spark, sf):
    p = SG.depth_edges(base8(spark, sf), "gt", 0.3, "cls_edge")
    # the jump threshold of the operator is fixed; a class map built from it gives the same edges
    return A.edge_holes_from(p, F.col("cls_edge"), "depth_edges", "0", (1.0, 4.0), 0.85, (2.0, 1.0)).select("frame", "y", "x", "edge_hole", "edge_source")


@register("edge_holes_mask", "AUG-17", f"WITH {P8}, bd AS (SELECT p.frame, p.y, p.x, bool_or({PAIR}) AS edge FROM pix p JOIN pix q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY ALL), eg AS (SELECT frame, y, x FROM bd WHERE edge), {dist_sql('eg', 'dst')}, {EHOLE} SELECT frame, y, x, edge_hole, 'mask' AS edge_source FROM eh")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", "gt", "cls")
    return A.edge_holes(px, "0", (1.0, 4.0), 0.85, True, True, (2.0, 1.0)).select("frame", "y", "x", "edge_hole", "edge_source")


@register("budgeted_regions", "WIN-12", f"""WITH RECURSIVE s AS (SELECT label::BIGINT AS frame, vec_id AS label, (5 + vec_id * 37 % 60)::BIGINT AS size FROM embeddings),
  c AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {u_sql("'0'", 'frame', "'order'", 'label')}, label) AS k FROM s WHERE {u_sql("'0'", 'frame', "'pick'", 'label')} < 0.9),
  f AS (SELECT frame, 0::BIGINT AS k, 0::BIGINT AS used, -1::BIGINT AS label, false AS took FROM (SELECT DISTINCT frame FROM c)
   UNION ALL SELECT f.frame, c.k, CASE WHEN f.used + c.size <= 400.0 THEN f.used + c.size ELSE f.used END, c.label, f.used + c.size <= 400.0 FROM f JOIN c ON c.frame = f.frame AND c.k = f.k + 1)
  SELECT frame, label FROM f WHERE took""")
def _(spark, sf):
    e = X.table(spark, sf, "embeddings")
    s = e.select(F.col("label").cast("bigint").alias("frame"), F.col("vec_id").alias("label"), (5 + F.col("vec_id") * 37 % 60).alias("size"), F.lit(4000).alias("area"))
    return A.budgeted_regions(s, "0", 0.9, 0.1)


@register("glare_holes", "AUG-18", f"""WITH RECURSIVE {P64}, sz AS (SELECT frame, max(y) + 1 AS h, max(x) + 1 AS w FROM pix GROUP BY frame), g AS (SELECT frame, y, x, h, w, conf AS grey FROM pix JOIN sz USING (frame)),
  sd AS (SELECT p.frame, p.y, p.x, sqrt(greatest(avg(q.grey * q.grey) - pow(avg(q.grey), 2), 0.0::DOUBLE)) AS sd FROM g p, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) JOIN g q ON q.frame = p.frame AND q.y = (CASE WHEN p.y + dy < 0 THEN -1 - (p.y + dy) WHEN p.y + dy >= p.h THEN 2 * p.h - 1 - (p.y + dy) ELSE p.y + dy END) AND q.x = (CASE WHEN p.x + dx < 0 THEN -1 - (p.x + dx) WHEN p.x + dx >= p.w THEN 2 * p.w - 1 - (p.x + dx) ELSE p.x + dx END) GROUP BY ALL),
  m AS (SELECT frame, y, x, h, w, grey > 0.92 OR (sd < 0.012 AND (grey > 0.85 OR grey < 0.12)) AS m FROM g JOIN sd USING (frame, y, x)), msk AS (SELECT frame, y, x FROM m WHERE m), {regions_sql('msk', 4)},
  s AS (SELECT frame, label, count(*) AS size, any_value(h * w) AS area FROM lab JOIN sz USING (frame) GROUP BY frame, label HAVING count(*) >= 2),
  c AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {u_sql("'0'", 'frame', "'order'", 'label')}, label) AS k FROM s WHERE {u_sql("'0'", 'frame', "'pick'", 'label')} < 0.9),
  f AS (SELECT frame, 0::BIGINT AS k, 0::BIGINT AS used, -1::BIGINT AS label, false AS took FROM (SELECT DISTINCT frame FROM c)
   UNION ALL SELECT f.frame, c.k, CASE WHEN f.used + c.size <= 0.002 * area THEN f.used + c.size ELSE f.used END, c.label, f.used + c.size <= 0.002 * area FROM f JOIN c ON c.frame = f.frame AND c.k = f.k + 1)
  SELECT frame, y, x, coalesce(hit, false) AS glare_hole FROM pix LEFT JOIN (SELECT frame, y, x, true AS hit FROM lab SEMI JOIN (SELECT frame, label FROM f WHERE took) USING (frame, label)) USING (frame, y, x)""")
def _(spark, sf):
    px = with_size(X.pixels64(spark, sf).select("frame", "y", "x", F.col("conf").alias("grey")))
    return A.glare_holes(px, "0", 0.9, 0.002, 2, 1).select("frame", "y", "x", "glare_hole")


@register("blob_holes", "AUG-19", f"""WITH {P8}, {field_sql('nf', 'blob', 1.5)}, fr AS (SELECT DISTINCT frame FROM pix), bl AS (SELECT frame, b, floor({u_sql("'0'", 'frame', "'blob_y'", 'b')} * 8) AS cy, floor({u_sql("'0'", 'frame', "'blob_x'", 'b')} * 8) AS cx, 1.0 + 2.0 * {u_sql("'0'", 'frame', "'blob_r'", 'b')} AS r, 0.6 + 0.8 * {u_sql("'0'", 'frame', "'blob_a'", 'b')} AS a
    FROM (SELECT frame, unnest(range(1, (0 + floor({u_sql("'0'", 'frame', "'blob_n'")} * 4))::INT + 1)) AS b FROM fr)),
  h AS (SELECT nf.frame, nf.y, nf.x, bool_or(sqrt(pow((y - cy) / a, 2) + pow(x - cx, 2)) / r + 0.25 * f < 1) AS hit FROM nf JOIN bl ON bl.frame = nf.frame GROUP BY ALL) SELECT frame, y, x, coalesce(hit, false) AS blob_hole FROM pix LEFT JOIN h USING (frame, y, x)""")
def _(spark, sf):
    return A.blob_holes(base8(spark, sf), "0", (0, 3), (1.0, 3.0), 1.5, 3).select("frame", "y", "x", "blob_hole")


@register("flying_pixels", "AUG-20", f"""WITH {P8}, {EDG.format(thr=0.05)}, mm AS (SELECT p.frame, p.y, p.x, min(q.gt) FILTER (q.gt > 0) AS lo, max(q.gt) AS hi FROM pix p JOIN pix q ON q.frame = p.frame AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL)
  SELECT frame, y, x, CASE WHEN edge AND gt > 0 AND {up('fly')} < 0.5 THEN {up('fly_mix')} * lo + (1 - {up('fly_mix')}) * hi ELSE gt END AS z FROM pix JOIN edg USING (frame, y, x) JOIN mm USING (frame, y, x)""", "z")
def _(spark, sf):
    return A.flying_pixels(A.identity(base8(spark, sf)), "z", "0", 0.5).select("frame", "y", "x", "z")


@register("low_frequency_error", "AUG-21", f"WITH {P8}, {field_sql('cr', 'corr', 3.0)} SELECT frame, y, x, CASE WHEN gt > 0 THEN gt * (1 + 0.03 * (gt / 3) * f) ELSE 0 END AS z FROM pix JOIN cr USING (frame, y, x)", "z")
def _(spark, sf):
    return A.low_frequency_error(A.identity(base8(spark, sf)), "z", "0", 0.03, 3.0).select("frame", "y", "x", "z")


@register("far_dropout", "AUG-22", f"WITH {P8}, {field_sql('fa', 'far', 3.0)} SELECT frame, y, x, 0.5 * (1.0 + {erf_sql('(f / sqrt(2.0::DOUBLE))')}) < 0.35 * least(greatest((gt - 2.5) / 3.5, 0.0::DOUBLE), 1.0::DOUBLE) AS far_hole FROM pix JOIN fa USING (frame, y, x)")
def _(spark, sf):
    return A.far_dropout(base8(spark, sf), "0", 0.35, 3.0).select("frame", "y", "x", "far_hole")


@register("severity_presets_applied", "AUG-23", f"""WITH {P8}, sv AS (SELECT * FROM (VALUES ('light', 0.05, 0.005), ('medium', 0.15, 0.012), ('strong', 0.35, 0.03)) t(severity, far_p, corr)), a AS (SELECT *, CASE grp % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'medium' ELSE 'strong' END AS severity FROM pix)
  SELECT frame, severity, avg(far_p * least(greatest((gt - 2.5) / 3.5, 0.0::DOUBLE), 1.0::DOUBLE)) AS mean_p, avg(gt * (1 + corr * gt / 3)) AS mean_z FROM a JOIN sv USING (severity) GROUP BY ALL""", "mean_p mean_z")
def _(spark, sf):
    k = F.col("grp") % 3
    px = X.pixels8(spark, sf).withColumn("severity", F.when(k == 0, "light").when(k == 1, "medium").otherwise("strong"))
    j = px.join(F.broadcast(A.severity_table(spark)), "severity")
    p = F.col("far_p") * F.least(F.greatest((F.col("gt") - 2.5) / 3.5, F.lit(0.0)), F.lit(1.0))
    return j.groupBy("frame", "severity").agg(F.avg(p).alias("mean_p"), F.avg(F.col("gt") * (1 + F.col("corr") * F.col("gt") / 3)).alias("mean_z"))


@register("severity_chain", "AUG-23 AUG-25")
def _(spark, sf):
    px = with_size(X.pixels64(spark, sf).select("frame", "y", "x", "gt", "cls", F.col("conf").alias("grey")))
    full, lr = A.severity_chain(px, "medium", 3, epoch=2)
    low = lr.groupBy("frame").agg((1.0 - F.avg(F.col("lr_valid").cast("double"))).alias("lr_invalid"))
    hole = full.groupBy("frame").agg(F.avg(((F.col("added") | F.col("base_hole")) & (F.col("gt") > 0)).cast("double")).alias("added_hole"), F.first("edge_source").alias("edge_source"))
    return A.report(full).join(low, "frame").join(hole, "frame")


@register("sequential_chain", "AUG-24", f"""WITH {P8}, {TH}, s1 AS (SELECT frame, y, x, theta, CASE WHEN gt > 0 AND NOT {up('theta', '0/0')} < least(greatest(0.04 * greatest(degrees(theta) - 60, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) THEN gt ELSE 0 END AS gt FROM tht),
  s2 AS (SELECT frame, y, x, gt, least(greatest(theta, 0.0::DOUBLE), 1.5533430342749532::DOUBLE) AS phi, CASE WHEN gt > 0 THEN gt ELSE 1 END AS zs FROM s1)
  SELECT frame, y, x, CASE WHEN gt > 0 THEN gt + {npx('axial', '0/1')} * least(0.0012 + 0.0019 * (zs - 0.4) * (zs - 0.4) + CASE WHEN phi > 1.0471975511965976 THEN 1e-5 / sqrt(zs) * phi * phi / pow(1.5707963267948966 - phi, 2) ELSE 0 END, 0.1::DOUBLE) ELSE 0 END AS z FROM s2""", "z")
def _(spark, sf):
    return A.sequential(theta8(spark, sf), ["theta_dropout", "axial_noise"], 0)[0].select("frame", "y", "x", "z")


@register("sequential_chain_report", "AUG-24 AUG-25 UDF-02", f"""WITH {P8}, {TH}, s1 AS (SELECT frame, y, x, gt, CASE WHEN gt > 0 AND NOT {up('theta', '0/0')} < least(greatest(0.04 * greatest(degrees(theta) - 60, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) THEN gt ELSE 0 END AS z FROM tht)
  SELECT frame, 'step0_theta_dropout' AS step, avg((z > 0)::INT) AS valid_ratio, count(*) FILTER (gt > 0 AND NOT z > 0) / greatest(count(*) FILTER (gt > 0), 1)::DOUBLE AS missing_fraction, avg((NOT z > 0)::INT) AS input_invalid FROM s1 GROUP BY frame
  UNION ALL SELECT frame, 'step1_axial_noise', avg((z > 0)::INT), 0.0, avg((NOT z > 0)::INT) FROM s1 GROUP BY frame""", "valid_ratio missing_fraction input_invalid")
def _(spark, sf):
    return A.sequential(theta8(spark, sf), ["theta_dropout", "axial_noise"], 0)[1]
