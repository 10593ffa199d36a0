"""Points, normals, stair geometry, planes, reprojection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import N8, P8, P64
from gridspark.catalog.q_raster import HOLED_N, NEAR3, guided_sql, holed_normals
from gridspark.catalog.q_segment import regions_sql
from gridspark.catalog.q_tables import CAMS, cameras
from gridspark.catalog.q_pixels import AGGS, CFG
from gridspark.catalog.registry import REGISTRY, register
from gridspark.functions import scalar as S
from gridspark.layouts import spread
from gridspark.operators import geometry as G
from gridspark.operators import raster as R
from gridspark.operators import segment as SG

CAM8 = (9.0, 9.0, 3.5, 3.5)
CAM64 = (60.0, 60.0, 31.5, 31.5)

PTS8 = P8 + ", pt AS (SELECT *, (x - 3.5) / 9.0 * gt AS px, (y - 3.5) / 9.0 * gt AS py, gt AS pz FROM pix)"
PTS64 = P64 + ", pt AS (SELECT *, (x - 31.5) / 60.0 * gt AS px, (y - 31.5) / 60.0 * gt AS py, gt AS pz FROM pix)"


@register("unproject", "SCL-20", f"WITH {PTS8} SELECT frame, y, x, px, py, pz FROM pt", "px py pz")
def _(spark, sf):
    return G.with_points(X.pixels8(spark, sf), "gt", CAM8).select("frame", "y", "x", "px", "py", "pz")


DIST = (0.1, -0.05, 0.01, 0.02, 0.0, 0.003, 0.001, -0.002)
DSQL = """dd AS (SELECT frame, y, x, u, v, u*u + v*v AS r2 FROM (SELECT frame, y, x, (x - 3.5) / 9.0 AS u, (y - 3.5) / 9.0 AS v FROM pix)),
 de AS (SELECT *, (1 + r2 * (0.1 + r2 * (-0.05 + r2 * 0.01))) / (1 + r2 * (0.02 + r2 * (0.0 + r2 * 0.003))) AS rad FROM dd),
 df AS (SELECT frame, y, x, u, v, u * rad + 0.002 * u * v - 0.002 * (r2 + 2*u*u) AS ud, v * rad + 0.001 * (r2 + 2*v*v) - 0.004 * u * v AS vd FROM de)"""


@register("project_distorted", "SCL-21", f"WITH {P8}, {DSQL} SELECT frame, y, x, 9.0 * ud + 3.5 AS u, 9.0 * vd + 3.5 AS v FROM df", "u v")
def _(spark, sf):
    xd, yd = G.distort((F.col("x") - 3.5) / 9.0, (F.col("y") - 3.5) / 9.0, DIST)
    return X.pixels8(spark, sf).select("frame", "y", "x", (9.0 * xd + 3.5).alias("u"), (9.0 * yd + 3.5).alias("v"))


@register("camera_after_crop_resize", "SCL-22", f"WITH {CAMS} SELECT grp, fx * 0.5 AS fx, fy * 2.0 AS fy, (cx - 2 + 0.5) * 0.5 - 0.5 AS cx, (cy - 1 + 0.5) * 2.0 - 0.5 AS cy FROM cams", "fx fy cx cy")
def _(spark, sf):
    c = cameras(spark, sf)
    k = G.convert_camera(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), (1, 2), (2.0, 0.5))
    return c.select("grp", *[v.alias(n) for n, v in k.items()])


@register("undistorted_ray_map", "SCL-23", f"WITH {P8}, {DSQL} SELECT frame, y, x, u AS rx, v AS ry FROM df", "rx ry")
def _(spark, sf):
    # the inverse of the distortion brings every distorted point back to its ray
    xd, yd = G.distort((F.col("x") - 3.5) / 9.0, (F.col("y") - 3.5) / 9.0, DIST)
    px = X.pixels8(spark, sf).select("frame", "y", "x", xd.alias("xd"), yd.alias("yd"))
    r = px.withColumn("r", G.undistort(F.col("xd"), F.col("yd"), DIST, 20))
    return r.select("frame", "y", "x", F.col("r.x").alias("rx"), F.col("r.y").alias("ry"))


@register("surface_angle", "SCL-24", f"""WITH {N8} SELECT frame, y, x, acos(least(1.0::DOUBLE, abs(nz))) AS axis_angle,
  acos(least(1.0::DOUBLE, abs(nx * (x-3.5)/9.0 + ny * (y-3.5)/9.0 + nz) / sqrt(pow((x-3.5)/9.0, 2) + pow((y-3.5)/9.0, 2) + 1))) AS ray_angle FROM nrm""", "axis_angle ray_angle")
def _(spark, sf):
    return X.normals8(spark, sf).select("frame", "y", "x", G.theta().alias("axis_angle"), G.theta("viewing_ray", CAM8).alias("ray_angle"))


@register("normal_angular_error", "SCL-25", f"WITH {N8} SELECT a.frame, a.y, a.x, degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) AS err FROM nrm a JOIN nrm b ON a.frame = b.frame AND a.y = b.y AND b.x = 7 - a.x", "err")
def _(spark, sf):
    a = X.normals8(spark, sf)
    b = a.select("frame", "y", (7 - F.col("x")).alias("x"), *[F.col(c).alias("m" + c[1]) for c in ("nx", "ny", "nz")])
    return a.join(spread(b), ["frame", "y", "x"]).select("frame", "y", "x", G.angular_error(["nx", "ny", "nz"], ["mx", "my", "mz"]).alias("err"))


def normals_sql(pt: str, rel: str, facing: str, name: str = "nrm4", valid: str = "{t}.pz > 0", floor: str = "p.pz") -> str:
    """Cross-product normals CTE: (frame, y, x, nx, ny, nz, ok)."""
    v = {t: valid.format(t=t) for t in "plrud"}
    near = " AND ".join(f"coalesce({v[t]} AND abs({t}.pz - p.pz) < {rel} * {floor}, false)" for t in "lrud")
    return f"""{name}_c AS (SELECT p.frame, p.y, p.x, p.px, p.py, p.pz, ({v['p']}) AND {near} AS ok0, l.pz IS NOT NULL AND r.pz IS NOT NULL AND u.pz IS NOT NULL AND d.pz IS NOT NULL AS inner_px,
   (r.py-l.py)*(d.pz-u.pz) - (r.pz-l.pz)*(d.py-u.py) AS cx, (r.pz-l.pz)*(d.px-u.px) - (r.px-l.px)*(d.pz-u.pz) AS cy, (r.px-l.px)*(d.py-u.py) - (r.py-l.py)*(d.px-u.px) AS cz
   FROM {pt} p LEFT JOIN {pt} l ON l.frame=p.frame AND l.y=p.y AND l.x=p.x-1 LEFT JOIN {pt} r ON r.frame=p.frame AND r.y=p.y AND r.x=p.x+1
   LEFT JOIN {pt} u ON u.frame=p.frame AND u.y=p.y-1 AND u.x=p.x LEFT JOIN {pt} d ON d.frame=p.frame AND d.y=p.y+1 AND d.x=p.x),
 {name}_m AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS m, CASE WHEN {facing} > 0 THEN -1.0 ELSE 1.0 END AS sg FROM {name}_c)"""


@register("normals_cross_product", "GEO-01", f"""WITH {PTS8}, {normals_sql('pt', '0.3', 'cz')} SELECT frame, y, x, coalesce(ok0 AND m / 4 > 1e-12, false) AS ok,
  CASE WHEN coalesce(ok0 AND m / 4 > 1e-12, false) THEN sg * cx / m ELSE 0 END AS nx, CASE WHEN coalesce(ok0 AND m / 4 > 1e-12, false) THEN sg * cy / m ELSE 0 END AS ny, CASE WHEN coalesce(ok0 AND m / 4 > 1e-12, false) THEN sg * cz / m ELSE 0 END AS nz FROM nrm4_m""", "nx ny nz")
def _(spark, sf):
    n = G.normals_cross(X.pixels8(spark, sf).select("frame", "y", "x", "gt"), "gt", CAM8, 0.3)
    return n.select("frame", "y", "x", F.col("n_ok").alias("ok"), "nx", "ny", "nz")


@register("normals_constant", "GEO-02", f"WITH {P8} SELECT frame, y, x, 0.0 AS nx, 0.0 AS ny, CASE WHEN gt > 0 THEN -1.0 ELSE 0.0 END AS nz, gt > 0 AS ok FROM pix", "nx ny nz")
def _(spark, sf):
    ok = F.col("gt") > 0
    return X.pixels8(spark, sf).select("frame", "y", "x", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(ok, -1.0).otherwise(0.0).alias("nz"), ok.alias("ok"))


FACING = f"{PTS64}, {normals_sql('pt', '0.4', 'cx*px + cy*py + cz*pz', floor='greatest(p.pz, 0.001::DOUBLE)')}, n64 AS (SELECT frame, y, x, coalesce(ok0, false) AS ok, coalesce(sg * cx / greatest(m, 1e-12), 0.0) AS nx, coalesce(sg * cy / greatest(m, 1e-12), 0.0) AS ny, coalesce(sg * cz / greatest(m, 1e-12), 0.0) AS nz FROM nrm4_m)"


def facing64(spark, sf):
    px = X.pixels64(spark, sf).select("frame", "y", "x", "gt", "pred", "cls", "conf", "e")
    return G.normals_facing(px, "gt", CAM64, F.col("gt") > 0, 0.4)


@register("normals_facing_camera", "GEO-03", f"WITH {FACING} SELECT frame, y, x, ok, nx, ny, nz FROM n64", "nx ny nz")
def _(spark, sf):
    return facing64(spark, sf).select("frame", "y", "x", F.col("n_ok").alias("ok"), "nx", "ny", "nz")


@register("normal_source_resolution", "GEO-04", f"""WITH {N8}, g AS (SELECT *, (x + y) % 3 <> 0 AS have FROM nrm) SELECT frame, y, x, CASE WHEN have THEN 'provided' ELSE 'estimated' END AS normal_source, CASE WHEN have THEN nx ELSE 0.0 END AS nx, CASE WHEN have THEN nz ELSE -1.0 END AS nz FROM g""", "nx nz")
def _(spark, sf):
    have = (F.col("x") + F.col("y")) % 3 != 0
    px = X.normals8(spark, sf).select("frame", "y", "x", *[F.when(have, F.col("n" + c)).alias("given_n" + c) for c in "xyz"], F.lit(0.0).alias("est_nx"), F.lit(0.0).alias("est_ny"), F.lit(-1.0).alias("est_nz"))
    return G.resolve_normals(px).select("frame", "y", "x", "normal_source", "nx", "nz")


def up_sql(src: str, min_px: int, rounds: int = 3, name: str = "up") -> str:
    """Robust up vector CTEs over ``src(frame, nx, ny, nz)``."""
    out = f"""{name}0r AS (SELECT frame, quantile_disc(nx, 0.5) AS a, quantile_disc(ny, 0.5) AS b, quantile_disc(nz, 0.5) AS c FROM {src} GROUP BY frame HAVING count(*) >= {min_px}),
 {name}0 AS (SELECT frame, a / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS ux, b / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS uy, c / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS uz FROM {name}0r)"""
    for k in range(1, rounds + 1):
        w = "FILTER (nx*ux + ny*uy + nz*uz > 0.9)"
        out += f""",
 {name}{k}r AS (SELECT frame, coalesce(avg(nx) {w}, any_value(ux)) AS a, coalesce(avg(ny) {w}, any_value(uy)) AS b, coalesce(avg(nz) {w}, any_value(uz)) AS c FROM {src} JOIN {name}{k-1} USING (frame) GROUP BY frame),
 {name}{k} AS (SELECT frame, a / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS ux, b / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS uy, c / greatest(sqrt(a*a+b*b+c*c), 1e-12) AS uz FROM {name}{k-1}r_)""".replace(f"{name}{k-1}r_", f"{name}{k}r")
    return out


UPS = f"{FACING}, sel AS (SELECT n.* FROM n64 n JOIN pix p USING (frame, y, x) WHERE n.ok AND p.cls < 2), {up_sql('sel', 20)}"


def up64(spark, sf):
    return G.robust_up(facing64(spark, sf), F.col("n_ok") & (F.col("cls") < 2), 20)


@register("robust_up_vector", "GEO-05", f"WITH {UPS} SELECT frame, ux, uy, uz FROM up3", "ux uy uz")
def _(spark, sf):
    return up64(spark, sf)


REG = f"""{regions_sql('msk', 4)}, rg AS (SELECT frame, label, row_number() OVER (PARTITION BY frame ORDER BY m, label) - 1 AS region FROM (SELECT frame, label, quantile_cont(gt, 0.5) AS m FROM lab JOIN pix USING (frame, y, x) GROUP BY ALL HAVING count(*) >= 8)),
 rp AS (SELECT lab.frame, y, x, region, gt, pred FROM lab JOIN rg USING (frame, label) JOIN pix USING (frame, y, x)),
 fw AS (SELECT frame, ux, uy, uz, -ux*uz / sqrt(greatest(1 - uz*uz, 1e-12)) AS ax, -uy*uz / sqrt(greatest(1 - uz*uz, 1e-12)) AS ay, (1 - uz*uz) / sqrt(greatest(1 - uz*uz, 1e-12)) AS az FROM up3)"""


def steps_sql(z: str, name: str) -> str:
    return f"""{name}_g AS (SELECT frame, region, quantile_cont((x-31.5)/60.0*{z}*ux + (y-31.5)/60.0*{z}*uy + {z}*uz, 0.5) AS h,
   max((x-31.5)/60.0*{z}*ax + (y-31.5)/60.0*{z}*ay + {z}*az) - min((x-31.5)/60.0*{z}*ax + (y-31.5)/60.0*{z}*ay + {z}*az) AS run FROM rp JOIN fw USING (frame) GROUP BY ALL),
 {name} AS (SELECT f.frame, f.step, coalesce(rise, 'nan'::DOUBLE) AS rise, coalesce(run, 'nan'::DOUBLE) AS run FROM (SELECT frame, unnest([0, 1, 2]) AS step FROM up3) f
   LEFT JOIN (SELECT *, lead(h) OVER (PARTITION BY frame ORDER BY region) - h AS rise FROM {name}_g) g ON g.frame = f.frame AND g.region = f.step)"""


STEP = f"{UPS}, msk AS (SELECT frame, y, x FROM pix WHERE e > 0.02 AND gt > 0), {REG}, {steps_sql('gt', 'sg')}, {steps_sql('pred', 'sp')}"


def _step_px(spark, sf):
    return X.pixels64(spark, sf).select("frame", "y", "x", "gt", "pred", "e")


@register("step_geometry", "GEO-06 WIN-07 WIN-08", f"WITH RECURSIVE {STEP} SELECT frame, step, rise, run FROM sg", "rise run")
def _(spark, sf):
    reg = G.tread_regions(_step_px(spark, sf), F.col("e") > 0.02, "gt", 8)
    return G.step_geometry(reg, up64(spark, sf), "gt", CAM64)


ERR = ", ".join(f"abs(p.{k} - g.{k}) AS {k}_abs, abs(p.{k} - g.{k}) / CASE WHEN isnan(g.{k}) THEN 1 ELSE greatest(abs(g.{k}), 1e-6) END AS {k}_rel" for k in ("rise", "run"))


@register("step_geometry_error", "GEO-07", f"WITH RECURSIVE {STEP} SELECT g.frame, g.step, {ERR} FROM sg g JOIN sp p USING (frame, step)", "rise_abs rise_rel run_abs run_rel")
def _(spark, sf):
    return G.step_geometry_error(_step_px(spark, sf), F.col("e") > 0.02, up64(spark, sf), CAM64, 3, 8)


@register("step_error_medians", "AGG-15", f"""WITH RECURSIVE {STEP}, er AS (SELECT {ERR} FROM sg g JOIN sp p USING (frame, step))
  SELECT {", ".join(f"quantile_cont({c}, 0.5) FILTER (NOT isnan({c})) AS {c}" for c in ("rise_abs", "rise_rel", "run_abs", "run_rel"))} FROM er""", "rise_abs rise_rel run_abs run_rel")
def _(spark, sf):
    from gridspark.plans.evaluate import step_medians
    return step_medians(G.step_geometry_error(_step_px(spark, sf), F.col("e") > 0.02, up64(spark, sf), CAM64, 3, 8))


@register("tread_levels", "GEO-08 WIN-09", f"""WITH {UPS}, h AS (SELECT frame, (x-31.5)/60.0*gt*ux + (y-31.5)/60.0*gt*uy + gt*uz AS hgt FROM pix JOIN up3 USING (frame) WHERE e > 0.0 AND gt > 0),
  l AS (SELECT frame, min(hgt) AS lo, count(*) AS n FROM h GROUP BY frame), b AS (SELECT frame, floor((hgt - lo) / 0.08)::BIGINT AS bin FROM h JOIN l USING (frame) WHERE n >= 60),
  f AS (SELECT frame, bin FROM b GROUP BY ALL HAVING count(*) >= 60), r AS (SELECT frame, count(*) AS k FROM (SELECT frame, bin, lag(bin) OVER (PARTITION BY frame ORDER BY bin) AS p FROM f) WHERE p IS NULL OR bin - p > 1 GROUP BY frame)
  SELECT frame, coalesce(k, 0) AS n_levels FROM l LEFT JOIN r USING (frame)""")
def _(spark, sf):
    return G.tread_levels(X.pixels64(spark, sf), F.col("e") > 0.0, up64(spark, sf), "gt", CAM64, 0.08, 60)


@register("planar_consistency", "GEO-09", f"""WITH {UPS}, j AS (SELECT p.frame, p.cls = 1 AS tread, p.cls = 2 AS riser, p.conf < 0.95 AS good, n.ok, abs(n.nx*ux + n.ny*uy + n.nz*uz) AS c FROM pix p JOIN n64 n USING (frame, y, x) JOIN up3 USING (frame)),
  r AS (SELECT *, tread AND c > 0.85 AS tr, riser AND c < 0.5 AS ri, CASE WHEN tread AND c > 0.85 THEN 1 - c ELSE c END AS res FROM j),
  g AS (SELECT frame, count(*) FILTER (c > 0.85 AND tread AND ok AND good) / greatest(count(*) FILTER (tread AND ok AND good), 1)::DOUBLE AS inlier,
   coalesce(sum(CASE WHEN abs(res) <= 0.1 THEN 0.5*res*res ELSE 0.1*(abs(res) - 0.05) END) FILTER ((tr OR ri) AND ok AND good), 0) / greatest(count(*) FILTER ((tr OR ri) AND ok AND good), 1) AS score FROM r GROUP BY frame)
  SELECT frame, inlier, CASE WHEN inlier >= 0.05 THEN score ELSE 0 END AS score FROM g""", "inlier score")
def _(spark, sf):
    n = facing64(spark, sf)
    px = n.withColumns({"rn" + c: F.col("n" + c) for c in "xyz"}).withColumn("r_ok", F.col("n_ok"))
    px = px.withColumn("tread", F.col("cls") == 1).withColumn("riser", F.col("cls") == 2).withColumn("good", F.col("conf") < 0.95)
    return G.planar_consistency(px, up64(spark, sf), min_inlier=0.05)


@register("theta_map", "GEO-11", f"WITH {HOLED_N}, {guided_sql('src', 'st1', 8, 5, True)} SELECT frame, y::INT AS y, x::INT AS x, CASE WHEN valid THEN acos(least(abs(c), 1.0::DOUBLE)) ELSE 'nan'::DOUBLE END AS theta FROM st1", "theta")
def _(spark, sf):
    return G.theta_map(holed_normals(spark, sf), (8, 8), (5, 5))


@register("theta_map_angles_first", "GEO-11", f"""WITH {HOLED_N}, ang AS (SELECT frame, y, x, CASE WHEN valid THEN acos(least(abs(a * (x - 3.5) / 9.0 + b * (y - 3.5) / 9.0 + c) / sqrt(pow((x - 3.5) / 9.0, 2) + pow((y - 3.5) / 9.0, 2) + 1), 1.0::DOUBLE)) ELSE 0 END AS a, 0.0 AS b, 0.0 AS c, valid FROM src), {guided_sql('ang', 'st1', 8, 4, False)}
  SELECT frame, y::INT AS y, x::INT AS x, CASE WHEN valid THEN a ELSE 'nan'::DOUBLE END AS theta FROM st1""", "theta")
def _(spark, sf):
    return G.theta_map(holed_normals(spark, sf), (8, 8), (4, 4), "theta", 10.0, "viewing_ray", (4.5, 4.5, 1.5, 1.5))


def plane_edges_sql(step: int, eps: float, deg: float, med: bool) -> str:
    """CTE ``pe(frame, y, x, edge)`` over ``pix`` and ``nrm`` on 8x8 frames."""
    import math
    refl = lambda i: f"(CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} > 7 THEN 15 - ({i}) ELSE {i} END)"
    if med:
        src = f"""nm AS (SELECT p.frame, p.y, p.x, quantile_disc(q.nx, 0.5) AS a, quantile_disc(q.ny, 0.5) AS b, quantile_disc(q.nz, 0.5) AS c FROM nrm p, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
      JOIN nrm q ON q.frame = p.frame AND q.y = {refl('p.y + dy')} AND q.x = {refl('p.x + dx')} GROUP BY ALL)"""
    else:
        src = "nm AS (SELECT frame, y, x, nx AS a, ny AS b, nz AS c FROM nrm)"
    return f"""{src}, pn AS (SELECT p.frame, p.y, p.x, p.gt, (p.x - 3.5) / 9.0 * p.gt AS px, (p.y - 3.5) / 9.0 * p.gt AS py, a / m AS a, b / m AS b, c / m AS c FROM pix p JOIN (SELECT *, sqrt(a*a + b*b + c*c) AS m FROM nm) n USING (frame, y, x)),
 pe AS (SELECT p.frame, p.y, p.x, p.gt > 0 AND coalesce(bool_or((q.gt > 0 AND greatest(abs(p.a*(q.px-p.px) + p.b*(q.py-p.py) + p.c*(q.gt-p.gt)), abs(q.a*(q.px-p.px) + q.b*(q.py-p.py) + q.c*(q.gt-p.gt))) > {eps} * p.gt)
    OR p.a*q.a + p.b*q.b + p.c*q.c < {math.cos(math.radians(deg))!r}::DOUBLE), false) AS edge
   FROM pn p LEFT JOIN pn q ON q.frame = p.frame AND abs(q.y - p.y) IN (0, {step}) AND abs(q.x - p.x) IN (0, {step}) AND (q.y <> p.y OR q.x <> p.x) GROUP BY p.frame, p.y, p.x, p.gt)"""


@register("plane_edge_mask", "GEO-12 JOIN-15", f"WITH {P8}, {N8}, {plane_edges_sql(2, 0.25, 8.0, True)} SELECT frame, y, x, edge FROM pe")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", "gt").join(spread(X.normals8(spark, sf)), ["frame", "y", "x"])
    return G.plane_edges(px, CAM8, 0.25, 2, 8.0, 2, 3).select("frame", "y", "x", "edge")


@register("camera_variant_sweep", "GEO-13", f"""WITH {P8}, v AS (SELECT * FROM (VALUES ('K', 9.0, 9.0), ('f-10', 8.1, 8.1), ('f+10', 9.9, 9.9), ('fx+10', 9.9, 9.0)) t(variant, fx, fy))
  SELECT frame, variant, avg((x - 3.5) / fx * gt) AS mx, avg((y - 3.5) / fy * gt) AS my FROM pix, v GROUP BY ALL""", "mx my")
def _(spark, sf):
    return G.camera_sweep(X.pixels8(spark, sf), CAM8).groupBy("frame", "variant").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))


def _plane_regions(spark, sf):
    """Tread and riser regions of the mosaics, the four largest of each kind."""
    px = X.pixels64(spark, sf).where("gt > 0 and cls > 0").select("frame", F.when(F.col("cls") == 1, "tread").otherwise("riser").alias("kind"), "y", "x", "gt")
    by = ["frame", "kind"]
    lab = SG.label_regions(px, F.lit(True), by)
    top = SG.largest(SG.region_sizes(lab, by).where("size >= 6"), 4, by)
    return lab.join(top, [*by, "label"], "left_semi")


def planes_sql(src: str, keys: str, rounds: int = 3) -> str:
    """Robust planes as CTE ``pln(keys, nx, ny, nz, rms, inlier, mean_z)``; the 3x3 eigenproblem in closed form."""
    out = ""
    for k in range(rounds):
        pts = src if k == 0 else f"(SELECT s.* FROM {src} s JOIN fit{k-1} f USING ({keys}) WHERE abs((px-mx)*nx + (py-my)*ny + (pz-mz)*nz) < 3 * greatest(sqrt(lam), 1e-4))"
        out += f"""cv{k} AS (SELECT {keys}, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, var_pop(px) AS a, var_pop(py) AS b, var_pop(pz) AS c, covar_pop(px, py) AS d, covar_pop(px, pz) AS e, covar_pop(py, pz) AS f FROM {pts} GROUP BY {keys}),
 ev{k} AS (SELECT *, q + 2 * p * cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((a-q)*((b-q)*(c-q) - f*f) - d*(d*(c-q) - f*e) + e*(d*f - (b-q)*e)) / (2 * p * p * p)))) / 3 + 2.0943951023931953::DOUBLE) AS l
   FROM (SELECT *, sqrt((pow(a-q, 2) + pow(b-q, 2) + pow(c-q, 2) + 2*(d*d + e*e + f*f)) / 6) AS p FROM (SELECT *, (a + b + c) / 3 AS q FROM cv{k}))),
 cr{k} AS (SELECT {keys}, mx, my, mz, greatest(l, 0.0::DOUBLE) AS lam, unnest([{{'x': d*f - e*(b-l), 'y': e*d - (a-l)*f, 'z': (a-l)*(b-l) - d*d}}, {{'x': d*(c-l) - e*f, 'y': e*e - (a-l)*(c-l), 'z': (a-l)*f - d*e}}, {{'x': (b-l)*(c-l) - f*f, 'y': f*e - d*(c-l), 'z': d*f - (b-l)*e}}]) AS v FROM ev{k}),
 fit{k} AS (SELECT {keys}, mx, my, mz, lam, v.x / n * sg AS nx, v.y / n * sg AS ny, v.z / n * sg AS nz FROM (SELECT *, sqrt(v.x*v.x + v.y*v.y + v.z*v.z) AS n, CASE WHEN v.z > 0 THEN -1.0 ELSE 1.0 END AS sg, row_number() OVER (PARTITION BY {keys} ORDER BY v.x*v.x + v.y*v.y + v.z*v.z DESC) AS k FROM cr{k}) WHERE k = 1),
 """
    z = rounds - 1
    return out + f"""pln AS (SELECT {keys}, nx, ny, nz, sqrt(avg(r * r) FILTER (abs(r) < 3 * greatest(sqrt(lam), 1e-4))) AS rms, avg((abs(r) < 3 * greatest(sqrt(lam), 1e-4))::INT) AS inlier, avg(pz) AS mean_z
   FROM (SELECT s.*, nx, ny, nz, lam, (px-mx)*nx + (py-my)*ny + (pz-mz)*nz AS r FROM {src} s JOIN fit{z} USING ({keys})) GROUP BY {keys}, nx, ny, nz)"""


PREG = f"""{P64}, msk AS (SELECT frame, CASE WHEN cls = 1 THEN 'tread' ELSE 'riser' END AS kind, y, x FROM pix WHERE gt > 0 AND cls > 0), {regions_sql('msk', 4, 'frame, kind')},
 tp AS (SELECT frame, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY frame, kind ORDER BY size DESC, label) AS k FROM (SELECT frame, kind, label, count(*) AS size FROM lab GROUP BY ALL HAVING count(*) >= 6)) WHERE k <= 4)"""


@register("robust_plane_fit", "GEO-10", f"""WITH RECURSIVE {PREG}, pts AS (SELECT lab.frame, lab.kind, lab.label, (x-31.5)/60.0*gt AS px, (y-31.5)/60.0*gt AS py, gt AS pz FROM lab SEMI JOIN tp USING (frame, kind, label) JOIN pix USING (frame, y, x)),
  {planes_sql('pts', 'frame, kind, label')} SELECT * FROM pln""", "nx ny nz rms inlier mean_z")
def _(spark, sf):
    pts = G.with_points(_plane_regions(spark, sf), "gt", CAM64)
    return G.robust_planes(pts, ["frame", "kind", "label"])


@register("plane_quality_by_camera", "AGG-43 JOIN-27", f"""WITH RECURSIVE {PREG}, vr AS (SELECT * FROM (VALUES ('K', 60.0, 60.0), ('f-10', 54.0, 54.0), ('f+10', 66.0, 66.0), ('fx+10', 66.0, 60.0)) t(variant, fx, fy)),
  pts AS (SELECT variant, lab.frame, lab.kind, lab.label, (x-31.5)/fx*gt AS px, (y-31.5)/fy*gt AS py, gt AS pz FROM lab SEMI JOIN tp USING (frame, kind, label) JOIN pix USING (frame, y, x), vr), {planes_sql('pts', 'variant, frame, kind, label')},
  pr AS (SELECT a.variant, b.kind, degrees(acos(least(1.0::DOUBLE, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) AS ang FROM pln a JOIN pln b ON a.variant = b.variant AND a.frame = b.frame AND a.kind = 'tread' AND (b.kind = 'riser' OR a.label < b.label)),
  vl AS (SELECT variant, CASE WHEN kind = 'tread' THEN 'tread_tread' ELSE 'tread_riser' END AS what, CASE WHEN kind = 'tread' THEN ang ELSE abs(90 - ang) END AS v FROM pr UNION ALL SELECT variant, 'rms_mm', rms * 1000 FROM pln WHERE kind = 'tread' UNION ALL SELECT variant, 'rms_pct', 100 * rms / mean_z FROM pln WHERE kind = 'tread')
  SELECT variant, what, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM vl GROUP BY ALL""", "p50 p90")
def _(spark, sf):
    from gridspark.plans.evaluate import plane_quality
    return plane_quality(_plane_regions(spark, sf), CAM64)


@register("zbuffer_visibility", "JOIN-12", f"""WITH {P64}, t AS (SELECT frame, y, x, gt, 60.0 * ((x - 31.5) * gt / 60.0) / gt + 31.5 AS uu, rint_y FROM (SELECT *, round_even(60.0 * ((y - 31.5) * gt / 60.0 + 0.3) / gt + 31.5, 0)::INT AS rint_y FROM pix WHERE gt > 0)),
  c AS (SELECT *, round_even(uu, 0)::INT AS cx FROM t WHERE rint_y BETWEEN 0 AND 63), z AS (SELECT frame, rint_y, cx, min(gt) AS zmin FROM c GROUP BY ALL)
  SELECT frame, y, x, gt <= zmin + 0.05 * gt AS lit FROM c JOIN z USING (frame, rint_y, cx)""")
def _(spark, sf):
    from gridspark.operators.augment import zbuffer
    px = X.pixels64(spark, sf).where("gt > 0").withColumn("h", F.lit(64)).withColumn("w", F.lit(64))
    z = zbuffer(px.select("frame", "y", "x", "h", "w", F.col("gt").alias("z")), CAM64, (0.0, -0.3, 0.0))
    return z.where("inside").select("frame", "y", "x", (F.col("zp") <= F.col("zmin") + 0.05 * F.col("zp")).alias("lit"))


ROT = (0.9998, 0.0, 0.02, 0.0, 1.0, 0.0, -0.02, 0.0, 0.9998)
REPRO = """q AS (SELECT frame, z0, 0.9998*px + 0.02*z0 + 0.05 AS qx, py - 0.01 AS qy, -0.02*px + 0.9998*z0 + 0.0 AS qz FROM (SELECT frame, gt AS z0, (x-31.5)/60.0*gt AS px, (y-31.5)/60.0*gt AS py FROM pix WHERE gt > 0)),
 k AS (SELECT frame, z0, qz, round_even(55.0 * qx / qz + 23.5, 0)::INT AS x, round_even(55.0 * qy / qz + 23.5, 0)::INT AS y FROM q WHERE qz > 1e-6)"""


@register("depth_reprojection", "JOIN-14", f"WITH {P64}, {REPRO} SELECT frame, y, x, min(qz) AS z FROM k WHERE x BETWEEN 0 AND 47 AND y BETWEEN 0 AND 47 GROUP BY ALL", "z")
def _(spark, sf):
    return G.reproject(X.pixels64(spark, sf), "gt", CAM64, ROT, (0.05, -0.01, 0.0), (55.0, 55.0, 23.5, 23.5), (48, 48))


@register("alignment_sweep", "BMK-18 AGG-38", f"""WITH {P64}, v AS (SELECT d, dist, zm FROM (SELECT unnest(['d2c', 'c2d']) AS d), (SELECT unnest([false, true]) AS dist), (SELECT unnest(['color', 'depth']) AS zm)),
  s AS (SELECT frame, gt AS z0, (x-31.5)/60.0*gt AS px, (y-31.5)/60.0*gt AS py FROM pix WHERE gt > 0),
  q AS (SELECT frame, z0, d, CASE WHEN d = 'd2c' THEN 0.9998*px + 0.0*py + 0.02*z0 + 0.05 ELSE 0.9998*(px-0.05) + 0.0*(py+0.01) - 0.02*(z0-0.0) END AS qx, CASE WHEN d = 'd2c' THEN py - 0.01 ELSE py + 0.01 END AS qy,
     CASE WHEN d = 'd2c' THEN -0.02*px + 0.9998*z0 + 0.0 ELSE 0.02*(px-0.05) + 0.9998*z0 END AS qz FROM s, (SELECT unnest(['d2c', 'c2d']) AS d)),
  w AS (SELECT *, qx/qz AS u, qy/qz AS v, pow(qx/qz, 2) + pow(qy/qz, 2) AS r2 FROM q WHERE qz > 1e-6),
  e AS (SELECT *, (1 + r2 * (0.1 + r2 * (-0.05 + r2 * 0.01))) / (1 + r2 * (0.02 + r2 * (0.0 + r2 * 0.003))) AS rad FROM w),
  f AS (SELECT e.frame, e.z0, e.qz, e.d, vv.dist, vv.zm, CASE WHEN vv.dist THEN u * rad + 0.002 * u * v - 0.002 * (r2 + 2*u*u) ELSE u END AS a, CASE WHEN vv.dist THEN v * rad + 0.001 * (r2 + 2*v*v) - 0.004 * u * v ELSE v END AS b FROM e JOIN v vv ON vv.d = e.d),
  g AS (SELECT frame, d, dist, zm, round_even(60.0*a + 31.5, 0)::INT AS x, round_even(60.0*b + 31.5, 0)::INT AS y, min(CASE WHEN zm = 'color' THEN qz ELSE z0 END) AS z FROM f GROUP BY ALL),
  r AS (SELECT v.d, v.dist, v.zm, p.gt, coalesce(g.z, 0.0) AS z FROM pix p JOIN v ON true LEFT JOIN g ON g.frame = p.frame AND g.y = p.y AND g.x = p.x AND g.d = v.d AND g.dist = v.dist AND g.zm = v.zm)
  SELECT d AS direction, dist AS use_dist, zm AS z_mode, count(*) FILTER (gt > 0 AND z > 0) / greatest(count(*) FILTER (gt > 0 OR z > 0), 1)::DOUBLE AS iou,
   avg((abs(z - gt) <= 0.01)::INT) FILTER (gt > 0 AND z > 0) AS within_1, avg((abs(z - gt) <= 0.02)::INT) FILTER (gt > 0 AND z > 0) AS within_2, avg((abs(z - gt) <= 0.05)::INT) FILTER (gt > 0 AND z > 0) AS within_5,
   quantile_cont(abs(z - gt), 0.5) FILTER (gt > 0 AND z > 0) AS median_abs FROM r GROUP BY ALL""", "iou within_1 within_2 within_5 median_abs")
def _(spark, sf):
    from gridspark.plans.evaluate import alignment_sweep
    return alignment_sweep(X.pixels64(spark, sf).select("frame", "y", "x", "gt"), CAM64, ROT, (0.05, -0.01, 0.0), CAM64, DIST, (64, 64), (0.01, 0.02, 0.05))


ESTIMATORS = {"constant": "normals_constant", "cross_product": "normals_cross_product", "facing": "normals_facing_camera"}


@register("normal_estimators_all", "UDF-03", " UNION ALL ".join(f"SELECT '{k}' AS estimator, frame, count(*) FILTER (ok) AS n, avg(nz) AS nz FROM ({REGISTRY[q].sql}) GROUP BY frame" for k, q in ESTIMATORS.items()), "nz")
def _(spark, sf):
    from functools import reduce

    from gridspark.functions.estimators import NORMALS
    if set(NORMALS) != set(ESTIMATORS):
        raise ValueError("an estimator has no frames")
    small, large = X.pixels8(spark, sf).select("frame", "y", "x", "gt"), X.pixels64(spark, sf).select("frame", "y", "x", "gt")
    given = {"constant": (small, {}), "cross_product": (small, {"depth_edge_rel": 0.3}), "facing": (large, {"max_rel_jump": 0.4})}
    rows = [NORMALS[k](px, "gt", CAM64 if px is large else CAM8, **more).groupBy("frame").agg(F.count_if("n_ok").alias("n"), F.avg("nz").alias("nz")).select(F.lit(k).alias("estimator"), "frame", "n", "nz")
            for k, (px, more) in given.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


ZONED = STEP.replace("WITH RECURSIVE ", "") + """, sc AS (SELECT frame, gt AS g, least(greatest(pred, 0.1::DOUBLE), 3.5::DOUBLE) AS p, cls, conf, (gt > 0.1 AND gt < 3.5) AS valid FROM pix)"""


@register("zone_report", "BMK-02 AGG-15", f"""WITH RECURSIVE {ZONED}, z AS (SELECT frame, g, p, q.zone AS zone, (valid AND q.inside) AS valid FROM (SELECT *, unnest([{{'zone': 'full', 'inside': true}}, {{'zone': 'stairs', 'inside': cls > 0}}, {{'zone': 'edge', 'inside': conf >= 0.8}}]) AS q FROM sc)),
  fr AS (SELECT frame, zone, {AGGS} FROM z GROUP BY frame, zone), zs AS (SELECT zone, avg(absrel) FILTER (NOT isnan(absrel)) AS absrel, avg(rmse) FILTER (NOT isnan(rmse)) AS rmse, avg(delta1) FILTER (NOT isnan(delta1)) AS delta1, count(*) FILTER (NOT isnan(absrel)) AS n FROM fr GROUP BY zone),
  mi AS (SELECT count(*) AS n_frames, avg(m) AS input_invalid_frac FROM (SELECT frame, avg((e2 < 0)::INT) AS m FROM pix GROUP BY frame)), er AS (SELECT {ERR} FROM sg g JOIN sp p USING (frame, step)),
  md AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) FILTER (NOT isnan({c})) AS step_{c}" for c in ("rise_abs", "rise_rel", "run_abs", "run_rel"))} FROM er)
  SELECT {", ".join(f"(SELECT {c} FROM zs WHERE zone = '{z}') AS {z}_{c}" for z in ("full", "stairs", "edge") for c in ("absrel", "rmse", "delta1", "n"))}, n_frames, input_invalid_frac, step_rise_abs, step_rise_rel, step_run_abs, step_run_rel FROM mi, md""",
          " ".join(f"{z}_{c}" for z in ("full", "stairs", "edge") for c in ("absrel", "rmse", "delta1")) + " input_invalid_frac step_rise_abs step_rise_rel step_run_abs step_run_rel")
def _(spark, sf):
    from gridspark.plans.evaluate import zone_report
    px = X.pixels64(spark, sf)
    errors = G.step_geometry_error(_step_px(spark, sf), F.col("e") > 0.02, up64(spark, sf), CAM64, 3, 8)
    zones = {"full": F.lit(True), "stairs": F.col("cls") > 0, "edge": F.col("conf") >= 0.8}
    _, doc = zone_report(px, zones, CFG, errors, F.col("e2") < 0)
    return doc.select(*[F.col(f"{z}.{c}").alias(f"{z}_{c}") for z in zones for c in ("absrel", "rmse", "delta1", "n")], "n_frames", "input_invalid_frac", "step_rise_abs", "step_rise_rel", "step_run_abs", "step_run_rel")
