"""Raster operators: resizing, filters, morphology, nearest fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import N8, P8, P64, u_sql
from gridspark.catalog.registry import register
from gridspark.layouts import with_size
from gridspark.operators import raster as R
from gridspark.operators import sampling as SM

SIZE = "sz AS (SELECT frame, max(y) + 1 AS h, max(x) + 1 AS w FROM pix GROUP BY frame)"


def refl(i: str, n: str) -> str:
    """Reflected index for any offset."""
    m = f"((({i}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END)"


def gauss_w(name: str, sigma: float, n: int = 8) -> str:
    """CTE ``name(o, i, w)``: the Gaussian as a weight table on n pixels."""
    r = int(4.0 * sigma + 0.5)
    return f"""{name}_k AS (SELECT k, exp(-0.5 * pow(k / {sigma}::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow(j / {sigma}::DOUBLE, 2))) FROM (SELECT unnest(range({-r}, {r + 1})) AS j)) AS g FROM (SELECT unnest(range({-r}, {r + 1})) AS k)),
 {name} AS (SELECT o, {refl('o + k', str(n))} AS i, sum(g) AS w FROM (SELECT unnest(range({n})) AS o), {name}_k GROUP BY ALL)"""


def cubic(t: str, a: float) -> str:
    return f"""(CASE WHEN abs({t}) <= 1 THEN (({a + 2}::DOUBLE) * abs({t}) - ({a + 3}::DOUBLE)) * abs({t}) * abs({t}) + 1
      WHEN abs({t}) < 2 THEN ((({a}::DOUBLE) * abs({t}) - ({5 * a}::DOUBLE)) * abs({t}) + ({8 * a}::DOUBLE)) * abs({t}) - ({4 * a}::DOUBLE) ELSE 0.0 END)"""


def bicubic_w(name: str, n: int, out: int) -> str:
    return f"""{name} AS (SELECT o, greatest(0, least({n - 1}, lo + d)) AS i, sum({cubic('(s - (lo + d))', -0.75)}) AS w FROM (
   SELECT o, (o + 0.5::DOUBLE) * {n} / {out} - 0.5 AS s, floor((o + 0.5::DOUBLE) * {n} / {out} - 0.5)::INT AS lo FROM (SELECT unnest(range({out})) AS o)), (SELECT unnest([-1, 0, 1, 2]) AS d) GROUP BY ALL)"""


def bilinear_w(name: str, n: int, out: int) -> str:
    return f"""{name} AS (SELECT o, least({n - 1}, lo + d) AS i, sum(CASE WHEN d = 0 THEN 1 - (s - lo) ELSE s - lo END) AS w FROM (
   SELECT o, s, floor(s)::INT AS lo FROM (SELECT o, greatest((o + 0.5::DOUBLE) * {n} / {out} - 0.5, 0.0::DOUBLE) AS s FROM (SELECT unnest(range({out})) AS o))), (SELECT unnest([0, 1]) AS d) GROUP BY ALL)"""


def bicubic_aa_w(name: str, n: int, out: int) -> str:
    sc = n / out
    wide = max(sc, 1.0)
    return f"""{name}_r AS (SELECT o, i, {cubic(f'((i - (o + 0.5::DOUBLE) * {sc}::DOUBLE + 0.5) / {wide}::DOUBLE)', -0.5)} AS g FROM (SELECT unnest(range({out})) AS o), (SELECT unnest(range({n})) AS i)
    WHERE i >= greatest(trunc((o + 0.5::DOUBLE) * {sc}::DOUBLE - {2 * wide}::DOUBLE + 0.5), 0) AND i < least(trunc((o + 0.5::DOUBLE) * {sc}::DOUBLE + {2 * wide}::DOUBLE + 0.5), {n})),
 {name} AS (SELECT o, i, g / sum(g) OVER (PARTITION BY o) AS w FROM {name}_r)"""


def sep(src: str, val: str, wy: str, wx: str) -> str:
    """Apply two weight tables to ``src``: (frame, y, x, v)."""
    return f"""(SELECT a.frame, wy.o::INT AS y, a.x, sum(a.v * wy.w) AS v FROM (SELECT s.frame, s.y, wx.o::INT AS x, sum(s.{val} * wx.w) AS v FROM {src} s JOIN {wx} wx ON wx.i = s.x GROUP BY s.frame, s.y, wx.o) a
   JOIN {wy} wy ON wy.i = a.y GROUP BY a.frame, wy.o, a.x)"""


@register("resize_nearest", "RST-01", f"""WITH {P8} SELECT frame, oy::INT AS y, ox::INT AS x, gt FROM pix, (SELECT unnest(range(5)) AS oy), (SELECT unnest(range(12)) AS ox)
  WHERE pix.y = floor(oy * 8 / 5.0) AND pix.x = floor(ox * 8 / 12.0)""", "gt")
def _(spark, sf):
    return R.resize_nearest(X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", "gt"), F.lit(5), F.lit(12)).select("frame", "y", "x", "gt")


@register("resize_bilinear", "RST-02", f"WITH {P8}, {bilinear_w('wy', 8, 13)}, {bilinear_w('wx', 8, 5)} SELECT frame, y, x, v AS z FROM {sep('pix', 'pred', 'wy', 'wx')}", "z")
def _(spark, sf):
    return R.resize(X.pixels8(spark, sf), "pred", F.lit(13), F.lit(5), "bilinear").withColumnRenamed("pred", "z")


@register("resize_bicubic", "RST-03", f"WITH {P8}, {bicubic_w('wy', 8, 19)}, {bicubic_w('wx', 8, 3)} SELECT frame, y, x, v AS z FROM {sep('pix', 'pred', 'wy', 'wx')}", "z")
def _(spark, sf):
    return R.resize(X.pixels8(spark, sf), "pred", F.lit(19), F.lit(3), "bicubic").withColumnRenamed("pred", "z")


@register("resize_bicubic_antialias", "RST-04", f"WITH {P8}, {bicubic_aa_w('wy', 8, 2)}, {bicubic_aa_w('wx', 8, 11)} SELECT frame, y, x, v AS z FROM {sep('pix', 'pred', 'wy', 'wx')}", "z")
def _(spark, sf):
    return R.resize(X.pixels8(spark, sf), "pred", F.lit(2), F.lit(11), "bicubic_aa").withColumnRenamed("pred", "z")


@register("resize_sparse", "RST-05", f"""WITH {P64}, {SIZE}, s AS (SELECT frame, y, x, h, w, CASE WHEN conf > 0.8 THEN gt ELSE 0 END AS z FROM pix JOIN sz USING (frame))
  SELECT frame, ny AS y, nx AS x, arg_max(z, y * 1000 + x) AS z FROM (SELECT *, (y * 24 // h)::INT AS ny, (x * 20 // w)::INT AS nx FROM s WHERE z > 0) GROUP BY frame, ny, nx""", "z")
def _(spark, sf):
    px = with_size(X.pixels64(spark, sf)).withColumn("z", F.when(F.col("conf") > 0.8, F.col("gt")).otherwise(0.0))
    return R.resize_sparse(px, "z", F.lit(24), F.lit(20)).select("frame", "y", "x", "z")


@register("downsample_factor", "RST-06", f"WITH {P8}, {bicubic_w('wq', 8, 2)} SELECT frame, y, x, v AS z FROM {sep('pix', 'gt', 'wq', 'wq')}", "z")
def _(spark, sf):
    return R.downsample(X.pixels8(spark, sf).select("frame", "y", "x", "h", "w", F.col("gt").alias("z")), "z", 4)


NEAREST = P64 + """, s AS (SELECT frame, y, x, CASE WHEN conf > 0.7 THEN gt ELSE 0 END AS z FROM pix),
 cand AS (SELECT a.frame, a.y, a.x, arg_min(b.z, (((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x))::BIGINT * 1000000 + b.y * 1000 + b.x)) AS nz, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d2
   FROM s a JOIN s b ON a.frame = b.frame AND b.z > 0 AND abs(a.y - b.y) <= 20 AND abs(a.x - b.x) <= 20 WHERE a.z <= 0 GROUP BY ALL)"""


def _sparse64(spark, sf):
    return X.pixels64(spark, sf).select("frame", "y", "x", F.when(F.col("conf") > 0.7, F.col("gt")).otherwise(0.0).alias("z"))


@register("fill_nearest", "RST-07 JOIN-17", f"WITH {NEAREST} SELECT frame, y, x, CASE WHEN z > 0 THEN z ELSE nz END AS z FROM s LEFT JOIN cand USING (frame, y, x)", "z")
def _(spark, sf):
    return R.fill_nearest(_sparse64(spark, sf), "z")


@register("fill_nearest_limited", "RST-07", f"WITH {NEAREST} SELECT frame, y, x, CASE WHEN z > 0 THEN z WHEN d2 <= 2.25 THEN nz ELSE 0 END AS z FROM s LEFT JOIN cand USING (frame, y, x)", "z")
def _(spark, sf):
    return R.fill_nearest(_sparse64(spark, sf), "z", 1.5)


@register("fill_nan_in_target", "RST-07", f"""WITH {P8}, s AS (SELECT frame, y, x, CASE WHEN conf > 0.8 THEN 'nan'::DOUBLE ELSE e END AS t, gt > 0 AS target FROM pix),
  c AS (SELECT a.frame, a.y, a.x, arg_min(b.t, (((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) * 10000 + b.y * 100 + b.x)) AS nt FROM s a JOIN s b ON a.frame = b.frame AND NOT isnan(b.t) WHERE isnan(a.t) AND a.target GROUP BY ALL)
  SELECT frame, y, x, CASE WHEN isnan(t) AND target THEN coalesce(nt, 0) ELSE t END AS t FROM s LEFT JOIN c USING (frame, y, x)""", "t")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", "gt", F.when(F.col("conf") > 0.8, float("nan")).otherwise(F.col("e")).alias("t"))
    return R.fill_nan_nearest(px, "t", F.col("gt") > 0).select("frame", "y", "x", "t")


@register("distance_transform", "RST-08", f"WITH {NEAREST} SELECT frame, y, x, CASE WHEN z > 0 THEN 0.0 ELSE sqrt(d2) END AS d FROM s LEFT JOIN cand USING (frame, y, x)", "d")
def _(spark, sf):
    return R.distance_to(_sparse64(spark, sf), F.col("z") > 0, "d").select("frame", "y", "x", "d")


@register("block_mean", "RST-09", f"""WITH {P64}, b AS (SELECT frame, (y // 8)::INT AS b_y, (x // 8)::INT AS b_x, sum(gt) FILTER (gt > 0) AS s, count(*) FILTER (gt > 0) AS n FROM pix GROUP BY ALL)
  SELECT frame, b_y AS "by", b_x AS bx, CASE WHEN n >= 57.6 THEN s / n ELSE 0 END AS lr, n >= 57.6 AS lr_valid FROM b""", "lr")
def _(spark, sf):
    return R.block_mean(X.pixels64(spark, sf), "gt", 8, 0.9)


def stencil(src: str, r: int, aggs: str, h: str = "8", w: str = "8", border: str = "reflect") -> str:
    iy, ix = ("least(greatest(p.y + dy, 0), h - 1)", "least(greatest(p.x + dx, 0), w - 1)") if border == "replicate" else (refl("p.y + dy", h), refl("p.x + dx", w))
    return f"""SELECT p.frame, p.y, p.x, {aggs} FROM {src} p, (SELECT unnest(range({-r}, {r + 1})) AS dy), (SELECT unnest(range({-r}, {r + 1})) AS dx)
   JOIN {src} q ON q.frame = p.frame AND q.y = {iy} AND q.x = {ix} GROUP BY p.frame, p.y, p.x"""


@register("box_mean_reflect", "RST-10", f"WITH {P8} {stencil('pix', 2, 'avg(q.gt) AS z')}", "z")
def _(spark, sf):
    return R.box_mean(X.pixels8(spark, sf), "gt", 5, "z").select("frame", "y", "x", "z")


@register("box_mean_valid_only", "RST-10", f"""WITH {P64} SELECT p.frame, p.y, p.x, coalesce(avg(q.gt) FILTER (q.gt > 0), 0.0) AS z, bool_and(q.gt > 0) AS full_window FROM pix p
  JOIN pix q ON q.frame = p.frame AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY ALL""", "z")
def _(spark, sf):
    px = X.pixels64(spark, sf).withColumn("v", F.col("gt") > 0)
    return R.box_mean_valid(px, "gt", "v", 5, "z").select("frame", "y", "x", "z", F.col("z_full").alias("full_window"))


@register("box_std", "RST-11", f"WITH {P8} {stencil('pix', 3, 'sqrt(greatest(avg(q.conf * q.conf) - pow(avg(q.conf), 2), 0.0::DOUBLE)) AS s')}", "s")
def _(spark, sf):
    return R.box_std(X.pixels8(spark, sf), "conf", 7, "s").select("frame", "y", "x", "s")


@register("gaussian_smooth", "RST-12", f"WITH {P8}, {gauss_w('wg', 1.5)} SELECT frame, y, x, v AS z FROM {sep('pix', 'gt', 'wg', 'wg')}", "z")
def _(spark, sf):
    return R.gaussian(X.pixels8(spark, sf).withColumn("z", F.col("gt")), "z", 1.5)


@register("gaussian_valid_only", "RST-12", f"""WITH {P8}, one AS (SELECT *, (gt > 0)::INT::DOUBLE AS d FROM pix), {gauss_w('wg', 1.0)}
  SELECT frame, y, x, a.v / greatest(b.v, 1e-8) AS z FROM {sep('pix', 'gt', 'wg', 'wg')} a JOIN {sep('one', 'd', 'wg', 'wg')} b USING (frame, y, x)""", "z")
def _(spark, sf):
    return R.gaussian_valid(X.pixels8(spark, sf).withColumn("z", F.col("gt")), "z", F.col("gt") > 0, 1.0)


@register("min_max_filter", "RST-13", f"""WITH {P64} SELECT p.frame, p.y, p.x, min(q.gt) AS lo, max(q.gt) AS hi FROM pix p
  JOIN pix q ON q.frame = p.frame AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL""", "lo hi")
def _(spark, sf):
    px = R.extreme_filter(X.pixels64(spark, sf), F.col("gt"), 3, "lo", "min")
    return R.extreme_filter(px, F.col("gt"), 3, "hi", "max").select("frame", "y", "x", "lo", "hi")


@register("median_filter", "RST-14", f"WITH {P8} {stencil('pix', 2, 'quantile_disc(q.gt, 0.5) AS z')}", "z")
def _(spark, sf):
    return R.median_filter(X.pixels8(spark, sf).withColumn("z", F.col("gt")), ["z"], 5).select("frame", "y", "x", "z")


NEAR3 = "q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1"
MORPH = P64 + f""", m AS (SELECT frame, y, x, cls = 1 AS m FROM pix),
 dil AS (SELECT p.frame, p.y, p.x, bool_or(q.m) AS m FROM m p JOIN m q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL),
 ero AS (SELECT p.frame, p.y, p.x, bool_and(q.m) AND count(*) = 9 AS m FROM m p JOIN m q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL),
 opn AS (SELECT p.frame, p.y, p.x, bool_or(q.m) AS m FROM ero p JOIN ero q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL),
 crs AS (SELECT p.frame, p.y, p.x, bool_or(q.m) AS m FROM m p JOIN m q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) <= 2 GROUP BY ALL)"""


@register("morphology_square", "RST-15", f"WITH {MORPH} SELECT frame, y, x, dil.m AS dilated, ero.m AS eroded, opn.m AS opened, crs.m AS crossed FROM dil JOIN ero USING (frame, y, x) JOIN opn USING (frame, y, x) JOIN crs USING (frame, y, x)")
def _(spark, sf):
    m = X.pixels64(spark, sf).select("frame", "y", "x", (F.col("cls") == 1).alias("m"))
    # the four masks side by side, so that one grid is read once
    px = m.withColumn("dilated", F.col("m")).withColumn("eroded", F.col("m")).withColumn("opened", F.col("m")).withColumn("crossed", F.col("m"))
    px = R.opened(R.erode(R.dilate(px, "dilated"), "eroded"), "opened")
    return R.dilate_cross(px, "crossed", 2).drop("m")


@register("morphology_closing", "RST-15", f"""WITH {P64}, {SIZE}, pad AS (SELECT a.frame, py AS y, px AS x, (cls = 1) AS m FROM (SELECT frame, h, w, unnest(range(-1, h + 1)) AS py FROM sz) a, (SELECT unnest(range(-1, 65)) AS px)
    JOIN pix q ON q.frame = a.frame AND q.y = least(greatest(py, 0), h - 1) AND q.x = least(greatest(px, 0), w - 1)),
  d AS (SELECT p.frame, p.y, p.x, bool_or(q.m) AS m FROM pad p JOIN pad q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL)
  SELECT p.frame, p.y::INT AS y, p.x::INT AS x, bool_and(q.m) AS closed FROM d p JOIN d q ON q.frame = p.frame AND {NEAR3} JOIN sz ON sz.frame = p.frame WHERE p.y >= 0 AND p.x >= 0 AND p.y < h AND p.x < w GROUP BY p.frame, p.y, p.x""")
def _(spark, sf):
    px = with_size(X.pixels64(spark, sf).select("frame", "y", "x", (F.col("cls") == 1).alias("closed")))
    return R.closed(px, "closed").select("frame", "y", "x", "closed")


SOB = "sum(q.{v} * (q.x - p.x) * (2 - abs(q.y - p.y))) AS {g}x, sum(q.{v} * (q.y - p.y) * (2 - abs(q.x - p.x))) AS {g}y"


@register("sobel_gradients", "RST-16", f"WITH {P64} SELECT p.frame, p.y, p.x, {SOB.format(v='gt', g='g')} FROM pix p JOIN pix q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL", "gx gy")
def _(spark, sf):
    return R.sobel(X.pixels64(spark, sf), "gt").select("frame", "y", "x", "gx", "gy")


@register("reconstruction_error_map", "RST-19", f"""WITH {P64}, g AS (SELECT p.frame, p.y, p.x, {SOB.format(v='pred', g='p')}, {SOB.format(v='gt', g='t')}, bool_and(q.gt > 0) AS ok FROM pix p JOIN pix q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL)
  SELECT frame, y, x, CASE WHEN gt > 0 THEN abs(pred - gt) ELSE 0 END + CASE WHEN ok THEN 0.1 * (abs(px - tx) + abs(py - ty)) ELSE 0 END AS err FROM pix JOIN g USING (frame, y, x)""", "err")
def _(spark, sf):
    from gridspark.plans.evaluate import reconstruction_error
    return reconstruction_error(X.pixels64(spark, sf)).select("frame", "y", "x", "err")


@register("bilateral_smooth", "RST-17", f"""WITH {P8}, d AS (SELECT frame, greatest(stddev_pop(gt), 1e-9) * 0.25 AS rs, greatest(stddev_pop(pred), 1e-9) * 0.25 AS rt FROM pix GROUP BY frame),
  w AS (SELECT p.frame, p.y, p.x, q.gt AS s, q.pred AS t, exp(-0.5 * (dy*dy + dx*dx) / (1.0 + 1e-12)) * exp(-0.5 * (pow((q.gt - p.gt) / rs, 2) + pow((q.pred - p.pred) / rt, 2))) AS g
   FROM pix p JOIN d USING (frame), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)
   JOIN pix q ON q.frame = p.frame AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7))
  SELECT frame, y, x, sum(g * s) / sum(g) AS s, sum(g * t) / sum(g) AS t FROM w GROUP BY ALL""", "s t")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", F.col("gt").alias("s"), F.col("pred").alias("t"))
    return R.bilateral(px, "s", "t", 1.0, 0.25, 10)


def guided_sql(src: str, name: str, n: int, out: int, normals: bool) -> str:
    """One guided step as CTEs; ``src`` has (frame, y, x, a, b, c, valid)."""
    near = "acos(least(abs(t.a * r.a + t.b * r.b + t.c * r.c), 1.0::DOUBLE)) <= 0.17453292519943295" if normals else "abs(t.a - r.a) <= 0.17453292519943295"
    body = f"""{name}_g AS (SELECT o, d, least(greatest(lo + d, 0), {n - 1}) AS i, CASE WHEN d = 0 THEN 1 - f ELSE f END AS w, (f >= 0.5) = (d = 1) AS r FROM (
    SELECT o, floor(s)::INT AS lo, s - floor(s) AS f FROM (SELECT o, (o + 0.5::DOUBLE) * {n} / {out} - 0.5 AS s FROM (SELECT unnest(range({out})) AS o))), (SELECT unnest([0, 1]) AS d)),
 {name}_t AS (SELECT s.frame, gy.o AS y, gx.o AS x, s.a, s.b, s.c, s.valid, gy.w * gx.w AS w, gy.r AND gx.r AS ref FROM {src} s JOIN {name}_g gy ON gy.i = s.y JOIN {name}_g gx ON gx.i = s.x),
 {name}_s AS (SELECT t.frame, t.y, t.x, bool_or(r.valid) AS rv, coalesce(sum(t.w) FILTER (t.valid AND {near}), 0.0) AS tw, sum(t.w * t.a) FILTER (t.valid AND {near}) AS a, sum(t.w * t.b) FILTER (t.valid AND {near}) AS b, sum(t.w * t.c) FILTER (t.valid AND {near}) AS c
   FROM {name}_t t JOIN {name}_t r ON r.frame = t.frame AND r.y = t.y AND r.x = t.x AND r.ref GROUP BY ALL)"""
    if normals:
        return body + f""", {name}_n AS (SELECT *, sqrt(a*a + b*b + c*c) AS m FROM (SELECT frame, y, x, rv AND tw > 0 AS ok, a / greatest(tw, 1e-12) AS a, b / greatest(tw, 1e-12) AS b, c / greatest(tw, 1e-12) AS c FROM {name}_s)),
 {name} AS (SELECT frame, y, x, CASE WHEN ok AND m > 1e-6 THEN a / m ELSE 0 END AS a, CASE WHEN ok AND m > 1e-6 THEN b / m ELSE 0 END AS b, CASE WHEN ok AND m > 1e-6 THEN c / m ELSE 0 END AS c, ok AND m > 1e-6 AS valid FROM {name}_n)"""
    return body + f""", {name} AS (SELECT frame, y, x, CASE WHEN rv AND tw > 0 THEN a / greatest(tw, 1e-12) ELSE 0 END AS a, 0.0 AS b, 0.0 AS c, rv AND tw > 0 AS valid FROM {name}_s)"""


HOLED_N = N8 + f""", src AS (SELECT frame, y, x, CASE WHEN v THEN nx ELSE 0 END AS a, CASE WHEN v THEN ny ELSE 0 END AS b, CASE WHEN v THEN nz ELSE 0 END AS c, v AS valid FROM (SELECT *, nx > -0.12 AS v FROM nrm))"""


def holed_normals(spark, sf):
    n = X.normals8(spark, sf)
    v = F.col("nx") > -0.12
    return n.select("frame", "y", "x", *[F.when(v, F.col(c)).otherwise(0.0).alias(c) for c in ("nx", "ny", "nz")], v.alias("valid"))


@register("guided_resize_normals", "RST-18", f"WITH {HOLED_N}, {guided_sql('src', 'st1', 8, 4, True)}, {guided_sql('st1', 'st2', 4, 3, True)} SELECT frame, y::INT AS y, x::INT AS x, a AS nx, b AS ny, c AS nz, valid FROM st2", "nx ny nz")
def _(spark, sf):
    return R.resize_guided(holed_normals(spark, sf), ["nx", "ny", "nz"], (8, 8), (3, 3)).select("frame", "y", "x", "nx", "ny", "nz", "valid")


@register("guided_resize_angles", "RST-18", f"WITH {HOLED_N}, ang AS (SELECT frame, y, x, CASE WHEN valid THEN acos(least(abs(c), 1.0::DOUBLE)) ELSE 0 END AS a, 0.0 AS b, 0.0 AS c, valid FROM src), {guided_sql('ang', 'st1', 8, 12, False)} SELECT frame, y::INT AS y, x::INT AS x, a AS theta, valid FROM st1", "theta")
def _(spark, sf):
    n = holed_normals(spark, sf)
    t = n.select("frame", "y", "x", F.when(F.col("valid"), F.acos(F.least(F.abs("nz"), F.lit(1.0)))).otherwise(0.0).alias("theta"), "valid")
    return R.resize_guided(t, ["theta"], (8, 8), (12, 12), 10.0, False).select("frame", "y", "x", "theta", "valid")


@register("patch_extraction", "RST-20", f"""WITH {P64}, {SIZE}, o AS (SELECT frame, k, floor({u_sql('9', 'frame', "'oy'", 'k')} * (h - 6))::INT AS oy, floor({u_sql('9', 'frame', "'ox'", 'k')} * (w - 6))::INT AS ox FROM (SELECT *, unnest(range(40)) AS k FROM sz))
  SELECT o.frame, o.k::INT AS k, count(*) AS n, avg(gt) AS mean, max(gt) - min(gt) AS span FROM o JOIN pix p ON p.frame = o.frame AND p.y BETWEEN oy AND oy + 6 AND p.x BETWEEN ox AND ox + 6 GROUP BY ALL""", "mean span")
def _(spark, sf):
    px = X.pixels64(spark, sf)
    s = px.groupBy("frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = R.patches(px, SM.patch_origins(s, 40, 7, 9), 7, ["gt"])
    return p.groupBy("frame", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("gt").alias("mean"), (F.max("gt") - F.min("gt")).alias("span"))
