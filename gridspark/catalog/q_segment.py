"""Connected regions, class masks, boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import P64
from gridspark.catalog.q_raster import NEAR3, SIZE
from gridspark.catalog.registry import register
from gridspark.layouts import with_size
from gridspark.operators import contour as C
from gridspark.operators import joins as J
from gridspark.operators import ordering as O
from gridspark.operators import segment as S

ROW = S.ROW


def regions_sql(mask_cte: str, connect: int = 4, keys: str = "frame") -> str:
    """CTE ``lab(keys, y, x, label)`` for the pixels of ``mask_cte(keys, y, x)``."""
    near = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if connect == 4 else "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    sel = ", ".join(f"b.{k}" for k in ks)
    return f"""reach AS (SELECT {keys}, y, x, (y::BIGINT * {ROW} + x) AS l FROM {mask_cte}
   UNION SELECT {sel}, b.y, b.x, a.l FROM reach a JOIN {mask_cte} b ON {same} AND {near} WHERE a.l < b.y::BIGINT * {ROW} + b.x),
 lab AS (SELECT {keys}, y, x, min(l) AS label FROM reach GROUP BY {keys}, y, x)"""


TREAD = P64 + ", msk AS (SELECT frame, y, x FROM pix WHERE cls = 1)"


@register("connected_regions_4", "SEG-01", f"WITH RECURSIVE {TREAD}, {regions_sql('msk', 4)} SELECT frame, y, x, label FROM lab")
def _(spark, sf):
    return S.label_regions(X.pixels64(spark, sf).select("frame", "y", "x", "cls"), F.col("cls") == 1).select("frame", "y", "x", "label")


@register("connected_regions_8", "SEG-01", f"WITH RECURSIVE {TREAD}, {regions_sql('msk', 8)} SELECT frame, label, count(*) AS size FROM lab GROUP BY ALL")
def _(spark, sf):
    return S.region_sizes(S.label_regions(X.pixels64(spark, sf).select("frame", "y", "x", "cls"), F.col("cls") == 1, connect=8))


@register("largest_regions", "TOP-04", f"""WITH RECURSIVE {P64}, msk AS (SELECT frame, cls, y, x FROM pix WHERE cls > 0), {regions_sql('msk', 4, 'frame, cls')},
  s AS (SELECT frame, cls, label, count(*) AS size FROM lab GROUP BY ALL) SELECT frame, cls, label, size FROM (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY size DESC, label) AS k FROM s) WHERE k <= 3""")
def _(spark, sf):
    by = ["frame", "cls"]
    lab = S.label_regions(X.pixels64(spark, sf).select(*by, "y", "x"), F.col("cls") > 0, by)
    return S.largest(S.region_sizes(lab, by), 3, by)


@register("clean_class_masks", "SEG-02", f"""WITH RECURSIVE {P64}, cl AS (SELECT unnest([1, 2]) AS c),
  msk AS (SELECT frame, c, y, x FROM pix, cl WHERE cls = c), {regions_sql('msk', 4, 'frame, c')},
  k AS (SELECT frame, c, label FROM lab GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT frame, y, x, max(c) AS c FROM lab SEMI JOIN k USING (frame, c, label) GROUP BY ALL),
  o AS (SELECT frame, y, x, coalesce(c, 0) AS cls FROM pix LEFT JOIN g USING (frame, y, x)), f AS (SELECT frame, avg((cls > 0)::INT) AS f FROM o GROUP BY frame)
  SELECT frame, y, x, CASE WHEN f >= 0.05 THEN cls ELSE 0 END AS cls FROM o JOIN f USING (frame)""")
def _(spark, sf):
    return S.clean_masks(X.pixels64(spark, sf).select("frame", "y", "x", "cls"), 5, 1, 0.05).select("frame", "y", "x", "cls")


@register("clean_class_masks_opened", "SEG-02 SEG-07", f"""WITH RECURSIVE {P64}, cl AS (SELECT unnest([1, 2]) AS c),
  m AS (SELECT frame, y, x, e > -0.05 AS a, e <= -0.05 AS b FROM pix), two AS (SELECT frame, c, y, x, CASE WHEN c = 1 THEN a ELSE b END AS m FROM m, cl),
  ero AS (SELECT p.frame, p.c, p.y, p.x, bool_and(q.m) AND count(*) = 9 AS m FROM two p JOIN two q ON q.frame = p.frame AND q.c = p.c AND {NEAR3} GROUP BY ALL),
  msk AS (SELECT p.frame, p.c, p.y, p.x FROM ero p JOIN ero q ON q.frame = p.frame AND q.c = p.c AND {NEAR3} GROUP BY ALL HAVING bool_or(q.m)), {regions_sql('msk', 4, 'frame, c')},
  k AS (SELECT frame, c, label FROM lab GROUP BY ALL HAVING count(*) >= 12), g AS (SELECT frame, y, x, max(c) AS c FROM lab SEMI JOIN k USING (frame, c, label) GROUP BY ALL)
  SELECT frame, avg((coalesce(c, 0) > 0)::INT) AS clean_share, count(*) FILTER (c = 1) AS n_tread FROM pix LEFT JOIN g USING (frame, y, x) GROUP BY frame""", "clean_share")
def _(spark, sf):
    px = X.pixels64(spark, sf).select("frame", "y", "x", F.when(F.col("e") > -0.05, 1).otherwise(2).alias("cls"))
    c = S.clean_masks(px, 12, 3, 0.0)
    return c.groupBy("frame").agg(F.avg((F.col("cls") > 0).cast("int")).alias("clean_share"), F.count_if(F.col("cls") == 1).alias("n_tread"))


PAIR = "((p.cls = 1 AND q.cls = 2) OR (p.cls = 2 AND q.cls = 1) OR (p.cls = 0 AND q.cls > 0) OR (q.cls = 0 AND p.cls > 0))"
BOUND = f"bnd AS (SELECT p.frame, p.y, p.x, bool_or({PAIR}) AS edge FROM pix p JOIN pix q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY ALL)"


@register("class_boundary", "SEG-03", f"WITH {P64}, {BOUND} SELECT frame, y, x, edge FROM bnd")
def _(spark, sf):
    return S.boundary(X.pixels64(spark, sf).select("frame", "y", "x", "cls")).select("frame", "y", "x", "edge")


@register("tread_riser_boundary", "SEG-03", f"WITH {P64} SELECT p.frame, p.y, p.x, bool_or((p.cls = 1 AND q.cls = 2) OR (p.cls = 2 AND q.cls = 1)) AS edge FROM pix p JOIN pix q ON q.frame = p.frame AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY ALL")
def _(spark, sf):
    return S.boundary(X.pixels64(spark, sf).select("frame", "y", "x", "cls"), stair_bg=False).select("frame", "y", "x", "edge")


def closing_sql(src: str, name: str) -> str:
    """3x3 closing on a replicated border of ``src(frame, y, x, h, w, m)``."""
    return f"""{name}_p AS (SELECT a.frame, py AS y, px AS x, q.m FROM (SELECT frame, h, w, unnest(range(-1, h + 1)) AS py FROM (SELECT DISTINCT frame, h, w FROM {src})) a, (SELECT unnest(range(-1, 65)) AS px)
    JOIN {src} q ON q.frame = a.frame AND q.y = least(greatest(py, 0), a.h - 1) AND q.x = least(greatest(px, 0), a.w - 1) WHERE px <= a.w),
  {name}_d AS (SELECT p.frame, p.y, p.x, bool_or(q.m) AS m FROM {name}_p p JOIN {name}_p q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL),
  {name} AS (SELECT p.frame, p.y, p.x, bool_and(q.m) AS m FROM {name}_d p JOIN {name}_d q ON q.frame = p.frame AND {NEAR3} GROUP BY ALL)"""


@register("edge_cleaning", "SEG-04", f"""WITH RECURSIVE {P64}, {SIZE}, src AS (SELECT frame, y, x, h, w, conf > 0.85 AS m FROM pix JOIN sz USING (frame)), {closing_sql('src', 'clo')},
  msk AS (SELECT pix.frame, pix.y, pix.x FROM pix JOIN clo ON clo.frame = pix.frame AND clo.y = pix.y AND clo.x = pix.x WHERE clo.m AND gt > 0), {regions_sql('msk', 8)},
  k AS (SELECT frame, label FROM lab GROUP BY ALL HAVING count(*) >= 6), g AS (SELECT frame, y, x FROM lab SEMI JOIN k USING (frame, label))
  SELECT frame, y, x, g.frame IS NOT NULL AS edge FROM pix LEFT JOIN (SELECT *, true AS hit FROM g) g USING (frame, y, x)""".replace("g.frame IS NOT NULL", "hit IS NOT NULL"))
def _(spark, sf):
    px = with_size(X.pixels64(spark, sf).select("frame", "y", "x", "gt", (F.col("conf") > 0.85).alias("edge")))
    return S.clean_edges(px, "edge", 6, 3).select("frame", "y", "x", "edge")


SEGS = """seg AS (SELECT frame, (user * 7 % 50)::DOUBLE AS x1, (user * 13 % 60)::DOUBLE AS y1, (user * 7 % 50 + user % 17)::DOUBLE AS x2, (user * 13 % 60 + user % 5)::DOUBLE AS y2, user AS sid
  FROM (SELECT event_id % 8 AS frame, event_id AS user FROM events WHERE event_type = 'click'))"""


def _segments(spark, sf):
    u = F.col("event_id")
    e = X.table(spark, sf, "events").where("event_type = 'click'")
    return e.select((u % 8).alias("frame"), (u * 7 % 50).cast("double").alias("x1"), (u * 13 % 60).cast("double").alias("y1"),
                    (u * 7 % 50 + u % 17).cast("double").alias("x2"), (u * 13 % 60 + u % 5).cast("double").alias("y2"), u.alias("sid"))


DIST = """dst AS (SELECT p.frame, p.y, p.x, sid, l2, t, sqrt(pow(p.x - (x1 + t * dx), 2) + pow(p.y - (y1 + t * dy), 2)) AS d FROM (
   SELECT p.frame, p.y, p.x, sid, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(pow(x2 - x1, 2) + pow(y2 - y1, 2), 1e-6) AS l2,
     least(greatest(((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / greatest(pow(x2 - x1, 2) + pow(y2 - y1, 2), 1e-6), 0.0::DOUBLE), 1.0::DOUBLE) AS t
   FROM pix p JOIN seg s ON s.frame = p.frame) p)"""


@register("pixel_to_segment_distance", "JOIN-26", f"WITH {P64}, {SEGS}, {DIST} SELECT frame, y, x, sid, d FROM dst WHERE d <= 1.23", "d")
def _(spark, sf):
    return J.points_to_segments(X.pixels64(spark, sf).select("frame", "y", "x"), _segments(spark, sf), 1.23).select("frame", "y", "x", "sid", "d")


@register("edge_band_weights", "SEG-05", f"""WITH {P64}, {SEGS}, {DIST}, b AS (SELECT frame, y, x, max(exp(-pow(least(t, 1 - t) * sqrt(l2), 2) / (2 * pow(sqrt(l2) / 2, 2)))) AS wgt FROM dst WHERE d <= 1.23 GROUP BY ALL)
  SELECT frame, y, x, coalesce(wgt, 0.0) AS wgt FROM pix LEFT JOIN b USING (frame, y, x)""", "wgt")
def _(spark, sf):
    return S.edge_band(X.pixels64(spark, sf).select("frame", "y", "x"), _segments(spark, sf), 2.46).select("frame", "y", "x", F.col("E").alias("wgt"))


@register("confidence_gating", "SEG-06", f"""WITH {P64}, m AS (SELECT p.frame, p.y, p.x, max(q.conf) AS c FROM pix p JOIN pix q ON q.frame = p.frame AND abs(q.y - p.y) <= 3 AND abs(q.x - p.x) <= 3 GROUP BY ALL)
  SELECT frame, y, x, CASE WHEN c >= 0.95 AND e > 0 THEN e ELSE 0 END AS E, e > 0 AND c >= 0.95 AS band, conf < 0.95 AS ignore FROM pix JOIN m USING (frame, y, x)""".replace(" AS E, e > 0", " AS weight, e > 0"), "weight")
def _(spark, sf):
    px = X.pixels64(spark, sf).select("frame", "y", "x", "conf", F.greatest("e", F.lit(0.0)).alias("E"))
    return S.confidence_gate(px, 2.0, 0.95).select("frame", "y", "x", F.col("E").alias("weight"), "band", "ignore")


@register("class_share", "SEG-07", f"WITH {P64} SELECT frame, avg((cls > 0)::INT) AS share FROM pix GROUP BY frame", "share")
def _(spark, sf):
    return X.pixels64(spark, sf).groupBy("frame").agg(F.avg((F.col("cls") > 0).cast("int")).alias("share"))


@register("boundary_segments", "SEG-09", f"""WITH RECURSIVE {P64}, msk AS (SELECT frame, y, x FROM pix WHERE cls = 1 AND conf > 0.8), {regions_sql('msk', 8)},
  s AS (SELECT frame, label, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * (round(covar_pop(x, y), 9) + 0.0), round(var_pop(x) - var_pop(y), 9) + 0.0) AS ang, count(*) AS n FROM lab GROUP BY ALL),
  g AS (SELECT frame, label, n, mx, my, cos(ang) AS ux, sin(ang) AS uy, min((x - mx) * cos(ang) + (y - my) * sin(ang)) AS lo, max((x - mx) * cos(ang) + (y - my) * sin(ang)) AS hi FROM lab JOIN s USING (frame, label) GROUP BY ALL)
  SELECT frame, label, n, mx + lo * ux AS x1, my + lo * uy AS y1, mx + hi * ux AS x2, my + hi * uy AS y2 FROM g WHERE hi - lo >= 1.9""", "x1 y1 x2 y2")
def _(spark, sf):
    lab = S.label_regions(X.pixels64(spark, sf).select("frame", "y", "x", "cls", "conf"), (F.col("cls") == 1) & (F.col("conf") > 0.8), connect=8)
    return S.segments_of(lab, min_len=1.9)


@register("hole_region_sizes", "AGG-24", f"WITH RECURSIVE {P64}, msk AS (SELECT frame, y, x FROM pix WHERE gt <= 0), {regions_sql('msk', 4)}, s AS (SELECT count(*) AS n FROM lab GROUP BY frame, label) SELECT quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM s", "p10 p50 p90")
def _(spark, sf):
    s = S.region_sizes(S.label_regions(X.pixels64(spark, sf).select("frame", "y", "x", "gt"), F.col("gt") <= 0))
    return O.quantiles(s, [], "size", [0.1, 0.5, 0.9], ["p10", "p50", "p90"])


# Borders as cycles of (pixel, direction) states; a walker stops where an earlier side's walker would start.
CONTOURS = f"""dr(k, dy, dx) AS (VALUES {", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(C.AROUND))}),
 nb AS (SELECT a.frame, a.y, a.x, k FROM msk a, dr JOIN msk b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx),
 nk AS (SELECT p.frame, p.y, p.x, p.k AS d, arg_min(q.k, (q.k - p.k + 15) % 8) AS k FROM nb p JOIN nb q ON p.frame = q.frame AND p.y = q.y AND p.x = q.x GROUP BY ALL),
 nx AS MATERIALIZED (SELECT frame, y, x, d, y + dy AS y2, x + dx AS x2, (nk.k + 4) % 8 AS d2 FROM nk JOIN dr USING (k)),
 sd AS (SELECT a.frame, a.y, a.x, s, (a.y::BIGINT * {ROW} + a.x) * 2 + s AS ord FROM msk a, (SELECT unnest([0, 1]) AS s) WHERE NOT EXISTS (SELECT 1 FROM msk b WHERE b.frame = a.frame AND b.y = a.y AND b.x = a.x - 1 + 2 * s)),
 ss AS MATERIALIZED (SELECT frame, y, x, d, min(ord) AS ord FROM (SELECT frame, y, x, ord, arg_min(k, (CASE WHEN s = 0 THEN 4 ELSE 0 END - k + 15) % 8) AS d FROM sd JOIN nb USING (frame, y, x) GROUP BY ALL) GROUP BY ALL),
 wk AS (SELECT frame, ord, 0 AS n, y, x, d FROM ss UNION ALL
   SELECT w.frame, w.ord, n + 1, y2, x2, d2 FROM wk w JOIN nx ON nx.frame = w.frame AND nx.y = w.y AND nx.x = w.x AND nx.d = w.d
   LEFT JOIN ss ON ss.frame = w.frame AND ss.y = y2 AND ss.x = x2 AND ss.d = d2 WHERE ss.ord IS NULL OR ss.ord > w.ord),
 fin AS (SELECT w.frame, w.ord, n AS last FROM wk w JOIN nx ON nx.frame = w.frame AND nx.y = w.y AND nx.x = w.x AND nx.d = w.d JOIN ss ON ss.frame = w.frame AND ss.y = y2 AND ss.x = x2 AND ss.d = d2 AND ss.ord = w.ord),
 no AS (SELECT frame, ord, row_number() OVER (PARTITION BY frame ORDER BY ord) - 1 AS contour FROM (SELECT frame, ord FROM fin UNION ALL SELECT frame, ord FROM sd ANTI JOIN nb USING (frame, y, x) WHERE s = 0)),
 ch AS MATERIALIZED (SELECT wk.frame, wk.ord, n, y, x FROM wk JOIN fin USING (frame, ord)),
 iv AS (SELECT frame, ord, 0 AS a, last AS b FROM fin UNION ALL
   SELECT frame, ord, u.a, u.b FROM (SELECT frame, ord, unnest([{{'a': a, 'b': m}}, {{'a': m, 'b': b}}]) AS u FROM (
     SELECT iv.frame, iv.ord, iv.a, iv.b, any_value(q) AS q, max(f) AS f, arg_max(n, f * 100000 - n) AS m FROM (
       SELECT iv.frame, iv.ord, iv.a, iv.b, p.n, (t.x - s.x) ** 2 + (t.y - s.y) ** 2 AS q, CASE WHEN t.x = s.x AND t.y = s.y THEN (p.x - s.x) ** 2 + (p.y - s.y) ** 2 ELSE ((p.x - s.x) * (t.y - s.y) - (p.y - s.y) * (t.x - s.x)) ** 2 END AS f
       FROM iv JOIN ch p ON p.frame = iv.frame AND p.ord = iv.ord AND p.n > a AND p.n < b JOIN ch s ON s.frame = iv.frame AND s.ord = iv.ord AND s.n = a JOIN ch t ON t.frame = iv.frame AND t.ord = iv.ord AND t.n = b) AS iv
     GROUP BY iv.frame, iv.ord, iv.a, iv.b) WHERE f > 4 * greatest(q, 1))),
 co AS (SELECT frame, ord, n, row_number() OVER (PARTITION BY frame, ord ORDER BY n) - 1 AS piece FROM (SELECT frame, ord, a AS n FROM iv UNION SELECT frame, ord, b FROM iv)),
 pc AS (SELECT frame, ord, piece, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM co JOIN ch USING (frame, ord, n) WINDOW o AS (PARTITION BY frame, ord ORDER BY piece))"""


@register("contour_segments", "SEG-09", f"""WITH RECURSIVE {TREAD}, {CONTOURS}
  SELECT frame, contour::INT AS contour, piece::INT AS piece, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM pc JOIN no USING (frame, ord) WHERE (x2 - x1) ** 2 + (y2 - y1) ** 2 >= 16""")
def _(spark, sf):
    return C.contour_segments(X.pixels64(spark, sf).select("frame", "y", "x", "cls"), F.col("cls") == 1, eps=2.0, min_len=4.0)
