"""Result-table operators: latest rows, strides, splits, comparisons, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog.fixtures import FILES, LOG, P8, P64, PAIRS, STEPS, STREAMS, u_sql
from gridspark.catalog.registry import REGISTRY, register
from gridspark.functions import scalar as S
from gridspark.functions.keyed import normal, uniform
from gridspark.operators import joins as J
from gridspark.operators import metrics as M
from gridspark.operators import ordering as O
from gridspark.operators import sampling as SM
from gridspark.operators import tables as T
from gridspark.plans import reports as R


# ---- windows ---------------------------------------------------------------

@register("latest_row_per_hash", "WIN-01", f"""WITH {LOG} SELECT config_hash, pos, stamp, experiment, absrel FROM (
  SELECT *, row_number() OVER (PARTITION BY config_hash ORDER BY stamp DESC, pos DESC) AS k FROM log) WHERE k = 1""", "absrel")
def _(spark, sf):
    log = X.results_log(spark, sf).select("config_hash", "pos", "stamp", "experiment", "absrel")
    return T.latest(log, ["config_hash"], ["stamp", "pos"])


@register("latest_row_per_experiment", "WIN-01", f"""WITH {LOG}, k AS (
  SELECT *, CASE WHEN experiment = 'error' THEN dataset || '/' || method ELSE experiment END AS key FROM log
  WHERE experiment <> 'error' OR (dataset = 'd1' AND method IN ('m1', 'm2')))
  SELECT key, pos, stamp, absrel FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stamp DESC, pos DESC) AS n FROM k) WHERE n = 1""", "absrel")
def _(spark, sf):
    return T.latest_per_experiment(X.results_log(spark, sf), "error", {"d1": ["m1", "m2"]}).select("key", "pos", "stamp", "absrel")


@register("stride_per_sequence", "WIN-02", f"""WITH {FILES} SELECT path, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY path) AS k FROM files) WHERE (k - 1) % 4 = 0""")
def _(spark, sf):
    return T.every_nth(X.file_index(spark, sf).select("path", "seq"), ["seq"], ["path"], 4)


@register("stride_global", "WIN-02", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE (k - 1) % 7 = 0""", "l_extendedprice")
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return T.every_nth(X.table(spark, sf, "lineitem").select(*cols), [], cols, 7)


@register("evenly_spaced_picks", "WIN-03", f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM files),
  p AS (SELECT DISTINCT floor(i * ((n - 1) / 16.0::DOUBLE))::BIGINT AS k FROM (SELECT DISTINCT n FROM r), (SELECT unnest(range(17)) AS i))
  SELECT doc_id, path FROM r SEMI JOIN p USING (k)""")
def _(spark, sf):
    return T.evenly_spaced(X.file_index(spark, sf).select("doc_id", "path"), ["doc_id"], 17)


@register("time_block_split", "WIN-04", f"""WITH {LOG} SELECT pos, dataset, method, CASE WHEN row_number() OVER w <= round_even(0.8 * count(*) OVER (PARTITION BY dataset, method), 0)
  THEN 'train' ELSE 'test' END AS split FROM log WINDOW w AS (PARTITION BY dataset, method ORDER BY ts, pos)""")
def _(spark, sf):
    return T.time_blocks(X.results_log(spark, sf).select("pos", "dataset", "method", "ts"), ["dataset", "method"], ["ts", "pos"]).drop("ts")


@register("cap_by_ceil_stride", "WIN-05", f"""WITH {FILES}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM files)
  SELECT doc_id FROM r WHERE k % ceil(n / 300.0)::BIGINT = 0""")
def _(spark, sf):
    return T.cap_by_stride(X.file_index(spark, sf).select("doc_id"), ["doc_id"], 300)


@register("audit_stride", "WIN-05", f"""WITH {FILES}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM files)
  SELECT doc_id FROM r WHERE k % greatest(1, n // 60) = 0 AND k // greatest(1, n // 60) < 60""")
def _(spark, sf):
    return T.audit_stride(X.file_index(spark, sf).select("doc_id"), ["doc_id"], 60)


@register("distinct_value_gaps", "WIN-06", """WITH d AS (SELECT DISTINCT event_type, value FROM events),
  g AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY value) AS gap FROM d)
  SELECT event_type, count(gap) AS n, quantile_cont(gap, 0.5) AS median_gap, max(gap) AS max_gap FROM g GROUP BY event_type""", "median_gap max_gap")
def _(spark, sf):
    g = T.value_gaps(X.table(spark, sf, "events"), ["event_type"], "value")
    q = O.quantiles(g, ["event_type"], "gap", [0.5], ["median_gap"])
    return g.groupBy("event_type").agg(F.count("gap").alias("n"), F.max("gap").alias("max_gap")).join(q, "event_type")


@register("average_rank_ties", "WIN-15", """SELECT DISTINCT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rnk FROM lineitem""", "l_quantity rnk")
def _(spark, sf):
    return O.average_rank(X.table(spark, sf, "lineitem").select("l_quantity"), "l_quantity", "rnk").distinct()


@register("label_change_borders", "WIN-16", f"""WITH {LOG} SELECT pos, coalesce(experiment <> lag(experiment) OVER (ORDER BY stamp, pos), false) AS border FROM log""")
def _(spark, sf):
    c = O.carried(X.results_log(spark, sf).select("pos", "stamp", "experiment"), [], ["stamp", "pos"], F.col("experiment"), "_prev", "last", inclusive=False)
    return c.select("pos", F.coalesce(F.col("experiment") != F.col("_prev"), F.lit(False)).alias("border"))


# ---- top-k -----------------------------------------------------------------

SHARE = P8 + ", share AS (SELECT frame, grp, avg((cls > 0)::INT) AS s FROM pix GROUP BY frame, grp)"


def _share(spark, sf):
    return X.pixels8(spark, sf).groupBy("frame", "grp").agg(F.avg((F.col("cls") > 0).cast("int")).alias("s"))


@register("closest_to_threshold", "TOP-02", f"""WITH {SHARE} (SELECT 'small' AS kind, frame, s FROM share ORDER BY s, frame LIMIT 10)
  UNION ALL (SELECT 'near' AS kind, frame, s FROM share ORDER BY abs(s - 0.25), frame LIMIT 10)""", "s")
def _(spark, sf):
    sh = _share(spark, sf)
    a = sh.orderBy("s", "frame").limit(10).select(F.lit("small").alias("kind"), "frame", "s")
    b = sh.orderBy(F.abs(F.col("s") - 0.25), "frame").limit(10).select(F.lit("near").alias("kind"), "frame", "s")
    return a.unionByName(b)


@register("lowest_median_groups", "TOP-03", f"WITH {SHARE} SELECT grp, quantile_cont(s, 0.5) AS med FROM share GROUP BY grp ORDER BY med, grp LIMIT 8", "med")
def _(spark, sf):
    return O.quantiles(_share(spark, sf), ["grp"], "s", [0.5], ["med"]).orderBy("med", "grp").limit(8)


@register("representative_frames", "TOP-05", f"""WITH {SHARE}, g AS (SELECT grp, avg(s) AS m, quantile_cont(s, 0.5) AS med FROM share GROUP BY grp ORDER BY round(m, 9) DESC, grp LIMIT 4)
  SELECT grp, frame, s FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(s - med), 9), frame) AS k FROM share JOIN g USING (grp)) WHERE k = 1""", "s")
def _(spark, sf):
    sh = _share(spark, sf)
    g = sh.groupBy("grp").agg(F.avg("s").alias("m")).orderBy(F.round("m", 9).desc(), "grp").limit(4)
    g = g.join(O.quantiles(sh, ["grp"], "s", [0.5], ["med"]), "grp")
    j = sh.join(F.broadcast(g), "grp")
    return j.groupBy("grp").agg(F.min_by(F.struct("frame", "s"), F.struct(F.round(F.abs(F.col("s") - F.col("med")), 9), "frame")).alias("b")).select("grp", "b.frame", "b.s")


@register("best_variant", "TOP-06", f"""WITH {LOG}, a AS (SELECT dataset AS family, method, avg(absrel) AS m FROM log GROUP BY ALL), v AS (SELECT family, method, CASE WHEN method <> 'm3' THEN m END AS val FROM a)
  SELECT family, method, val FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY coalesce(val, 'inf'::DOUBLE), method) AS k FROM v) WHERE k = 1""", "val")
def _(spark, sf):
    v = X.results_log(spark, sf).groupBy(F.col("dataset").alias("family"), "method").agg(F.avg("absrel").alias("val"))
    return T.best_variant(v.withColumn("val", F.when(F.col("method") != "m3", F.col("val"))), "family", "method", "val")


@register("max_samples_head", "TOP-07", f"WITH {FILES} SELECT path, length FROM files ORDER BY path LIMIT 25")
def _(spark, sf):
    return X.file_index(spark, sf).select("path", "length").orderBy("path").limit(25)


@register("natural_sort", "TOP-08", "SELECT 's' || doc_id || '_rgb.png' AS name, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("_rgb.png")).alias("name"))
    return O.ranked(d, [], [S.natural_key(F.col("name")), "name"], "place")


@register("best_checkpoint_so_far", "TOP-09", f"""WITH {STEPS}, e AS (SELECT epoch, max(total) AS val FROM steps GROUP BY epoch)
  SELECT epoch, val, min(val) OVER w AS best, val = min(val) OVER w AND coalesce(val < min(val) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
  FROM e WINDOW w AS (ORDER BY epoch)""", "val best")
def _(spark, sf):
    e = X.steps(spark, sf).groupBy("epoch").agg(F.max("total").alias("val"))
    return T.best_so_far(e, [], ["epoch"], "val")


@register("rank_list_parse", "TOP-10", """WITH t AS (SELECT doc_id FROM labels WHERE toxic = 1)
  SELECT DISTINCT rank FROM (SELECT doc_id AS rank FROM t UNION ALL SELECT unnest(range(doc_id + 2, doc_id + 6)) AS rank FROM t)
  WHERE rank <= (SELECT max(doc_id) FROM documents)""")
def _(spark, sf):
    t = X.table(spark, sf, "labels").where("toxic = 1").select(F.format_string("%d %d-%d", "doc_id", F.col("doc_id") + 2, F.col("doc_id") + 5).alias("text"))
    r = T.parse_ranks(t).select(F.col("rank").cast("bigint").alias("rank"))
    return r.join(X.table(spark, sf, "documents").select(F.col("doc_id").alias("rank")), "rank", "left_semi")


# ---- set operations --------------------------------------------------------

@register("union_sources", "SET-01", f"""WITH {FILES} SELECT path, seq, NULL::BIGINT AS page_id, 'own' AS source FROM files
  UNION ALL SELECT url, NULL, page_id, 'extra' FROM pages""")
def _(spark, sf):
    own = X.file_index(spark, sf).select("path", "seq", F.lit("own").alias("source"))
    extra = X.table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id", F.lit("extra").alias("source"))
    return own.unionByName(extra, allowMissingColumns=True)


@register("flag_complement", "SET-02", f"WITH {P8} SELECT DISTINCT frame FROM pix WHERE frame NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    fl = X.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("frame"))
    return X.pixels8(spark, sf).select("frame").distinct().join(fl, "frame", "left_anti")


@register("grow_subset", "SET-03", f"""WITH rec AS (SELECT 'train' AS split, doc_id AS sample_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT 'test', doc_id, source FROM documents WHERE lang <> 'en'),
  have AS (SELECT split, sample_id FROM rec JOIN labels ON doc_id = sample_id WHERE toxic = 1),
  rest AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {u_sql("5", "split", "sample_id")}, sample_id) AS k FROM (SELECT * FROM rec ANTI JOIN have USING (split, sample_id)))
  SELECT split, sample_id, source, true AS held FROM rec SEMI JOIN have USING (split, sample_id) UNION ALL SELECT split, sample_id, source, false FROM rest WHERE k <= 20""")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select(F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"), F.col("doc_id").alias("sample_id"), "source")
    tox = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    have = d.join(tox, "sample_id", "left_semi")
    return SM.grow_subset(d, have, 20, 5).select("split", "sample_id", "source", "held")


@register("ids_in_both_runs", "SET-04", f"WITH {PAIRS} SELECT frame FROM runs WHERE row_id = 'ref' AND value > 0.1 INTERSECT SELECT frame FROM runs WHERE row_id = 'cur' AND value > 0.1")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    one = lambda k: r.where((F.col("row_id") == k) & (F.col("value") > 0.1)).select("frame")
    return one("ref").intersect(one("cur"))


@register("schema_versioned_union", "SET-05 BMK-11", f"""WITH {LOG} SELECT stamp, experiment, printf('%.2f', value) AS absrel, CASE WHEN pos % 3 = 0 THEN '' ELSE method END AS method,
  CASE WHEN pos % 3 = 2 THEN config_hash ELSE '' END AS config_hash FROM log""")
def _(spark, sf):
    log = X.results_log(spark, sf)
    base = F.concat_ws(",", "stamp", "experiment", F.format_string("%.2f", "value"))
    line = (F.when(F.col("pos") % 3 == 0, base).when(F.col("pos") % 3 == 1, F.concat_ws(",", base, "method"))
            .otherwise(F.concat_ws(",", base, "method", "config_hash")))
    v1 = ["stamp", "experiment", "absrel"]
    return T.by_schema_version(log.select(line.alias("value")), [v1, [*v1, "method"], [*v1, "method", "config_hash"]], [*v1, "method", "config_hash"])


@register("first_seen_names", "SET-06", f"WITH {LOG} SELECT method, min(pos) AS pos FROM log GROUP BY method")
def _(spark, sf):
    return T.first_seen(X.results_log(spark, sf), "method", ["pos"]).select("method", "first.pos")


@register("report_title", "AGG-42 SCL-03", f"""WITH {LOG}, m AS (SELECT method, min(pos) AS p FROM log GROUP BY method), d AS (SELECT dataset, min(pos) AS p FROM log GROUP BY dataset)
  SELECT CASE WHEN length(u) > 120 THEN left(u, 111) || '-' || left(md5(u), 8) ELSE u END AS title FROM (SELECT (SELECT string_agg(method, '-' ORDER BY p) FROM m) || '__' || (SELECT string_agg(dataset, '-' ORDER BY p) FROM d) AS u)""")
def _(spark, sf):
    return R.table_title(X.results_log(spark, sf), ["pos"])


@register("mask_algebra", "SET-07", f"""WITH {P8} SELECT frame, count(*) FILTER (gt > 0 AND NOT conf >= 0.9 AND cls <> 2) AS n_clean, count(*) FILTER (cls = 1 OR cls = 2) AS n_union,
  count(*) FILTER (cls > 0 AND gt > 0) / greatest(count(*) FILTER (cls > 0 OR gt > 0), 1)::DOUBLE AS iou FROM pix GROUP BY frame""", "iou")
def _(spark, sf):
    v, band, ign = F.col("gt") > 0, F.col("conf") >= 0.9, F.col("cls") == 2
    st = F.col("cls") > 0
    return X.pixels8(spark, sf).groupBy("frame").agg(
        F.count_if(v & ~band & ~ign).alias("n_clean"), F.count_if((F.col("cls") == 1) | ign).alias("n_union"),
        (F.count_if(st & v) / F.greatest(F.count_if(st | v), F.lit(1))).alias("iou"))


# ---- joins -----------------------------------------------------------------

@register("companion_pairing", "JOIN-01", f"WITH {FILES} SELECT f.path, f.seq, replace(f.path, '/image/', '/depth/') AS depth_path FROM files f JOIN labels l ON l.doc_id = f.doc_id")
def _(spark, sf):
    rgb = X.file_index(spark, sf)
    lab = X.table(spark, sf, "labels").select("doc_id")
    depth = rgb.join(lab, "doc_id", "left_semi").select(F.replace("path", F.lit("/image/"), F.lit("/depth/")).alias("depth_path"))
    depth = depth.withColumn("stem", S.stem(F.col("depth_path"))).withColumn("seq", S.path_part(F.col("depth_path"), 2))
    return rgb.withColumn("stem", S.stem(F.col("path"))).join(depth, ["seq", "stem"]).select("path", "seq", "depth_path")


@register("optional_companion", "JOIN-02 JOIN-04", f"WITH {FILES} SELECT path, quality, toxic, quality IS NOT NULL AS has_meta FROM files LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return X.file_index(spark, sf).join(X.table(spark, sf, "labels"), "doc_id", "left").select("path", "quality", "toxic", F.col("quality").isNotNull().alias("has_meta"))


@register("checked_pairing", "JOIN-03", f"WITH {FILES} SELECT lower(regexp_extract(path, '([0-9]+)\\.png', 1)) AS stem, upper(path) AS left_path, path AS right_path FROM files")
def _(spark, sf):
    f = X.file_index(spark, sf).select("path")
    return J.pair_checked(f.select(F.upper("path").alias("path")), f, S.stem(F.col("path")))


CAMS = "cams AS (SELECT DISTINCT label AS grp, 8.0 + label AS fx, 8.0 + label AS fy, 3.5 AS cx, 3.5 AS cy FROM embeddings)"


def cameras(spark, sf):
    g = X.table(spark, sf, "embeddings").select(F.col("label").alias("grp")).distinct()
    f = 8.0 + F.col("grp")
    return g.select("grp", f.alias("fx"), f.alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"))


@register("camera_lookup", "JOIN-05", f"WITH {P8}, {CAMS} SELECT frame, y, x, (x - cx) * gt / fx AS px, (y - cy) * gt / fy AS py FROM pix JOIN cams USING (grp)", "px py")
def _(spark, sf):
    j = J.camera_lookup(X.pixels8(spark, sf), cameras(spark, sf), "grp")
    return j.select("frame", "y", "x", ((F.col("x") - F.col("cx")) * F.col("gt") / F.col("fx")).alias("px"), ((F.col("y") - F.col("cy")) * F.col("gt") / F.col("fy")).alias("py"))


@register("split_filter_in_order", "JOIN-06", """SELECT doc_id AS sample_id, source, row_number() OVER (ORDER BY quality DESC, doc_id) AS pos FROM labels JOIN documents USING (doc_id)""")
def _(spark, sf):
    sp = O.ranked(X.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality"), [], [F.col("quality").desc(), "sample_id"], "pos")
    rec = X.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    return J.keep_split(rec, sp, "sample_id").select("sample_id", "source", "pos")


@register("path_suffix_match", "JOIN-07", f"WITH {FILES} SELECT 'release_1500/' || path AS line, doc_id AS sample_id FROM files")
def _(spark, sf):
    f = X.file_index(spark, sf).select("path", F.col("doc_id").alias("sample_id"))
    return J.suffix_match(f.select(F.concat(F.lit("release_1500/"), "path").alias("line")), f)


@register("train_minus_test", "JOIN-08", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id").join(X.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("nearest_in_time", "JOIN-09", f"""WITH {STREAMS}, d AS (SELECT stamp_us, min(depth_no) AS depth_no FROM depth GROUP BY stamp_us),
  p AS (SELECT c.colour_no, c.stamp_us, d.depth_no, c.stamp_us - d.stamp_us AS gap FROM colour c ASOF LEFT JOIN d ON c.stamp_us >= d.stamp_us),
  n AS (SELECT c.colour_no, d.depth_no, d.stamp_us - c.stamp_us AS gap FROM colour c ASOF LEFT JOIN d ON c.stamp_us <= d.stamp_us)
  SELECT p.colour_no, p.stamp_us, CASE WHEN p.gap IS NULL OR n.gap < p.gap THEN n.depth_no ELSE p.depth_no END AS depth_no,
   CASE WHEN p.gap IS NULL OR n.gap < p.gap THEN n.gap ELSE p.gap END AS gap FROM p JOIN n USING (colour_no)""")
def _(spark, sf):
    c, d = X.stereo_streams(spark, sf)
    return O.nearest_in_time(c, d, "stamp_us", "depth_no")


@register("best_matching_frame", "JOIN-10", f"""WITH {P8}, p AS (SELECT y, x, round(gt, 1) AS pz FROM pix WHERE frame = (SELECT min(frame) FROM pix)),
  s AS (SELECT frame, avg((round(gt, 1) = pz)::INT) AS equal_share, avg(abs(round(gt, 1) - pz)) FILTER (gt > 0 AND pz > 0) AS mean_abs,
   count(*) FILTER (gt > 0 AND pz > 0) / greatest(count(*) FILTER (gt > 0 OR pz > 0), 1)::DOUBLE AS iou FROM pix JOIN p USING (y, x) GROUP BY frame)
  SELECT frame, equal_share, mean_abs, iou FROM s ORDER BY equal_share DESC, frame LIMIT 5""", "equal_share mean_abs iou")
def _(spark, sf):
    px = X.pixels8(spark, sf).select("frame", "y", "x", F.round("gt", 1).alias("z"))
    first = px.agg(F.min("frame").alias("frame"))
    return J.best_by_pixel_agreement(px.join(F.broadcast(first), "frame"), px).orderBy(F.col("equal_share").desc(), "frame").limit(5)


@register("paired_rows", "JOIN-11", f"""WITH {PAIRS} SELECT a.frame, a.zone, a.metric, a.value AS ref, b.value AS cur FROM runs a JOIN runs b USING (frame, zone, metric)
  WHERE a.row_id = 'ref' AND b.row_id = 'cur' AND NOT isnan(a.value) AND NOT isnan(b.value)""", "ref cur")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    return T.paired(r.where("row_id = 'ref'").drop("row_id"), r.where("row_id = 'cur'").drop("row_id"), ["frame", "zone", "metric"]).select("frame", "zone", "metric", "ref", "cur")


@register("mask_to_frame", "JOIN-18 SEG-08 SRC-29", f"WITH {P8} SELECT frame, count(*) FILTER (cls = 1 AND conf >= 0.7) AS tread, count(*) FILTER (cls = 2 AND conf >= 0.7) AS riser FROM pix GROUP BY frame")
def _(spark, sf):
    px = X.pixels8(spark, sf)
    j = J.mask_to_frame(px.select("frame", "y", "x", "h", "w", "gt"), px.select("frame", "y", "x", "h", "w", "cls", "conf"))
    sure = F.col("conf") >= 0.7
    return j.groupBy("frame").agg(F.count_if((F.col("cls") == 1) & sure).alias("tread"), F.count_if((F.col("cls") == 2) & sure).alias("riser"))


@register("gate_flag_filter", "JOIN-19", f"WITH {P8} SELECT DISTINCT frame FROM pix SEMI JOIN (SELECT doc_id AS frame FROM labels WHERE quality = 1 AND toxic = 0) USING (frame)")
def _(spark, sf):
    fl = X.table(spark, sf, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("frame"))
    return X.pixels8(spark, sf).select("frame").distinct().join(fl, "frame", "left_semi")


@register("benchmark_matrix", "JOIN-20 JOIN-21 BMK-04", f"""WITH {LOG}, r AS (SELECT dataset, method, avg(absrel) AS absrel FROM log GROUP BY ALL),
  f AS (SELECT dataset, method, 'unavailable' AS reason FROM (SELECT DISTINCT dataset FROM log), (SELECT 'm9' AS method)),
  m AS (SELECT dataset, unnest(['m0', 'm1', 'm2', 'm3', 'm8', 'm9']) AS method FROM (SELECT unnest(['d0', 'd1', 'd2', 'd3', 'd4']) AS dataset))
  SELECT dataset, method, absrel, CASE WHEN absrel IS NULL THEN 'NOT RUN: ' || coalesce(reason, 'no result') ELSE '' END AS notes FROM m LEFT JOIN r USING (dataset, method) LEFT JOIN f USING (dataset, method)""", "absrel")
def _(spark, sf):
    log = X.results_log(spark, sf)
    rows = log.groupBy("dataset", "method").agg(F.avg("absrel").alias("absrel"))
    fails = log.select("dataset").distinct().select("dataset", F.lit("m9").alias("method"), F.lit("unavailable").alias("reason"))
    m = R.run_matrix([f"d{i}" for i in range(5)], ["m0", "m1", "m2", "m3", "m8", "m9"], spark)
    return R.benchmark_table(m, rows, fails)


@register("configured_without_result", "JOIN-22", f"""WITH {LOG} SELECT dataset || '_' || k AS key FROM (SELECT DISTINCT dataset FROM log), (SELECT unnest(['view', 'zoom']) AS k)
  WHERE dataset || '_' || k NOT IN (SELECT dataset || '_' || experiment FROM log)""")
def _(spark, sf):
    log = X.results_log(spark, sf)
    conf = log.select("dataset").distinct().select("dataset", F.explode(F.array(F.lit("view"), F.lit("zoom"))).alias("k")).select(F.concat_ws("_", "dataset", "k").alias("key"))
    return R.missing_experiments(conf, log.select(F.concat_ws("_", "dataset", "experiment").alias("key")).distinct(), "^d")


@register("explicit_id_pick", "JOIN-29 BMK-13", f"""WITH {P8}, w AS (SELECT doc_id AS frame FROM labels WHERE toxic = 1 AND doc_id <= (SELECT max(frame) FROM pix)),
  t AS (SELECT frame, unnest(['pred', 'gt']) AS input, unnest([pred, gt]) AS p, gt FROM pix SEMI JOIN w USING (frame))
  SELECT frame, input, avg(abs(least(greatest(p, 0.001::DOUBLE), 10.0::DOUBLE) - gt) / gt) FILTER (gt > 0.001 AND gt < 10) AS absrel FROM t GROUP BY frame, input""", "absrel")
def _(spark, sf):
    px = X.pixels8(spark, sf)
    top = px.agg(F.max("frame").alias("_m"))
    want = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("frame")).join(F.broadcast(top), F.col("frame") <= F.col("_m")).drop("_m")
    sel = J.keep_split(px, want, "frame")
    two = sel.select("frame", "gt", F.explode(F.array(F.struct(F.lit("pred").alias("input"), F.col("pred").alias("p")), F.struct(F.lit("gt").alias("input"), F.col("gt").alias("p")))).alias("s"))
    return M.per_frame(two.select("frame", "gt", "s.input", F.col("s.p").alias("pred")), by=["frame", "input"]).select("frame", "input", "absrel")


# ---- scalar functions ------------------------------------------------------

@register("path_parts", "SCL-01 SCL-02", f"""WITH {FILES} SELECT path, split_part(path, '/', 2) AS seq, regexp_extract(path, '([0-9]+)\\.png', 1) AS stem, seq || '/' || lpad(doc_id::VARCHAR, 8, '0') AS sample_id,
  lower(replace(upper(path), '/IMAGE/', '/depth/')) AS other FROM files""")
def _(spark, sf):
    f = X.file_index(spark, sf)
    p = F.col("path")
    return f.select("path", S.path_part(p, 2).alias("seq"), S.stem(p).alias("stem"), F.concat_ws("/", S.path_part(p, 2), S.stem(p)).alias("sample_id"),
                    F.lower(F.replace(F.upper(p), F.lit("/IMAGE/"), F.lit("/depth/"))).alias("other"))


@register("file_safe_name", "SCL-03", "SELECT page_id, CASE WHEN length(u) > 120 THEN left(u, 111) || '-' || left(md5(u), 8) ELSE u END AS name FROM (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g') AS u FROM pages)")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.file_safe(F.col("url")).alias("name"))


@register("metric_line", "SCL-04", f"WITH {LOG} SELECT pos, printf('absrel=%.4f', absrel) || '  ' || printf('rmse=%.4f', rmse) AS line FROM log")
def _(spark, sf):
    return X.results_log(spark, sf).select("pos", S.metric_line({"absrel": F.col("absrel"), "rmse": F.col("rmse")}).alias("line"))


@register("ci_cell", "SCL-05", f"""WITH {LOG} SELECT pos, printf('%+.1f%% [%+.1f, %+.1f]%s', value - 20.263, value - 25.363, value - 10.163, CASE WHEN value - 25.363 > 0 OR value - 10.163 < 0 THEN ' sig' ELSE '' END) AS cell FROM log""")
def _(spark, sf):
    v = F.col("value")
    return X.results_log(spark, sf).select("pos", S.ci_cell(v - 20.263, v - 25.363, v - 10.163).alias("cell"))


@register("sensor_name", "SCL-06", """SELECT p_partkey, CASE regexp_extract('run_' || (CASE p_size % 3 WHEN 0 THEN 'l515' WHEN 1 THEN 'tof_x4' ELSE 'tofu' END), '_(l515|tof)(?:_|$)', 1)
  WHEN 'l515' THEN 'L515' WHEN 'tof' THEN 'ToF' ELSE 'D435' END AS sensor FROM part""")
def _(spark, sf):
    k = F.col("p_size") % 3
    e = F.concat(F.lit("run_"), F.when(k == 0, "l515").when(k == 1, "tof_x4").otherwise("tofu"))
    return X.table(spark, sf, "part").select("p_partkey", S.sensor_name(e).alias("sensor"))


@register("run_stamp_day", "SCL-07", f"WITH {LOG} SELECT pos, stamp, strftime(ts, '%Y-%m-%d') AS day FROM log")
def _(spark, sf):
    return X.results_log(spark, sf).select("pos", S.run_stamp(F.col("ts")).alias("stamp"), S.stamp_day(F.col("stamp")).cast("string").alias("day"))


def _leaves():
    return F.create_map(
        F.lit("dataset.name"), F.col("dataset"), F.lit("model.name"), F.col("method"), F.lit("model.docs"), F.lit("see paper"),
        F.lit("eval.max_depth"), F.lit("10"), F.lit("seed"), (F.col("pos") % 7).cast("string"), F.lit("device"), F.lit("cpu"),
        F.lit("degradation.name"), F.when(F.col("experiment") != "view", F.col("experiment")), F.lit("force_normals"), F.lit("false"))


HASH = """substr(sha1('dataset.name=' || dataset || chr(10) || CASE WHEN experiment <> 'view' THEN 'degradation.name=' || experiment || chr(10) ELSE '' END
  || 'eval.max_depth=10' || chr(10) || 'model.name=' || method || chr(10) || 'seed=' || (pos % 7)), 1, 12)"""


@register("config_hash", "SCL-08", f"WITH {LOG} SELECT pos, {HASH} AS hash FROM log")
def _(spark, sf):
    return X.results_log(spark, sf).select("pos", S.config_hash(_leaves()).alias("hash"))


@register("metric_config_json", "SCL-09", f"""WITH {LOG} SELECT DISTINCT '{{"crop":"none","max_depth":10,"method":"' || method || '"}}' AS metric_config FROM log""")
def _(spark, sf):
    return X.results_log(spark, sf).select(F.to_json(F.struct(F.lit("none").alias("crop"), F.lit(10).alias("max_depth"), "method")).alias("metric_config")).distinct()


@register("nested_flag_read", "SCL-10", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) > 50 AS flag, coalesce(json_extract_string(props, '$.absent') = 'true', false) AS absent FROM events")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return X.table(spark, sf, "events").select("event_id", (F.coalesce(k, F.lit(0)) > 50).alias("flag"),
                                                F.coalesce(F.get_json_object("props", "$.absent") == "true", F.lit(False)).alias("absent"))


@register("deep_merge", "SCL-11 SCL-12", f"""WITH {LOG} SELECT pos, 'crop=none;eval.max=' || (pos % 9) || ';model=' || method AS merged FROM log""")
def _(spark, sf):
    base = F.create_map(F.lit("model.name"), F.lit("a"), F.lit("model.scale"), F.lit("4"), F.lit("eval.max"), F.lit("10"), F.lit("crop"), F.lit("none"))
    o1 = S.override_pair(F.concat(F.lit("model="), F.col("method")))
    o2 = S.override_pair(F.concat(F.lit("eval.max="), (F.col("pos") % 9).cast("string")))
    over = F.map_from_entries(F.array(o1, o2))
    m = F.array_sort(F.map_entries(S.merge_leaves(base, over)))
    return X.results_log(spark, sf).select("pos", F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@register("lenient_numbers", "PRJ-18", """SELECT event_id, CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(t AS DOUBLE) END AS v FROM (
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'n/a' WHEN event_id % 4 = 1 THEN 'inf' WHEN event_id % 4 = 2 THEN '' ELSE value::VARCHAR END AS t FROM events)""", "v")
def _(spark, sf):
    from gridspark.operators.projection import lenient_double
    k = F.col("event_id") % 4
    t = F.when(k == 0, "n/a").when(k == 1, "inf").when(k == 2, "").otherwise(F.col("value").cast("string"))
    return X.table(spark, sf, "events").select("event_id", lenient_double(t).alias("v"))


@register("include_lists", "PRJ-13 PRJ-14", f"""WITH {FILES} SELECT path FROM files WHERE seq IN ('src1', 'src2', 'src11') OR seq LIKE 'src1%'""")
def _(spark, sf):
    return X.file_index(spark, sf).where(F.col("seq").isin("src1", "src2", "src11") | F.col("seq").startswith("src1")).select("path")


@register("orientation_filter", "PRJ-13", "SELECT source, count(*) FILTER ((n_chars >= doc_id) = (n_chars >= 300)) AS kept, count(*) FILTER ((n_chars >= doc_id) <> (n_chars >= 300)) AS dropped FROM documents GROUP BY source")
def _(spark, sf):
    same = (F.col("n_chars") >= F.col("doc_id")) == (F.col("n_chars") >= 300)
    return X.table(spark, sf, "documents").groupBy("source").agg(F.count_if(same).alias("kept"), F.count_if(~same).alias("dropped"))


@register("score_window_filter", "PRJ-15", f"WITH {PAIRS} SELECT frame, value FROM runs WHERE row_id = 'ref' AND zone = 'edge' AND metric = 'absrel' AND NOT isnan(value) AND value BETWEEN 0.05 AND 0.15", "value")
def _(spark, sf):
    r = X.paired_runs(spark, sf).where("row_id = 'ref' and zone = 'edge' and metric = 'absrel'")
    return r.where(~F.isnan("value") & F.col("value").between(0.05, 0.15)).select("frame", "value")


# ---- sampling --------------------------------------------------------------

@register("keyed_uniform", "SMP-00", f"WITH {P8} SELECT frame, y, x, {u_sql('7', 'frame', chr(39) + 'op' + chr(39), 'y', 'x', '0')} AS u FROM pix", "u")
def _(spark, sf):
    return X.pixels8(spark, sf).select("frame", "y", "x", uniform(7, F.col("frame"), "op", F.col("y"), F.col("x"), 0).alias("u"))


@register("keyed_normal", "SMP-02", f"WITH {P8} SELECT frame, y, x, {X.n_sql('7', 'frame', chr(39) + 'op' + chr(39), 'y', 'x')} AS n FROM pix", "n")
def _(spark, sf):
    return X.pixels8(spark, sf).select("frame", "y", "x", normal(7, F.col("frame"), "op", F.col("y"), F.col("x")).alias("n"))


@register("sample_per_group", "SMP-01", f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {u_sql('3', 'source', 'doc_id')}, doc_id) AS k FROM documents) WHERE k <= 6""")
def _(spark, sf):
    return SM.n_per_group(X.table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 6, 3)


@register("random_patch_origins", "SMP-03", f"""WITH {P64}, s AS (SELECT frame, max(y) + 1 AS h, max(x) + 1 AS w FROM pix GROUP BY frame), t AS (SELECT *, unnest(range(50)) AS k FROM s WHERE h >= 7 AND w >= 7)
  SELECT frame, k::INT AS k, floor({u_sql('9', 'frame', "'oy'", 'k')} * (h - 6))::INT AS oy, floor({u_sql('9', 'frame', "'ox'", 'k')} * (w - 6))::INT AS ox FROM t""")
def _(spark, sf):
    s = X.pixels64(spark, sf).groupBy("frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return SM.patch_origins(s, 50, 7, 9)


@register("group_split", "SMP-06 AGG-31", f"""WITH g AS (SELECT source, count(*) AS n_rows, row_number() OVER (ORDER BY {u_sql('0', 'source', "'split'")}, source) AS k, count(*) OVER () AS n FROM documents GROUP BY source)
  SELECT split, count(*) AS n_groups, sum(n_rows)::BIGINT AS n_shots FROM (SELECT *, CASE WHEN k <= round_even(0.2 * n, 0) THEN 'test' WHEN k <= round_even(0.2 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'train' END AS split FROM g) GROUP BY split""")
def _(spark, sf):
    g = SM.group_split(X.table(spark, sf, "documents"), "source", 0.1, 0.2, 0)
    return g.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_shots"))


RULES = """rec AS (SELECT CASE user_id % 5 WHEN 0 THEN 'zju_l5' WHEN 1 THEN 'void_stairs' WHEN 2 THEN 'minjiang' WHEN 3 THEN 'lu' ELSE 'hammer' END AS dataset,
  event_id // 2 AS sample_id, event_type AS scene, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'test' WHEN event_id % 3 = 1 THEN 'train' END AS listed FROM events)"""


def _rule_records(spark, sf):
    k, e = F.col("user_id") % 5, F.col("event_id")
    ds = F.when(k == 0, "zju_l5").when(k == 1, "void_stairs").when(k == 2, "minjiang").when(k == 3, "lu").otherwise("hammer")
    return X.table(spark, sf, "events").select(ds.alias("dataset"), F.floor(e / 2).alias("sample_id"), F.col("event_type").alias("scene"), e.alias("pos"),
                                                F.when(e % 3 == 0, "test").when(e % 3 == 1, "train").alias("listed"))


RULE_SQL = f"""{RULES}, a AS (
  SELECT *, CASE WHEN dataset = 'lu' THEN 'test' WHEN dataset = 'minjiang' THEN CASE WHEN row_number() OVER (PARTITION BY dataset, scene ORDER BY pos) <= round_even(0.8 * count(*) OVER (PARTITION BY dataset, scene), 0) THEN 'train' ELSE 'test' END
   ELSE listed END AS split FROM rec),
 b AS (SELECT * FROM a WHERE split = 'test' UNION ALL SELECT * FROM a WHERE split = 'train' AND (dataset, sample_id) NOT IN (SELECT (dataset, sample_id) FROM a WHERE split = 'test'))"""


@register("split_by_dataset_rule", "SMP-07", f"WITH {RULE_SQL} SELECT dataset, split, sample_id, pos FROM b")
def _(spark, sf):
    return SM.split_by_rule(_rule_records(spark, sf)).select("dataset", "split", "sample_id", "pos")


@register("subset_manifest", "SMP-08 SRC-30 SRC-28", f"""WITH {RULE_SQL}, d AS (SELECT DISTINCT dataset || '/' || split AS split, sample_id FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {u_sql('4', 'split', 'sample_id')}, sample_id) AS n FROM d)
  SELECT split, (m - 1) // 1000 AS part, count(*) AS n_ids, 4 AS seed, string_agg(sample_id::VARCHAR, ',' ORDER BY sample_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS m FROM k WHERE n <= 15) GROUP BY split, part""")
def _(spark, sf):
    d = SM.split_by_rule(_rule_records(spark, sf)).select(F.concat_ws("/", "dataset", "split").alias("split"), "sample_id").distinct()
    none = d.where(F.lit(False))
    from gridspark.sources.sinks import manifest
    return manifest(SM.grow_subset(d, none, 15, 4), 4)


# ---- comparisons and reports -----------------------------------------------

@register("latency_summary", "AGG-16", f"""WITH {LOG}, s AS (SELECT method, value AS ms, row_number() OVER (PARTITION BY method ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM log)
  SELECT method, avg(ms) AS mean_ms, stddev_pop(ms) AS std_ms, count(*) AS n, quantile_cont(ms, 0.5) AS median_ms, min(ms) FILTER (k = round_even(0.95 * (n - 1), 0)) AS p95_ms, 1000.0 / quantile_cont(ms, 0.5) AS fps FROM s GROUP BY method""", "mean_ms std_ms median_ms p95_ms fps")
def _(spark, sf):
    return M.latency_summary(X.results_log(spark, sf).select("method", F.col("value").alias("ms")), ["method"], "ms")


CLU = PAIRS + """, pr AS (SELECT a.frame, a.grp, a.zone, a.metric, a.value AS ref, b.value AS cur FROM runs a JOIN runs b USING (frame, zone, metric)
  WHERE a.row_id = 'ref' AND b.row_id = 'cur' AND NOT isnan(a.value) AND NOT isnan(b.value)),
 cm AS (SELECT zone, metric, grp, avg(ref) AS ref, avg(cur) AS cur FROM pr GROUP BY ALL)"""


@register("paired_relative_change", "AGG-32", f"WITH {CLU} SELECT zone, metric, 100.0 * (avg(cur) / avg(ref) - 1) AS est, count(*) AS n_clusters FROM cm GROUP BY ALL", "est")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    p = T.paired(r.where("row_id = 'ref'").drop("row_id"), r.where("row_id = 'cur'").drop("row_id"), ["frame", "zone", "metric"])
    return T.relative_change(T.cluster_means(p, ["zone", "metric"], "grp"), ["zone", "metric"])


def _boot_sql(n_boot: int, prefix: str = "") -> str:
    keys = [prefix] if prefix else []
    return f""", ix AS (SELECT *, row_number() OVER (PARTITION BY zone, metric ORDER BY grp) - 1 AS i, count(*) OVER (PARTITION BY zone, metric) AS n FROM cm),
 dr AS (SELECT zone, metric, n, boot, unnest(range(n)) AS slot FROM (SELECT DISTINCT zone, metric, n, unnest(range({n_boot})) AS boot FROM ix)),
 dq AS (SELECT zone, metric, boot, slot, floor({u_sql('0', *keys, 'zone', 'metric', 'boot', 'slot')} * n)::BIGINT AS i FROM dr),
 bt AS (SELECT zone, metric, boot, 100.0 * (avg(cur) / avg(ref) - 1) AS v FROM dq JOIN ix USING (zone, metric, i) GROUP BY ALL),
 ci AS (SELECT zone, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bt GROUP BY ALL)"""


@register("bootstrap_draws", "SMP-05", f"""WITH {CLU}{_boot_sql(200)} SELECT zone, metric, boot::INT AS boot, slot::INT AS slot, grp FROM dq JOIN ix USING (zone, metric, i)""")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    p = T.paired(r.where("row_id = 'ref'").drop("row_id"), r.where("row_id = 'cur'").drop("row_id"), ["frame", "zone", "metric"])
    return T.bootstrap_draws(T.cluster_means(p, ["zone", "metric"], "grp"), ["zone", "metric"], "grp", 200, 0).select("zone", "metric", "boot", "slot", "grp")


@register("cluster_bootstrap_ci", "AGG-33", f"WITH {CLU}{_boot_sql(1000)} SELECT zone, metric, lo, hi, (lo > 0 OR hi < 0) AS sig FROM ci", "lo hi")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    p = T.paired(r.where("row_id = 'ref'").drop("row_id"), r.where("row_id = 'cur'").drop("row_id"), ["frame", "zone", "metric"])
    return T.bootstrap_ci(T.cluster_means(p, ["zone", "metric"], "grp"), ["zone", "metric"], "grp", 1000, 0)


@register("paired_comparison_table", "BMK-05 SCL-05", f"""WITH {CLU}{_boot_sql(1000, "'cur'")}, es AS (SELECT zone, metric, 100.0 * (avg(cur) / avg(ref) - 1) AS est FROM cm GROUP BY ALL)
  SELECT 'cur' AS row_id, zone, metric, est, lo, hi, printf('%+.1f%% [%+.1f, %+.1f]%s', est, lo, hi, CASE WHEN lo > 0 OR hi < 0 THEN ' sig' ELSE '' END) AS cell FROM es JOIN ci USING (zone, metric)
  UNION ALL SELECT 'ghost', zone, metric, NULL, NULL, NULL, 'not run yet' FROM es""", "est lo hi")
def _(spark, sf):
    return R.comparison(X.paired_runs(spark, sf), "ref", ["cur", "ghost"], 1000, 0)


@register("subset_table", "AGG-34 BMK-06", f"""WITH {PAIRS}, s AS (SELECT * FROM runs SEMI JOIN (SELECT doc_id AS frame FROM labels WHERE quality = 1) USING (frame))
  SELECT row_id, zone, metric, count(*) AS frames, avg(value) FILTER (NOT isnan(value)) AS mean, coalesce(printf('%.4f', avg(value) FILTER (NOT isnan(value))), 'n/a') AS cell FROM s GROUP BY ALL""", "mean")
def _(spark, sf):
    fl = X.table(spark, sf, "labels").select(F.col("doc_id").alias("frame"), (F.col("quality") == 1).alias("flag"))
    return R.subset_table(X.paired_runs(spark, sf), fl)


@register("ablation_table", "AGG-35 BMK-07", f"""WITH {PAIRS}, w AS (SELECT row_id, avg(value) FILTER (zone = 'full' AND metric = 'absrel' AND NOT isnan(value)) AS full_absrel, avg(value) FILTER (zone = 'full' AND metric = 'rmse' AND NOT isnan(value)) AS full_rmse,
   avg(value) FILTER (zone = 'edge' AND metric = 'absrel' AND NOT isnan(value)) AS edge_absrel, avg(value) FILTER (zone = 'edge' AND metric = 'rmse' AND NOT isnan(value)) AS edge_rmse FROM runs GROUP BY row_id)
  SELECT *, 'all' AS family FROM w UNION ALL SELECT *, 'fusion' FROM (SELECT * FROM w ORDER BY full_absrel, row_id LIMIT 1)""", "full_absrel full_rmse edge_absrel edge_rmse")
def _(spark, sf):
    r = X.paired_runs(spark, sf)
    val = r.where("zone = 'full' and metric = 'absrel'").groupBy("row_id").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("val"))
    return R.ablation_table(r, val, {"fusion": ["ref", "cur"], "edge": ["3a", "3b"]}, ["full", "edge"], ["absrel", "rmse"])


NAMED = """nl AS (SELECT event_id AS pos, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, ts, 'm' || (user_id % 4) AS method, event_type,
   CASE user_id % 5 WHEN 0 THEN 'hammer' WHEN 1 THEN 'void_stairs' WHEN 2 THEN 'arkitscenes' WHEN 3 THEN 'zju_l5' ELSE 'nyuv2' END AS dataset,
   CASE event_type WHEN 'view' THEN 'dtof_sim' WHEN 'click' THEN 'bicubic' ELSE 'none' END AS degradation, event_id % 50 AS n_samples,
   value / 100.0::DOUBLE AS absrel, value / 50.0::DOUBLE AS rmse,
   CASE event_type WHEN 'view' THEN '_dtof' WHEN 'click' THEN '_x' || (4 * (1 + user_id % 3)) WHEN 'error' THEN '_l515' WHEN 'signup' THEN '_tof' ELSE '' END AS sfx FROM events),
 named AS (SELECT *, method || '_' || dataset || sfx AS experiment FROM nl)"""


def _named(spark, sf):
    k, t = F.col("user_id") % 5, F.col("event_type")
    ds = F.when(k == 0, "hammer").when(k == 1, "void_stairs").when(k == 2, "arkitscenes").when(k == 3, "zju_l5").otherwise("nyuv2")
    sfx = (F.when(t == "view", "_dtof").when(t == "click", F.concat(F.lit("_x"), (4 * (1 + F.col("user_id") % 3)).cast("string")))
           .when(t == "error", "_l515").when(t == "signup", "_tof").otherwise(""))
    me = F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))
    return X.table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), S.run_stamp(F.col("ts")).alias("stamp"), me.alias("method"), ds.alias("dataset"),
        F.when(t == "view", "dtof_sim").when(t == "click", "bicubic").otherwise("none").alias("degradation"), (F.col("event_id") % 50).alias("n_samples"),
        (F.col("value") / 100.0).alias("absrel"), (F.col("value") / 50.0).alias("rmse"), F.concat(me, F.lit("_"), ds, sfx).alias("experiment"))


@register("report_by_dataset", "BMK-09 PRJ-16 PRJ-17 JOIN-23 SRC-31", f"""WITH {NAMED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY stamp DESC, pos DESC) AS k FROM named) WHERE k = 1 AND regexp_matches(experiment, '^(m0|m1|m2)_')),
  q AS (SELECT *, regexp_extract(experiment, '_x(\\d+)$', 1) AS f, CASE regexp_extract(experiment, '_(l515|tof)(?:_|$)', 1) WHEN 'l515' THEN 'L515' WHEN 'tof' THEN 'ToF' ELSE 'D435' END AS sn FROM l),
  pub AS (SELECT 'm1_nyuv2_x8' AS experiment, 2.5 AS p_rmse, 100.0 AS p_factor UNION ALL SELECT 'm0_hammer', 0.35, 1.0 UNION ALL SELECT 'm2_zju_l5_dtof', 1.45, 255.0)
  SELECT dataset, experiment AS key, method, n_samples, absrel, rmse, rmse * p_factor AS published_unit_rmse, (rmse * p_factor - p_rmse) / p_rmse AS deviation, substr(stamp, 1, 4) || '-' || substr(stamp, 5, 2) || '-' || substr(stamp, 7, 2) AS day,
   CASE WHEN degradation = 'dtof_sim' THEN 0 WHEN f <> '' THEN f::INT WHEN dataset = 'arkitscenes' THEN 100 ELSE 0 END AS sort_rank,
   CASE WHEN degradation = 'dtof_sim' THEN 'simulated zones 8x8 from ' || CASE dataset WHEN 'hammer' THEN sn WHEN 'arkitscenes' THEN 'sensor' ELSE 'ground truth' END
    WHEN f <> '' THEN 'bicubic x' || f || ' from ' || CASE WHEN dataset = 'hammer' THEN 'D435 map' ELSE 'ground truth' END
    WHEN dataset = 'hammer' THEN 'real ' || sn || ' map' WHEN dataset = 'void_stairs' THEN 'sparse tracking points' WHEN dataset = 'arkitscenes' THEN 'real lidar 256x192' ELSE 'real zones 8x8' END AS protocol
  FROM q LEFT JOIN pub USING (experiment)""", "absrel rmse published_unit_rmse deviation")
def _(spark, sf):
    pub = spark.createDataFrame([("m1_nyuv2_x8", 2.5, 100.0), ("m0_hammer", 0.35, 1.0), ("m2_zju_l5_dtof", 1.45, 255.0)], "p_experiment string, p_rmse double, p_factor double")
    return R.report_table(_named(spark, sf), "^(m0|m1|m2)_", pub, X.report_inputs(spark))


def _regional(df):
    t = F.col("experiment").endswith("_l515") | F.col("experiment").endswith("_tof")
    return df.withColumns({c: F.when(t & (F.col("dataset") != "nyuv2"), F.round(F.col("rmse") * k, 9).cast("string")).otherwise("n/a") for k, c in enumerate(R.REGION_COLUMNS, 1)})


LINES = ", ".join(f"CASE WHEN has THEN CASE WHEN (experiment LIKE '%\\_l515' ESCAPE '\\' OR experiment LIKE '%\\_tof' ESCAPE '\\') AND dataset <> 'nyuv2' THEN round(rmse * {k}, 9) END END AS {c}" for k, c in enumerate(R.REGION_COLUMNS, 1))


@register("report_with_regions", "BMK-09", f"""WITH {NAMED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY stamp DESC, pos DESC) AS k FROM named) WHERE k = 1 AND regexp_matches(experiment, '^m')),
  t AS (SELECT key, sort_rank, protocol FROM ({REGISTRY["report_by_dataset"].sql.replace("^(m0|m1|m2)_", "^m")})),
  j AS (SELECT *, bool_or((ends_with(experiment, '_l515') OR ends_with(experiment, '_tof')) AND dataset <> 'nyuv2') OVER (PARTITION BY dataset) AS has FROM l JOIN t ON t.key = l.experiment)
  SELECT dataset, experiment AS key, has AS has_regions, {LINES}, row_number() OVER (PARTITION BY dataset ORDER BY sort_rank NULLS FIRST, protocol, method NOT IN ('m1', 'm2'), method, experiment) AS line FROM j""", " ".join(R.REGION_COLUMNS))
def _(spark, sf):
    log = _regional(_named(spark, sf))
    none = spark.createDataFrame([], "p_experiment string, p_rmse double, p_factor double")
    t = R.with_regions(R.report_table(log, "^m", none, X.report_inputs(spark)), log, ["m1", "m2"])
    return t.select("dataset", "key", "has_regions", *R.REGION_COLUMNS, F.col("line").cast("bigint").alias("line"))


@register("domain_gap", "AGG-36 BMK-10", f"""WITH {NAMED}, l AS (SELECT experiment, absrel, rmse FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY stamp DESC, pos DESC) AS k FROM named) WHERE k = 1),
  s AS (SELECT * FROM (VALUES (0, 'D435', 'm0_hammer', 'm1_hammer'), (1, 'L515', 'm0_hammer_l515', 'm1_hammer_l515'), (2, 'ToF', 'm0_hammer_tof', 'm1_absent')) v(i, sensor, a, b)),
  j AS (SELECT s.i, s.sensor, m.absrel, m.rmse, r.absrel AS raw_absrel, r.rmse AS raw_rmse FROM s LEFT JOIN l m ON m.experiment = s.a LEFT JOIN l r ON r.experiment = s.b)
  SELECT j.sensor, j.absrel, j.rmse, CASE WHEN j.i > 0 THEN (j.absrel - z.absrel) / z.absrel END AS absrel_gap, CASE WHEN j.i > 0 THEN (j.rmse - z.rmse) / z.rmse END AS rmse_gap, j.raw_absrel, j.raw_rmse FROM j, (SELECT * FROM j WHERE i = 0) z""", "absrel rmse absrel_gap rmse_gap raw_absrel raw_rmse")
def _(spark, sf):
    return R.domain_gap(T.latest_per_experiment(_named(spark, sf)), [("D435", "m0_hammer", "m1_hammer"), ("L515", "m0_hammer_l515", "m1_hammer_l515"), ("ToF", "m0_hammer_tof", "m1_absent")])


@register("result_cache", "BMK-03", f"""WITH {LOG} SELECT config_hash, dataset FROM (SELECT DISTINCT substr(sha1(k || '|' || user_id), 1, 12) AS config_hash, 'd' || (user_id % 5) AS dataset FROM log, (SELECT unnest(['view', 'zoom']) AS k))
  WHERE config_hash NOT IN (SELECT config_hash FROM log)""")
def _(spark, sf):
    log = X.results_log(spark, sf)
    m = log.select("user_id", "dataset").distinct().select("user_id", "dataset", F.explode(F.array(F.lit("view"), F.lit("zoom"))).alias("k"))
    m = m.select(F.substring(F.sha1(F.concat_ws("|", "k", F.col("user_id").cast("string"))), 1, 12).alias("config_hash"), "dataset")
    return R.cached_runs(m, log)


@register("hash_backfill", "BMK-12 JOIN-24", f"""WITH {LOG}, c AS (SELECT pos, CASE WHEN pos % 2 = 0 THEN config_hash ELSE '' END AS h, stamp, experiment, {HASH} AS n FROM log)
  SELECT pos, CASE WHEN h <> '' THEN h WHEN pos % 3 <> 0 THEN n ELSE '' END AS config_hash FROM c""")
def _(spark, sf):
    log = X.results_log(spark, sf)
    # stamps are not unique to the second here, so the event id joins the stamp
    key = F.concat_ws("-", "stamp", F.col("pos").cast("string")).alias("stamp")
    rows = log.select("pos", key, "experiment", F.when(F.col("pos") % 2 == 0, F.col("config_hash")).otherwise("").alias("config_hash"))
    conf = log.where("pos % 3 <> 0").select(key, "experiment", _leaves().alias("leaves"))
    return R.backfill_hashes(rows, conf).select("pos", "config_hash")


@register("greedy_gap_suppression", "WIN-13 BMK-14", f"""WITH RECURSIVE s AS (SELECT event_type || '/' || (user_id % 7) AS traj, event_id AS frame, value AS score FROM events),
  b1 AS (SELECT traj, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY score DESC, frame) AS k FROM s) WHERE k = 1),
  r1 AS (SELECT s.* FROM s JOIN b1 ON s.traj = b1.traj AND abs(s.frame - b1.frame) >= 500),
  b2 AS (SELECT traj, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY score DESC, frame) AS k FROM r1) WHERE k = 1),
  u AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
  SELECT traj, frame, score, row_number() OVER (ORDER BY score DESC, traj, frame)::INT AS rank FROM u ORDER BY score DESC, traj, frame LIMIT 50""", "score")
def _(spark, sf):
    s = X.table(spark, sf, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string")).alias("traj"), F.col("event_id").alias("frame"), F.col("value").alias("score"))
    return R.mined_candidates(s, "traj", "frame", "score", 2, 500, 50)


@register("mined_split", "BMK-14 TOP-10 SRC-28", f"""WITH c AS ({REGISTRY["greedy_gap_suppression"].sql}), k AS (SELECT traj || '/' || frame AS id FROM c WHERE rank <= 12 OR rank BETWEEN 20 AND 25 OR rank = 31)
  SELECT 'hypersim' AS dataset, 'stairs' AS split, 0::BIGINT AS part, '{{"dataset":"hypersim","split":"stairs","ids":[' || string_agg('"' || id || '"', ',' ORDER BY id) || ']}}' AS doc FROM k""")
def _(spark, sf):
    c = REGISTRY["greedy_gap_suppression"].run(spark, sf).withColumn("id", F.concat_ws("/", "traj", F.col("frame").cast("string")))
    said = spark.createDataFrame([("1-12 20-25",), ("31 2",)], "text string")
    return R.accepted_split(c, said, "id", "hypersim", "stairs").select("dataset", "split", F.col("part").cast("bigint").alias("part"), "doc")


@register("markdown_table", "SRC-27", f"""WITH {LOG}, m AS (SELECT dataset, method, avg(absrel) AS absrel, count(*) AS n FROM log GROUP BY ALL)
  SELECT row_number() OVER (ORDER BY dataset, method) + 2 AS line_no, '| ' || dataset || ' | ' || method || ' | ' || CASE WHEN method = 'm3' THEN 'n/a' WHEN method = 'm2' THEN '' ELSE printf('%.4f', absrel) END || ' | ' || n || ' |' AS line FROM m
  UNION ALL SELECT 1, '| dataset | method | absrel | n |' UNION ALL SELECT 2, '|---|---|---|---|'""")
def _(spark, sf):
    m = X.results_log(spark, sf).groupBy("dataset", "method").agg(F.avg("absrel").alias("absrel"), F.count(F.lit(1)).alias("n"))
    v = F.when(F.col("method") == "m3", float("nan")).when(F.col("method") == "m2", None).otherwise(F.col("absrel"))
    return T.markdown(m.withColumn("absrel", v), ["dataset", "method", "absrel", "n"], ["dataset", "method"])
