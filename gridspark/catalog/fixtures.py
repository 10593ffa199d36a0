"""Derived inputs: depth frames, logs and listings computed from the given tables.

Each derivation exists twice, as a DataFrame and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels8(spark: SparkSession, sf: str) -> DataFrame:
    """One 8x8 frame per vector."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    p = e.select("frame", "grp", "v", F.posexplode("v").alias("i", "e"))
    e1 = F.col("e").cast("double")
    e2 = F.element_at("v", ((F.col("i") + 1) % 64 + 1).cast("int")).cast("double")
    return p.select(
        "frame", "grp", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"),
        F.when(e1 < -0.15, 0.0).otherwise(F.round(2 + 4 * e1, 4)).alias("gt"),
        F.round((2 + 4 * e1) * (1 + e2), 4).alias("pred"),
        F.when(e1 > 0.1, 1).when(e1 < -0.1, 2).otherwise(0).alias("cls"),
        F.least(F.lit(1.0), 0.5 + 2 * F.abs(e1)).alias("conf"),
        e1.alias("e"), e2.alias("e2"), F.lit(8).alias("h"), F.lit(8).alias("w"))


P8 = """pix AS (
  SELECT frame, grp, (i // 8)::INT AS y, (i % 8)::INT AS x,
    CASE WHEN e < -0.15 THEN 0.0 ELSE round(2 + 4 * e, 4) END AS gt,
    round((2 + 4 * e) * (1 + e2), 4) AS pred,
    CASE WHEN e > 0.1 THEN 1 WHEN e < -0.1 THEN 2 ELSE 0 END AS cls,
    least(1.0::DOUBLE, 0.5 + 2 * abs(e)) AS conf, e, e2, 8 AS h, 8 AS w
  FROM (SELECT vec_id AS frame, label AS grp, i, embedding[i + 1]::DOUBLE AS e,
               embedding[(i + 1) % 64 + 1]::DOUBLE AS e2
        FROM embeddings, (SELECT unnest(range(64)) AS i)))"""


def pixels64(spark: SparkSession, sf: str) -> DataFrame:
    """Mosaics of 64 consecutive vectors; the last one may have fewer rows."""
    e = table(spark, sf, "embeddings")
    p = e.select("vec_id", F.posexplode("embedding").alias("x", "e"), F.col("embedding").alias("v"))
    e1 = F.col("e").cast("double")
    e2 = F.element_at("v", ((F.col("x") + 1) % 64 + 1).cast("int")).cast("double")
    return p.select(
        F.floor(F.col("vec_id") / 64).alias("frame"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("x"),
        F.when(e1 < -0.15, 0.0).otherwise(F.round(2 + 4 * e1, 4)).alias("gt"),
        F.round((2 + 4 * e1) * (1 + e2), 4).alias("pred"),
        F.when(e1 > 0.1, 1).when(e1 < -0.1, 2).otherwise(0).alias("cls"),
        F.least(F.lit(1.0), 0.5 + 2 * F.abs(e1)).alias("conf"), e1.alias("e"), e2.alias("e2"))


P64 = """pix AS (
  SELECT (vec_id // 64)::BIGINT AS frame, (vec_id % 64)::INT AS y, x::INT AS x,
    CASE WHEN e < -0.15 THEN 0.0 ELSE round(2 + 4 * e, 4) END AS gt,
    round((2 + 4 * e) * (1 + e2), 4) AS pred,
    CASE WHEN e > 0.1 THEN 1 WHEN e < -0.1 THEN 2 ELSE 0 END AS cls,
    least(1.0::DOUBLE, 0.5 + 2 * abs(e)) AS conf, e, e2
  FROM (SELECT vec_id, i AS x, embedding[i + 1]::DOUBLE AS e, embedding[(i + 1) % 64 + 1]::DOUBLE AS e2
        FROM embeddings, (SELECT unnest(range(64)) AS i)))"""


def frames8(spark: SparkSession, sf: str) -> DataFrame:
    from gridspark.layouts import pixels_to_frames

    return pixels_to_frames(pixels8(spark, sf), ["gt", "pred"], ["frame", "grp"])


def normals8(spark: SparkSession, sf: str) -> DataFrame:
    """Unit normals facing the camera for the 8x8 frames."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("v"))
    p = e.select("frame", "v", F.posexplode("v").alias("i", "e"))
    a, b = F.col("e").cast("double"), F.element_at("v", ((F.col("i") + 7) % 64 + 1).cast("int")).cast("double")
    n = F.sqrt(a * a + b * b + 1.0)
    return p.select("frame", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"),
                    (a / n).alias("nx"), (b / n).alias("ny"), (-1.0 / n).alias("nz"))


N8 = """nrm AS (
  SELECT frame, (i // 8)::INT AS y, (i % 8)::INT AS x, a / sqrt(a*a + b*b + 1.0) AS nx,
         b / sqrt(a*a + b*b + 1.0) AS ny, -1.0 / sqrt(a*a + b*b + 1.0) AS nz
  FROM (SELECT vec_id AS frame, i, embedding[i + 1]::DOUBLE AS a, embedding[(i + 7) % 64 + 1]::DOUBLE AS b
        FROM embeddings, (SELECT unnest(range(64)) AS i)))"""


def results_log(spark: SparkSession, sf: str) -> DataFrame:
    """An append-only results log: one row per event."""
    ev = table(spark, sf, "events")
    ds = F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string"))
    me = F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))
    return ev.select(
        F.col("event_id").alias("pos"), F.col("ts"), F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"),
        F.col("event_type").alias("experiment"), ds.alias("dataset"), me.alias("method"),
        (F.col("value") / 100.0).alias("absrel"), (F.col("value") / 50.0).alias("rmse"),
        F.greatest(F.lit(0.0), 1.0 - F.col("value") / 200.0).alias("delta1"),
        (F.col("event_id") % 50).alias("n_samples"),
        F.substring(F.sha1(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))), 1, 12).alias("config_hash"),
        F.col("value"), F.col("user_id"))


LOG = """log AS (
  SELECT event_id AS pos, ts, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, event_type AS experiment,
    'd' || (user_id % 5) AS dataset, 'm' || (user_id % 4) AS method, value / 100.0::DOUBLE AS absrel,
    value / 50.0::DOUBLE AS rmse, greatest(0.0::DOUBLE, 1.0::DOUBLE - value / 200.0::DOUBLE) AS delta1,
    event_id % 50 AS n_samples, substr(sha1(event_type || '|' || user_id), 1, 12) AS config_hash, value, user_id
  FROM events)"""


def file_index(spark: SparkSession, sf: str) -> DataFrame:
    """A file listing: one image per document."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("data/"), "source", F.lit("/image/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"),
                 F.lit(".png")).alias("path"),
        F.col("n_chars").alias("length"), F.col("source").alias("seq"), "doc_id")


FILES = """files AS (
  SELECT 'data/' || source || '/image/' || lpad(doc_id::VARCHAR, 8, '0') || '.png' AS path,
         n_chars AS length, source AS seq, doc_id FROM documents)"""


def stereo_streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Colour and depth messages with stamps in microseconds."""
    ev = table(spark, sf, "events")
    s = ev.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp_us"),
                  F.col("event_id").alias("frame_no"))
    return (s.where("event_type = 'view'").select("stamp_us", F.col("frame_no").alias("colour_no")),
            s.where("event_type = 'click'").select("stamp_us", F.col("frame_no").alias("depth_no")))


STREAMS = """colour AS (SELECT epoch_us(ts) AS stamp_us, event_id AS colour_no FROM events WHERE event_type = 'view'),
depth AS (SELECT epoch_us(ts) AS stamp_us, event_id AS depth_no FROM events WHERE event_type = 'click')"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """A training log: one row per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("step"), F.floor(F.col("o_orderkey") / 100).alias("epoch"),
        F.col("o_totalprice").alias("total"))


STEPS = "steps AS (SELECT o_orderkey AS step, (o_orderkey // 100)::BIGINT AS epoch, o_totalprice AS total FROM orders)"


def paired_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Long per-frame metrics of two runs: ``(row_id, frame, grp, zone, metric, value)``."""
    from gridspark.operators.metrics import MetricConfig, zone_rows

    px = pixels8(spark, sf)
    both = px.select("frame", "grp", "y", "x", "gt", "cls", "conf", F.explode(F.array(
        F.struct(F.lit("ref").alias("row_id"), F.col("pred").alias("pred")),
        F.struct(F.lit("cur").alias("row_id"), F.when(F.col("gt") > 0, F.col("gt") * (1 + F.col("e2") / 2))
                 .otherwise(F.col("pred")).alias("pred")))).alias("r"))
    both = both.select("frame", "grp", "gt", "cls", "conf", "r.row_id", "r.pred")
    rows = zone_rows(both, {"full": F.lit(True), "stairs": F.col("cls") > 0, "edge": F.col("conf") >= 0.8},
                     MetricConfig(max_depth=10.0), by=["row_id", "frame", "grp"])
    return rows.select("row_id", "frame", "grp", "zone", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("absrel", "rmse", "delta1")])).alias("m")
    ).select("row_id", "frame", "grp", "zone", "m.metric", "m.value")


PAIRS = P8 + """, two AS (
  SELECT frame, grp, cls, conf, gt, unnest(['ref', 'cur']) AS row_id,
         unnest([pred, CASE WHEN gt > 0 THEN gt * (1 + e2 / 2) ELSE pred END]) AS pred FROM pix),
zon AS (
  SELECT *, least(greatest(pred, 0.001::DOUBLE), 10.0::DOUBLE) AS p, z.zone AS zone,
     (gt > 0.001 AND gt < 10 AND z.inside) AS ok
  FROM (SELECT *, unnest([{'zone': 'full', 'inside': true}, {'zone': 'stairs', 'inside': cls > 0},
                          {'zone': 'edge', 'inside': conf >= 0.8}]) AS z FROM two)),
zrow AS (
  SELECT row_id, frame, grp, zone,
    coalesce(avg(abs(p - gt) / greatest(gt, 1e-6)) FILTER (ok), 'nan'::DOUBLE) AS absrel,
    coalesce(sqrt(avg((p - gt) * (p - gt)) FILTER (ok)), 'nan'::DOUBLE) AS rmse,
    coalesce(avg((greatest(p / gt, gt / p) < 1.25)::INT) FILTER (ok), 'nan'::DOUBLE) AS delta1
  FROM zon GROUP BY ALL),
runs AS (
  SELECT row_id, frame, grp, zone, m.metric AS metric, m.value AS value FROM (
    SELECT row_id, frame, grp, zone, unnest([{'metric': 'absrel', 'value': absrel},
      {'metric': 'rmse', 'value': rmse}, {'metric': 'delta1', 'value': delta1}]) AS m FROM zrow))"""


def u_sql(*key: str) -> str:
    """The keyed uniform as SQL; ``key`` are SQL expressions, the seed first."""
    joined = " || '|' || ".join(f"({k})::VARCHAR" for k in key)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def n_sql(*key: str) -> str:
    """The keyed normal as SQL."""
    u1 = u_sql(*key, "'n1'")
    u2 = u_sql(*key, "'n2'")
    return f"(sqrt(-2.0 * ln(greatest({u1}, 1.0 / 4294967296.0::DOUBLE))) * cos(6.283185307179586::DOUBLE * {u2}))"


def report_inputs(spark: SparkSession) -> DataFrame:
    """The dimension table of inputs by dataset, degradation and experiment suffix that the reports here use."""
    rows, p = [], 0
    sources = [("hammer", "_l515(?:_|$)", "L515"), ("hammer", "_tof(?:_|$)", "ToF"), ("hammer", None, "D435"), ("arkitscenes", None, "sensor"), (None, None, "ground truth")]
    for dataset, suffix, name in sources:
        rows.append((p := p + 1, dataset, "dtof_sim", suffix, 0, f"simulated zones 8x8 from {name}"))
    rows.append((p := p + 1, "hammer", None, r"_x(\d+)$", None, "bicubic x{} from D435 map"))
    rows.append((p := p + 1, None, None, r"_x(\d+)$", None, "bicubic x{} from ground truth"))
    for dataset, suffix, name in sources[:3]:
        rows.append((p := p + 1, dataset, None, suffix, 0, f"real {name} map"))
    rows.append((p := p + 1, "void_stairs", None, None, 0, "sparse tracking points"))
    rows.append((p := p + 1, "arkitscenes", None, "ducos_arkitscenes", 99, "real lidar 256x192"))
    rows.append((p := p + 1, "arkitscenes", None, "_768$", 101, "real lidar 256x192"))
    rows.append((p := p + 1, "arkitscenes", None, None, 100, "real lidar 256x192"))
    rows.append((p := p + 1, None, None, None, 0, "real zones 8x8"))
    return spark.createDataFrame(rows, "priority int, dataset string, degradation string, suffix string, rank int, label string")
