"""Frame indexes from file listings, one function per directory layout.

A listing is ``(path, length)``; :func:`list_files` makes one from storage. An
index is a DataFrame of records with ``sample_id`` and the companion paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.keyed import uniform
from gridspark.functions.scalar import stem
from gridspark.operators.ordering import ranked
from gridspark.operators.projection import require
from gridspark.operators.tables import every_nth

# Dataset dimension (name, modality, window in metres, unit per metre, crop).
DATASETS = (
    ("void_stairs", "sparse", 0.2, 10.0, 256.0, "none"),
    ("minjiang", "gt_only", 0.3, 8.0, 1000.0, "none"),
    ("nyuv2", "gt_only", 0.001, 10.0, 1.0, "eigen"),
    ("zju_l5", "sparse", 0.001, 10.0, 1.0, "none"),
    ("hammer", "sparse", 0.1, 5.0, 1000.0, "none"),
    ("arkitscenes", "lr", 0.05, 10.0, 1000.0, "none"),
    ("hypersim", "gt_only", 0.001, 20.0, 1.0, "none"),
    ("middlebury", "gt_only", 0.0, 1.01, 255.0, "border6"),
    ("lu", "gt_only", 0.0, 1.01, 255.0, "border6"),
    ("rgbd_stair", "gt_only", 0.2, 10.0, None, "none"),
    ("stairnet_rel", "gt_only", 0.0, 1.01, 255.0, "none"),
    ("synthetic_stairs", "gt_only", 0.3, 8.0, 1.0, "none"),
)
SPLIT_DIRS = {"train": "Training", "val": "Validation", "test": "Validation"}
TEST_SCENES = ("scene12", "scene13", "scene14")


def dataset_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DATASETS), "dataset string, modality string, min_depth double, max_depth double, unit_per_m double, crop string")


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Names and sizes only: file contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + _quoted(base) + "/", "")
    return r.load(root).select(rel.alias("path"), "length")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def part(pattern: str, group: int) -> Column:
    return F.regexp_extract("path", pattern, group)


def matching(files: DataFrame, pattern: str, **names: int) -> DataFrame:
    """Files whose path fits, with named groups as columns."""
    return files.where(F.col("path").rlike(pattern)).select("path", *[part(pattern, g).alias(n) for n, g in names.items()])


def sequence_index(files: DataFrame, prefix: str = "stairs", stride: int = 1) -> DataFrame:
    """``data/<seq>/image/<stem>.png`` with sparse and ground-truth siblings, strided per sequence."""
    img = matching(files, r"^data/([^/]+)/image/([^/]+)\.png$", seq=1, stem=2).where(F.col("seq").startswith(prefix))
    if stride > 1:
        img = every_nth(img, ["seq"], ["path"], stride)
    for kind in ("sparse_depth", "ground_truth"):
        sib = matching(files, rf"^data/([^/]+)/{kind}/([^/]+)\.png$", seq=1, stem=2).withColumnRenamed("path", kind)
        img = img.join(sib, ["seq", "stem"])
    return img.select(F.concat_ws("/", "seq", "stem").alias("sample_id"), "seq", F.col("path").alias("image"), "sparse_depth", "ground_truth")


def scene_camera_index(files: DataFrame, scenes: Sequence[str], cameras: Sequence[str]) -> DataFrame:
    """``<scene>/<cam>_RGB/<stamp>_rgb_..png`` with ``<scene>/<cam>_GDEP/<stamp>_grey_depth_<cam>.png``."""
    rgb = matching(files, r"^([^/]+)/([^/]+)_RGB/([^/]+?)_rgb_[^/]*\.png$", scene=1, camera=2, stamp=3)
    rgb = rgb.where(F.col("scene").isin(*scenes) & F.col("camera").isin(*cameras))
    want = F.concat("scene", F.lit("/"), "camera", F.lit("_GDEP/"), "stamp", F.lit("_grey_depth_"), F.lower("camera"), F.lit(".png"))
    return rgb.withColumnRenamed("path", "rgb").withColumn("path", want).join(files.select("path"), "path").select(
        F.concat_ws("/", "scene", "camera", "stamp").alias("sample_id"), "scene", "camera", "stamp", "rgb", F.col("path").alias("depth"))


def numbered_shot_index(files: DataFrame) -> DataFrame:
    """``s<id>_rgb.png`` with aligned depth and mask, ordered by number."""
    kinds = {"rgb": "rgb", "depth": "depth_aligned_to_rgb", "mask": "mask_aligned_valid"}
    out = None
    for name, suffix in kinds.items():
        f = matching(files, rf"^s(\d+)_{suffix}\.png$", num=1).select(F.col("num").cast("int").alias("num"), F.col("path").alias(name))
        out = f if out is None else out.join(f, "num")
    return out.select(F.concat(F.lit("s"), F.col("num").cast("string")).alias("sample_id"), "num", *kinds)


def trajectory_index(files: DataFrame, split: str = "test", scenes: Sequence[str] = (), rgb: str = "rgb", gt: str = "gt", stream: str = "d435",
                     stride: int = 1, need_input: bool = False) -> DataFrame:
    """Any directory with an rgb subdirectory; the input stream is optional unless the run needs it."""
    seen = matching(files, rf"^(?:.*/)?([^/]+)/{rgb}/([^/]+)$", seq=1, file=2)
    wanted = tuple(scenes) or TEST_SCENES
    hit = F.lit(False)
    for s in wanted:
        hit = hit | F.col("seq").startswith(s)
    if not scenes and split == "train":
        hit = ~hit
    seen = seen.where(hit)
    if stride > 1:
        seen = every_nth(seen, ["seq"], ["path"], stride)
    g = matching(files, rf"^(?:.*/)?([^/]+)/{gt}/([^/]+)$", seq=1, file=2).withColumnRenamed("path", "gt")
    i = matching(files, rf"^(?:.*/)?([^/]+)/{stream}/([^/]+)$", seq=1, file=2).withColumnRenamed("path", "input")
    j = seen.join(g, ["seq", "file"]).join(i, ["seq", "file"], "inner" if need_input else "left")
    return j.select(F.concat_ws("/", "seq", F.regexp_replace("file", r"\.[^.]*$", "")).alias("sample_id"), "seq", F.col("path").alias("rgb"), "gt", "input")


def json_list_index(spark: SparkSession, path: str, split: str) -> DataFrame:
    """``data.json`` with one list per split; an absent split falls back to ``test``."""
    doc = spark.read.schema("train array<struct<filename:string>>, val array<struct<filename:string>>, test array<struct<filename:string>>").json(path, multiLine=True)
    return entries_of(doc, split)


def entries_of(doc: DataFrame, split: str) -> DataFrame:
    mine = F.when(F.size(F.coalesce(F.col(split), F.array())) > 0, F.col(split))
    return doc.select(F.explode(F.coalesce(mine, F.col("test"), F.array().cast("array<struct<filename:string>>"))).alias("e")).select(F.col("e.filename").alias("sample_id"))


def triple_index(files: DataFrame, split: str, stride: int = 1) -> DataFrame:
    """``<split dir>/<video>/{wide,lowres_depth,highres_depth}/<file>`` triples."""
    base = SPLIT_DIRS[split]
    kinds = {"gt": "highres_depth", "rgb": "wide", "lr": "lowres_depth"}
    out = None
    for name, d in kinds.items():
        f = matching(files, rf"^data/upsampling/{base}/([^/]+)/{d}/([^/]+)\.png$", video=1, stem=2)
        if name == "gt" and stride > 1:
            f = every_nth(f, ["video"], ["path"], stride)
        f = f.withColumnRenamed("path", name)
        out = f if out is None else out.join(f, ["video", "stem"])
    return out.select(F.concat_ws("/", "video", "stem").alias("sample_id"), "video", *kinds)


def camera_frame_index(files: DataFrame, scenes: Sequence[str] = (), stride: int = 1) -> DataFrame:
    """``ai_*/images/scene_cam_XX_geometry_hdf5/frame.N.depth_meters.hdf5`` with colour and optional normals, strided per camera."""
    g = r"^(ai_[^/]+)/images/scene_cam_([^/]+)_geometry_hdf5/frame\.(\d+)\."
    d = matching(files, g + r"depth_meters\.hdf5$", scene=1, cam=2, frame=3)
    if scenes:
        d = d.where(F.col("scene").isin(*scenes))
    if stride > 1:
        d = every_nth(d, ["scene", "cam"], ["path"], stride)
    key = ["scene", "cam", "frame"]
    c = matching(files, r"^(ai_[^/]+)/images/scene_cam_([^/]+)_final_preview/frame\.(\d+)\.color\.jpg$", scene=1, cam=2, frame=3).withColumnRenamed("path", "rgb")
    n = matching(files, g + r"normal_cam\.hdf5$", scene=1, cam=2, frame=3).withColumnRenamed("path", "normal")
    j = d.withColumnRenamed("path", "depth").join(c, key).join(n, key, "left")
    return j.select(F.concat(F.col("scene"), F.lit("/cam_"), F.col("cam"), F.lit("/"), F.col("frame")).alias("sample_id"), "scene", "depth", "rgb", "normal")


def positional_index(frames: DataFrame, order: Sequence, start: int = 0, stop: int | None = None) -> DataFrame:
    """``nyu_%04d`` ids by position, limited to a half-open range."""
    r = ranked(frames, [], order, "_k").withColumn("pos", F.col("_k") - 1).drop("_k")
    r = r.where(F.col("pos") >= start) if stop is None else r.where((F.col("pos") >= start) & (F.col("pos") < stop))
    return r.withColumn("sample_id", F.format_string("nyu_%04d", "pos"))


def paired_index(files: DataFrame, left: str = "_output_color.png", right: str = "_output_depth.png") -> DataFrame:
    """Two lists paired by name; anything without its partner fails the job."""
    a = files.where(F.col("path").endswith(left)).select(F.lower(F.replace("path", F.lit(left), F.lit(""))).alias("stem"), F.col("path").alias("rgb"))
    b = files.where(F.col("path").endswith(right)).select(F.lower(F.replace("path", F.lit(right), F.lit(""))).alias("stem"), F.col("path").alias("depth"))
    j = a.join(b, "stem", "full")
    return require(j, F.col("rgb").isNotNull() & F.col("depth").isNotNull(), "unpaired file").select(F.col("stem").alias("sample_id"), "rgb", "depth")


def ranged_index(files: DataFrame, extrinsics: DataFrame, max_range_mm: float | None = None) -> DataFrame:
    """Colour/depth pairs by frame number with the depth range from the extrinsics text ``(path, value)``."""
    c = matching(files, r"color_(\d+)\.png$", n=1).withColumnRenamed("path", "rgb")
    d = matching(files, r"Depth_(\d+)\.png$", n=1).withColumnRenamed("path", "depth")
    tok = F.split(F.trim("value"), r"\s+")
    e = extrinsics.select(part(r"Extrinsics_(\d+)\.txt$", 1).alias("n"), F.get(tok, F.lit(0)).try_cast("double").alias("dmin"), F.get(tok, F.lit(1)).try_cast("double").alias("dmax"))
    j = c.join(d, "n").join(e, "n").withColumn("num", F.col("n").cast("int"))
    if max_range_mm is not None:
        j = j.where(~(F.col("dmax") - F.col("dmin") > max_range_mm))
    return j.select(F.col("n").alias("sample_id"), "num", "rgb", "depth", "dmin", "dmax")


def line_labels(records: DataFrame, text: DataFrame) -> DataFrame:
    """Attach label lines ``cls x1 y1 x2 y2`` of ``(sample_id, value)``; no file gives an empty list."""
    rows = text.select("sample_id", F.posexplode(F.split("value", "\n")).alias("_p", "l")).where(F.trim("l") != "")
    t = F.split(F.trim("l"), r"\s+")
    seg = F.struct(F.col("_p").alias("pos"), t[0].cast("int").alias("kind"), *[t[i].cast("double").alias(n) for i, n in ((1, "x1"), (2, "y1"), (3, "x2"), (4, "y2"))])
    g = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(seg)).alias("lines"))
    empty = F.array().cast("array<struct<pos:int,kind:int,x1:double,y1:double,x2:double,y2:double>>")
    return records.join(g, "sample_id", "left").withColumn("lines", F.coalesce("lines", empty))


def procedural_staircase(ids: DataFrame, h: int, w: int, n_steps: int = 6, seed: int = 1000) -> DataFrame:
    """A generated staircase per id: each pixel is a formula of (frame, y, x)."""
    px = ids.select("frame", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    d0 = 1.0 + 0.25 * uniform(seed, F.col("frame"), "d0")
    up = 1.0 - F.col("y") / float(max(h - 1, 1))
    across = -0.5 + F.col("x") / float(max(w - 1, 1))
    band = F.least(F.greatest(F.floor(up * n_steps), F.lit(0)), F.lit(n_steps - 1))
    # Tread depth, rise and the small ramp of the generated stairs.
    z = (d0 + band * 0.28 + (up * n_steps - band) * 0.17 * 0.4) * (1.0 + 0.12 * across * across)
    return px.select("frame", "y", "x", F.lit(h).alias("h"), F.lit(w).alias("w"), F.least(z, d0 + n_steps * 0.28 + 0.6).alias("gt"))


def unreadable(files: DataFrame) -> DataFrame:
    """Readable flag per file: an empty file is named and counted, not fatal."""
    return files.withColumn("readable", F.col("length") > 0)


def layout_check(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected paths (files or directories) that are not on disk."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    have = files.select(F.explode(prefixes).alias("path")).distinct()
    return expected.join(have, "path", "left_anti")


def latest_run_rows(files: DataFrame) -> DataFrame:
    """Per experiment the newest ``runs/<stamp>_<experiment>/`` directory."""
    m = matching(files, r"runs/(\d{8}-\d{6})_([^/]+)/per_sample\.csv$", stamp=1, experiment=2)
    return m.groupBy("experiment").agg(F.max_by("path", "stamp").alias("path"), F.max("stamp").alias("stamp"))


def read_latest_per_sample(spark: SparkSession, root: str, experiment: str, schema: str) -> DataFrame:
    """Per-sample rows of an experiment's newest run."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{root}/*_{experiment}/per_sample.csv").withColumn("_run", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{8}-\d{6})_", 1))
    last = rows.agg(F.max("_run").alias("_run"))
    return rows.join(F.broadcast(last), "_run").drop("_run")


def zone_documents(docs: DataFrame, zones: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Nested ``per_frame`` documents to long rows ``(row_id, frame, zone, metric, value)``."""
    f = docs.select("row_id", F.explode("per_frame").alias("f"))
    cells = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(m).alias("metric"), F.col(f"f.{z}.{m}").alias("value")) for z in zones for m in metrics])
    return f.select("row_id", F.col("f.id").alias("frame"), F.explode(cells).alias("c")).select("row_id", "frame", "c.zone", "c.metric", "c.value").where("value is not null")


def topic_messages(events: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Messages of the wanted topics; sort where a consumer needs the order."""
    return events.where(F.col("topic").isin(*topics))
