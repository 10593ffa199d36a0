"""Indexes on real directories, strict checks, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from gridspark.operators import joins as J
from gridspark.plans import evaluate as E
from gridspark.plans import samples as B
from gridspark.sources import decode as D
from gridspark.sources import index as I
from gridspark.sources import registry as RG
from gridspark.sources import sinks as K


def touch(root, *paths):
    for p in paths:
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")


def test_sequence_layout_on_disk(spark, tmp_path):
    for s in ("stairs0", "stairs1", "hall"):
        for i in range(4):
            touch(tmp_path, f"data/{s}/image/{i:03d}.png", f"data/{s}/sparse_depth/{i:03d}.png", f"data/{s}/ground_truth/{i:03d}.png")
    files = I.list_files(spark, str(tmp_path))
    assert sorted(r.sample_id for r in I.sequence_index(files, "stairs", 3).collect()) == ["stairs0/000", "stairs0/003", "stairs1/000", "stairs1/003"]


def test_listing_data_source(spark, tmp_path):
    touch(tmp_path, "s1_rgb.png", "s1_depth_aligned_to_rgb.png", "s1_mask_aligned_valid.png", "s2_rgb.png", "sub/a.txt")
    RG.register(spark)
    files = spark.read.format("frame_listing").load(str(tmp_path))
    assert files.count() == 5
    assert [r.sample_id for r in RG.build_index("ours", files).collect()] == ["s1"]
    with pytest.raises(KeyError):
        RG.build_index("nope", files)


def test_json_lists_fall_back_to_test(spark, tmp_path):
    (tmp_path / "data.json").write_text(json.dumps({"test": [{"filename": "a"}, {"filename": "b"}]}))
    assert I.json_list_index(spark, str(tmp_path / "data.json"), "train").count() == 2


def test_unpaired_file_fails(spark):
    f = spark.createDataFrame([("a_output_color.png", 1), ("b_output_depth.png", 1)], "path string, length int")
    with pytest.raises(Exception, match="unpaired"):
        I.paired_index(f).collect()


def test_split_with_missing_id_fails_unless_lenient(spark):
    rec = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    sp = spark.createDataFrame([("b", 1), ("z", 2)], "sample_id string, pos int")
    with pytest.raises(Exception, match="not on disk"):
        J.keep_split(rec, sp).collect()
    assert [r.sample_id for r in J.keep_split(rec, sp, strict=False).collect()] == ["b"]


def test_missing_minmax_and_camera_fail(spark):
    px = spark.createDataFrame([(1, 0.5), (2, 0.5)], "frame int, d double")
    with pytest.raises(Exception, match="min/max"):
        D.minmax_denormalise(px, spark.createDataFrame([(1, 0.0, 2.0)], "frame int, lo double, hi double")).collect()
    with pytest.raises(Exception, match="camera"):
        J.camera_lookup(px, spark.createDataFrame([(1, 9.0)], "frame int, fx double"), "frame").collect()


def test_stale_mask_fails(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 1)], "frame int, y int, x int, h int, w int")
    m = spark.createDataFrame([(0, 0, 0, 2, 1, 1)], "frame int, y int, x int, h int, w int, cls int")
    with pytest.raises(Exception, match="stale"):
        J.mask_to_frame(px, m).collect()


def test_append_only_log(spark, tmp_path):
    rows = spark.createDataFrame([("20240101-000000", "e1", 0.5)], "timestamp string, experiment string, absrel double")
    for _ in range(2):
        K.append_summary(rows, str(tmp_path / "log"))
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert back.columns == list(K.SUMMARY_COLUMNS) and back.count() == 2


def test_report_is_partitioned_by_dataset(spark, tmp_path):
    K.write_by_dataset(spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, v int"), str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("dataset=*")) == ["dataset=a", "dataset=b"]


def test_latest_run_is_read(spark, tmp_path):
    for stamp, v in (("20240101-000000", 1), ("20240202-000000", 2)):
        d = tmp_path / f"{stamp}_exp"
        d.mkdir()
        (d / "per_sample.csv").write_text(f"sample_id,absrel\ns,{v}\n")
    got = I.read_latest_per_sample(spark, str(tmp_path), "exp", "sample_id string, absrel double").collect()
    assert [r.absrel for r in got] == [2.0]


def test_predictor_is_checked(spark):
    fr = spark.createDataFrame([(0, 1, 2, [1.0, 2.0])], "frame int, h int, w int, sparse array<double>")
    assert E.predict(fr, lambda d: d + 1).collect()[0].pred == [2.0, 3.0]
    with pytest.raises(Exception, match="expected"):
        E.predict(fr, lambda d: d[0]).collect()
    with pytest.raises(Exception, match="non-finite"):
        E.predict(fr, lambda d: d * float("nan")).collect()


def test_samples_need_an_input(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 1, 2.0)], "frame int, y int, x int, h int, w int, gt double")
    with pytest.raises(ValueError):
        B.build_samples(px, 0.1, 10)
    with pytest.raises(ValueError):
        B.build_samples(px, 0.1, 10, lambda p: p, "sensor")
    s, _ = B.build_samples(px, 0.1, 10, lambda p: p.withColumn("z", F.col("gt") * 2))
    r = s.collect()[0]
    assert (r.sparse, r.gt, r.input_modality) == (4.0, 2.0, "synthetic")


def test_stream_follows_appends(spark, tmp_path):
    from gridspark.streaming import live

    src = str(tmp_path / "log")
    schema = "h string, n int"
    spark.createDataFrame([("a", 1), ("b", 5), ("a", 3)], schema).write.parquet(src)
    s = spark.readStream.schema(schema).parquet(src)
    got = live.run_to_table(live.latest_per_hash(s.withColumn("v", F.col("n") * 10), "h", "n"), "h")
    assert sorted((r.h, r.v) for r in got.collect()) == [("a", 30), ("b", 50)]
