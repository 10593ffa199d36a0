"""Joins of pixels at size: no side that grows with the pixels is built in the driver."""

import glob
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridspark.catalog import fixtures as X
from gridspark.catalog import load
from gridspark.catalog.registry import runner
from gridspark.layouts import with_size
from gridspark.operators import geometry as G
from gridspark.session import checkpoint_root


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pixel_broadcasts(df) -> list[str]:
    """Broadcasts keyed by frame, row and column."""
    return re.findall(r"HashedRelationBroadcastMode\(List\(input\[\d+, bigint, \w+\], input\[\d+, int, \w+\], input\[\d+, int", plan(df))


@pytest.mark.parametrize("name", ["alignment_sweep", "edge_dropout", "flat_patch_noise", "ground_truth_audit"])
def test_pixels_are_not_broadcast(spark, sf, name):
    df = runner(load()[name])(spark, sf)
    assert "SortMergeJoin" in plan(df)
    assert not pixel_broadcasts(df)


def test_dense_streams_store_no_pairs(spark, sf, tmp_path):
    n = 300
    e = spark.read.parquet(f"{sf}/events.parquet").schema
    us = 1_704_067_200_000_000
    cols = {"event_id": pa.array(range(2 * n), pa.int64()), "ts": pa.array([us + i * 1000 for i in range(2 * n)], pa.timestamp("us")),
            "event_type": pa.array(["view", "click"] * n)}
    rest = {"user_id": pa.array([1] * 2 * n, pa.int64()), "value": pa.array([1.0] * 2 * n), "props": pa.array(["{}"] * 2 * n)}
    pq.write_table(pa.table({c: (cols | rest)[c] for c in e.names}), tmp_path / "events.parquet")
    place = checkpoint_root(spark).removeprefix("file:") + "/gridspark-stream-*/rows/**/*.parquet"
    before = set(glob.glob(place, recursive=True))
    got = runner(load()["stream_nearest_pairing"])(spark, str(tmp_path)).collect()
    stored = set(glob.glob(place, recursive=True)) - before
    assert sorted((r.colour_no, r.depth_no, r.gap_us) for r in got) == [(i, max(i - 1, 1), 1000) for i in range(0, 2 * n, 2)]
    assert 0 < sum(pq.read_metadata(f).num_rows for f in stored) <= 4 * n


def test_enlarged_pixels_are_not_sized_again(spark, sf):
    # one join: the given pixels and their frame's size, none of the 75 times as many pixels of the crop
    assert len(re.findall(r"Join ", plan(runner(load()["crop_eigen"])(spark, sf)).split("Initial Plan")[0])) == 1


def test_pixels_stay_where_they_are_to_meet_their_frame(spark, sf):
    # no estimate is small enough, as on a large table
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        px = X.pixels64(spark, sf)
        assert "SortMergeJoin" not in plan(with_size(px))
        n = px.select("frame", F.col("e").alias("nx"), F.col("e2").alias("ny"), F.lit(1.0).alias("nz"))
        assert "SortMergeJoin" not in plan(G.robust_up(n, F.lit(True), 1))
    finally:
        spark.conf.set(key, before)
