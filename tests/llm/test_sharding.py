import random

import pytest
from pyspark.sql import functions as F

from gridspark.llm.sharding import Settings, shard


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, z, "x") for k, z in rows], "doc_id long, size long, id string").repartition(5)
    s = Settings(**kw)
    got = shard(df, "size", settings=s).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(rows, key=str)
    by = {}
    for r in got:
        by.setdefault(r.shard_, []).append(r)
    assert all(0 <= k < s.shards for k in by)
    last = None
    for k in sorted(by):
        part = sorted(by[k], key=lambda r: r.slot_)
        assert [r.slot_ for r in part] == list(range(len(part)))
        ids = [-(1 << 63) if r.doc_id is None else r.doc_id for r in part]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
    return [sum(max(r.size or 0, 0) for r in by.get(k, [])) for k in range(s.shards)]


@pytest.mark.parametrize("kind", ["uniform", "hot", "wide", "tiny"])
def test_sizes_are_near_equal(spark, kind):
    rng = random.Random(kind)
    n = 37 if kind == "tiny" else 6000
    rows = []
    for i in range(n):
        k = {"uniform": i, "hot": 77 if i % 3 == 0 else i, "wide": rng.randrange(-(1 << 62), 1 << 62), "tiny": i}[kind]
        rows.append((k, rng.choice([16, 30, 100, 400])))
    sizes = run(spark, rows, shards=10, bins_per_shard=4)
    # A boundary cannot be nearer than half a row; it is within the tolerance beyond that.
    assert max(abs(z - sum(sizes) / 10) for z in sizes) <= 2 * (400 / 2 + 0.002 * sum(sizes) / 40 + 200)


def test_edges(spark):
    assert sum(run(spark, [], shards=4)) == 0
    assert sum(run(spark, [(None, 5), (None, 5), (1, None), (1, 7), (1, 7), (2, -3)], shards=3)) == 24
    sizes = run(spark, [(5, 1000000)] + [(i, 10) for i in range(100)], shards=4)
    assert sum(sizes) == 1001000
    run(spark, [(i, 0) for i in range(50)], shards=4)


def test_query(spark, sf):
    from gridspark.llm.queries import QUERIES

    got = QUERIES["op3_histogram_sharding"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    assert got.filter((F.col("law") != "bytes") | F.col("grown_shard").isNotNull()).count() == 0


def test_query_shards_texts(spark, sf, monkeypatch):
    from gridspark.llm import sharding
    from gridspark.llm.queries import QUERIES

    seen = []
    whole = sharding.shard

    def spy(df, *args, **kw):
        seen.append(df.columns)
        # The digest must come from what arrived, not from the input.
        return whole(df, *args, **kw).withColumn("text", F.lit("arrived"))

    monkeypatch.setattr(sharding, "shard", spy)
    got = QUERIES["op3_histogram_sharding"](spark, sf)
    assert "text" in seen[0]
    want = spark.range(1).select(F.crc32(F.lit("arrived").cast("binary"))).first()[0]
    assert {(r.text_crc32, r.size) for r in got.collect()} == {(want, 23)}
