"""Cases at which earlier forms switched behaviour."""

import numpy as np

from gridspark.functions import scalar as S
from gridspark.operators.raster import _row_search
from gridspark.session import Cuts, cut


def test_natural_key_takes_numbers_of_any_length(spark):
    names = ["s9", "s10", "s999999999999", "s1669999999999999", "s1669999999999999123", "s1669999999999999124", "a2b10", "a2b9", "a10", "b", "7", "07x", "s09"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(S.F.col("n")), "n").collect()]
    import re

    key = lambda n: [(t, len(d.lstrip("0") or d[:1]), d.lstrip("0") or d[:1]) for t, d in re.findall(r"(\D*)(\d*)", n)]
    assert got == sorted(names, key=lambda n: (key(n), n))
    assert [n for n in got if n.startswith("s") and n != "s09"] == names[:6]


def test_file_safe_names_do_not_meet(spark):
    long = ["x" * 200 + "a", "x" * 200 + "b", "short name"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in long], "n string").select(S.file_safe(S.F.col("n"))).collect()]
    assert len(set(got)) == 3 and all(len(g) <= 120 for g in got) and got[2] == "short-name"


def test_nearest_row_search_in_a_tall_frame():
    for top in (1, 140_000, 3_000_000):
        cy = np.array([[np.nan, top + 1.0], [top * 1.0, np.nan]])
        at, d2 = _row_search(cy, np.array([top, top]))
        assert at.tolist() == [[1, 1], [0, 0]]
        assert d2.tolist() == [[2, 1], [0, 1]]


def test_owners_of_cuts_delete_their_own(spark):
    with Cuts(spark) as a:
        x = cut(spark.range(5))
        with Cuts(spark) as b:
            y = cut(spark.range(7))
        z = cut(spark.range(2))
    assert (len(a.paths), len(b.paths)) == (2, 1)
    assert a.clear() == 2
    assert y.count() == 7
    assert b.clear() == 1 and b.clear() == 0
    del x, z


def test_pairing_keeps_late_messages_and_a_stream_resumes(spark, tmp_path):
    from gridspark.streaming import live

    src = {k: tmp_path / k for k in "lr"}

    def feed(k, n, rows):
        spark.createDataFrame(rows, "id long, ts string").selectExpr("id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(str(src[k]))

    def drain():
        side = lambda k, c: spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src[k])).withColumnRenamed("id", c)
        pairs = live.pair_streams(side("l", "a"), side("r", "b"), "ts", "a", "b", 10, lateness_s=3600)
        return live.run_to_table(pairs, place=str(tmp_path / "out"))

    feed("l", 0, [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")])
    feed("r", 0, [(10, "2024-01-01 00:10:05")])
    assert [(r.a, r.b) for r in drain().collect()] == [(2, 10)]
    # Ten minutes behind the newest message and far beyond the tolerance, but within the lateness.
    feed("r", 1, [(11, "2024-01-01 00:00:04")])
    assert sorted((r.a, r.b) for r in drain().collect()) == [(1, 11), (2, 10)]
    assert sorted((r.a, r.b) for r in drain().collect()) == [(1, 11), (2, 10)]
