"""The listing source's partitions and pushed filters; the run log's whole-or-nothing writes."""

import pytest
from pyspark.sql import functions as F

from gridspark.catalog import q_sources
from gridspark.sources import registry as RG
from gridspark.sources import runlog as L


def tree(root):
    for s in ("stairs0", "stairs1", "hall"):
        for i in range(3):
            f = root / s / "rgb" / f"{i}.png"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"x" * i)
    (root / "readme.txt").write_text("loose")


def test_a_partition_per_directory_and_pushed_filters(spark, tmp_path, capsys):
    tree(tmp_path)
    files = RG.list_frames(spark, str(tmp_path))
    assert files.count() == 10 and files.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in files.where("sequence = ''").collect()} == {("", "readme.txt", 5)}
    for cond, n, parts in ((F.col("sequence") == "hall", 3, 1), (F.col("sequence").isin("hall", "stairs1"), 6, 2), (F.col("sequence").startswith("stairs"), 6, 2),
                           ((F.col("sequence") == "hall") & (F.col("length") > 0), 2, 1), (F.col("sequence") == "none", 0, 1)):
        few = files.where(cond)
        assert few.count() == n and few.rdd.getNumPartitions() == parts
    capsys.readouterr()
    files.where(F.col("sequence") == "hall").explain()
    plan = capsys.readouterr().out
    assert "Filter (" not in plan.replace("isnotnull(sequence", "") or "hall" not in plan.split("Filter")[1].split("BatchScan")[0]


def test_reader_keeps_what_it_can_not_push():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    r = RG._ListingReader("file:///none")
    rest = [GreaterThan(("length",), 3), EqualTo(("path",), "a")]
    assert list(r.pushFilters([EqualTo(("sequence",), "a1"), *rest, In(("sequence",), ("a1", "b")), StringStartsWith(("sequence",), "a")])) == rest
    assert r._keeps("a1") and not r._keeps("b") and not r._keeps("a2")


def test_all_loader_keys_have_a_query():
    assert set(q_sources.BY_KEY) == set(RG.LOADERS)
    with pytest.raises(KeyError):
        RG.build_index("nope", None)


def rows_of(spark, run, n):
    return spark.range(n).select(F.concat(F.lit(run), F.lit("-"), F.col("id").cast("string")).alias("a"), F.lit('x,"\n').alias("b"), F.lit(None).cast("string").alias("c")).repartition(3)


def seen(spark, place):
    out = {}
    for r in L.read_runs(spark, place, ["a", "b", "c"]).collect():
        assert r.b == 'x,"\n' and r.c is None
        out.setdefault(r.run, set()).add(r.a)
    return {k: len(v) for k, v in out.items()}


def test_concurrent_runs_and_replays(spark, tmp_path):
    place = str(tmp_path / "log")
    assert seen(spark, place) == {}
    # Two drivers whose tasks and commits cross, and a third one that writes a run of theirs again.
    rows = {r: [tuple(x) for x in rows_of(spark, r, 40).collect()] for r in ("one", "two")}
    a, b, c = L.RunWriter(place, "one"), L.RunWriter(place, "two"), L.RunWriter(place, "one")
    parts = [a.write(iter(rows["one"][:25])), b.write(iter(rows["two"])), c.write(iter(rows["one"])), a.write(iter(rows["one"][25:]))]
    assert seen(spark, place) == {}
    b.commit([parts[1], None])
    assert seen(spark, place) == {"two": 40}
    a.commit([parts[0], parts[3]])
    c.commit([parts[2]])
    L.append_run(rows_of(spark, "one", 40), place, "one")  # a replay
    L.append_run(rows_of(spark, "none", 0), place, "none")
    assert seen(spark, place) == {"one": 40, "two": 40}
    named = sum(1 for _ in (tmp_path / "log" / "rows").iterdir())
    assert L.read_runs(spark, place, ["a", "b", "c"]).rdd.getNumPartitions() <= named


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    place = str(tmp_path / "log")
    L.append_run(rows_of(spark, "good", 5), place, "good")
    before = {p.name for p in (tmp_path / "log" / "rows").iterdir()}
    bad = rows_of(spark, "bad", 30).withColumn("c", F.when(F.col("a") == "bad-17", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        L.append_run(bad, place, "bad")
    assert seen(spark, place) == {"good": 5}
    L.append_run(rows_of(spark, "bad", 30), place, "bad")
    assert seen(spark, place) == {"good": 5, "bad": 30}
    assert before <= {p.name for p in (tmp_path / "log" / "rows").iterdir()}


def test_only_appends(spark, tmp_path):
    with pytest.raises(Exception, match="only grows"):
        spark.dataSource.register(L.RunLog)
        rows_of(spark, "a", 1).write.format("run_log").option("run", "a").option("columns", "[]").mode("overwrite").save(str(tmp_path / "log"))
