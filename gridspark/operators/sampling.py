"""Seeded sampling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions.keyed import uniform
from gridspark.operators.ordering import ranked


def n_per_group(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int, where: Column | None = None) -> DataFrame:
    """n rows per group without replacement; all rows when the group is smaller.

    The rank filter keeps at most n rows per group and task before the shuffle.
    """
    d = df if where is None else df.where(where)
    u = uniform(seed, *[F.col(k) for k in keys], F.col(ident))
    w = W.partitionBy(*keys).orderBy(u, F.col(ident))
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def pixels_per_frame(px: DataFrame, n: int, seed: int, by: str = "frame") -> DataFrame:
    """n valid pixels per frame, by keyed random order."""
    u = uniform(seed, F.col(by), "pick", F.col("y"), F.col("x"))
    w = W.partitionBy(by).orderBy(u, "y", "x")
    return px.where("gt > 0").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def patch_origins(frames: DataFrame, tries: int, size: int, seed: int) -> DataFrame:
    """``tries`` random patch corners per frame, with replacement."""
    t = frames.where((F.col("h") >= size) & (F.col("w") >= size)).select("frame", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    y = F.floor(uniform(seed, F.col("frame"), "oy", F.col("k")) * (F.col("h") - size + 1))
    x = F.floor(uniform(seed, F.col("frame"), "ox", F.col("k")) * (F.col("w") - size + 1))
    return t.select("frame", "k", y.cast("int").alias("oy"), x.cast("int").alias("ox"))


def group_split(rows: DataFrame, group: str, val: float, test: float, seed: int) -> DataFrame:
    """Whole groups to test, val, train in a seeded order; a missing group id is an error."""
    ok = F.when(F.col(group).isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("a row has no group id")).cast("boolean"))
    g = rows.where(ok).groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    r = ranked(g.withColumn("_u", uniform(seed, F.col(group), "split")), [], ["_u", group], "_k", count="_n")
    n_test, n_val = F.rint(test * F.col("_n")), F.rint(val * F.col("_n"))
    split = F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train")
    return r.select(group, "n_rows", split.alias("split"))


# Which rule splits each dataset.
SPLIT_RULES = {
    "zju_l5": "native", "hammer": "native", "nyuv2": "native", "void_stairs": "lists",
    "minjiang": "time_block", "middlebury": "test_only", "lu": "test_only",
}


def split_rule(dataset: Column) -> Column:
    """Name of the split rule; an unknown dataset fails."""
    e = F.raise_error(F.concat(F.lit("no split rule for "), dataset)).cast("string")
    for name, rule in SPLIT_RULES.items():
        e = F.when(dataset == name, rule).otherwise(e)
    return e


def split_by_rule(records: DataFrame) -> DataFrame:
    """Apply each dataset's rule to ``(dataset, sample_id, scene, pos, listed)``; train never keeps a test id."""
    from gridspark.operators.tables import time_blocks

    r = records.withColumn("rule", split_rule(F.col("dataset")))
    native = r.where(F.col("rule").isin("native", "lists") & F.col("listed").isNotNull()).withColumn("split", F.col("listed"))
    once = r.where(F.col("rule") == "test_only").withColumn("split", F.lit("test"))
    blocks = time_blocks(r.where(F.col("rule") == "time_block"), ["dataset", "scene"], ["pos"])
    allr = native.unionByName(once).unionByName(blocks)
    held = allr.where("split = 'test'").select("dataset", "sample_id").distinct()
    return allr.where("split = 'test'").unionByName(
        allr.where("split = 'train'").join(held, ["dataset", "sample_id"], "left_anti"))


def grow_subset(records: DataFrame, have: DataFrame, n: int, seed: int) -> DataFrame:
    """Old ids plus n new ones per split, from ``(split, sample_id, pos)``; vanished old ids fail."""
    h = have.select("split", "sample_id").distinct().withColumn("held", F.lit(True))
    lost = h.join(records.select("split", "sample_id").withColumn("_here", F.lit(True)), ["split", "sample_id"], "left")
    lost = lost.where(F.when(F.col("_here"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("subset id is gone from the source: "), "sample_id")).cast("boolean")))
    rest = records.join(h, ["split", "sample_id"], "left_anti")
    picked = n_per_group(rest, ["split"], "sample_id", n, seed).select("split", "sample_id").withColumn("held", F.lit(False))
    keep = lost.select("split", "sample_id", "held").unionByName(picked)
    return records.join(keep, ["split", "sample_id"])
