"""Order-dependent operators that never gather one key in one task.

Everything here range-partitions the rows by their full order, works inside the
slices and carries a few numbers per slice across. A key that holds a third of
all rows therefore spans many slices. The sliced rows are checkpointed so that
slice numbers stay the same when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.session import cut

SLICE = "_slice"


def _order(cols) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cols]


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Add the number of the range slice a row falls in, for the order (keys, order)."""
    rng = [F.col(k) for k in keys] + _order(order)
    return cut(df.repartitionByRange(*rng).withColumn(SLICE, F.spark_partition_id()))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank",
           count: str | None = None) -> DataFrame:
    """1-based position inside each key (and, with ``count``, the key's size).

    ``order`` must be total inside a key for a stable result.
    """
    s = sliced(df, keys, order)
    per = s.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if count:
        per = per.withColumn(count, F.sum("_rows").over(W.partitionBy(*keys)))
    per = per.drop("_rows")
    inner = W.partitionBy(*keys, SLICE).orderBy(*_order(order))
    s = s.withColumn("_rn", F.row_number().over(inner))
    cond = [s[k].eqNullSafe(per[k]) for k in keys] + [s[SLICE] == per[SLICE]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    out = s.join(per, on, "inner").select(
        *[s[c] for c in s.columns if c not in (SLICE, "_rn")],
        (per["_before"] + s["_rn"]).alias(name),
        *([per[count]] if count else []),
    )
    return out


def carried(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, name: str,
            how: str = "last", inclusive: bool = True) -> DataFrame:
    """Running ``last`` non-null, ``first`` non-null ahead, ``min``, ``max`` or ``sum`` of ``value``.

    ``last``, ``min``, ``max`` and ``sum`` look back, ``next`` looks ahead.
    """
    s = sliced(df.withColumn("_v", value), keys, order)
    # "next" is "last" over the reversed order: a frame that reaches to the end
    # of a partition would be summed up anew for every row
    ahead = how == "next"
    ordering = _order(order)
    frame = (W.unboundedPreceding, 0 if inclusive else -1)
    win = W.partitionBy(*keys, SLICE).orderBy(*[c.desc() if ahead else c for c in ordering]).rowsBetween(*frame)
    run = {"last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.last(c, ignorenulls=True),
           "min": F.min, "max": F.max, "sum": F.sum}[how]
    tag = F.struct(*ordering)
    kept = F.col("_v").isNotNull()
    whole = {"last": F.max_by("_v", F.when(kept, tag)), "next": F.min_by("_v", F.when(kept, tag)),
             "min": F.min("_v"), "max": F.max("_v"), "sum": F.sum("_v")}[how]
    per = s.groupBy(*keys, SLICE).agg(whole.alias("_w"))
    wide = W.partitionBy(*keys).orderBy(F.col(SLICE).desc() if ahead else F.col(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_carry", run(F.col("_w")).over(wide)).drop("_w")
    s = s.withColumn("_r", run(F.col("_v")).over(win))
    on = s[SLICE] == per[SLICE]
    for k in keys:
        on = on & s[k].eqNullSafe(per[k])
    r, c = s["_r"], per["_carry"]
    merged = {"last": F.coalesce(r, c), "next": F.coalesce(r, c), "min": F.least(r, c), "max": F.greatest(r, c),
              "sum": F.when(r.isNull() & c.isNull(), None).otherwise(F.coalesce(r, F.lit(0)) + F.coalesce(c, F.lit(0)))}[how]
    return s.join(per, on, "inner").select(
        *[s[x] for x in s.columns if x not in (SLICE, "_v", "_r")], merged.alias(name))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolation quantiles of groups of any size.

    Equal values are counted before the shuffle; then the two values around each
    wanted position are picked by cumulative count.
    """
    keys = list(keys)
    counted = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
               .groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c")))
    run = carried(counted, keys, ["_x"], F.col("_c"), "_hi", how="sum")
    size = run.groupBy(*keys).agg(F.max("_hi").alias("_n")) if keys else run.agg(F.max("_hi").alias("_n"))
    wanted = size.where("_n > 0").select(
        *keys, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
    pos = F.col("_p") * (F.col("_n") - 1)
    wanted = wanted.select(*keys, "_i", pos.alias("_pos"), F.explode(
        F.array(F.floor(pos), F.floor(pos) + 1)).alias("_at")).where("_at < _pos + 1")
    slots = run.select(*keys, "_x", (F.col("_hi") - F.col("_c")).alias("_lo"), "_hi")
    # one wanted list per key: attach it to the values as an array, keep the hits
    lists = wanted.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_pos", "_at")).alias("_w")) if keys else \
        wanted.agg(F.collect_list(F.struct("_i", "_pos", "_at")).alias("_w"))
    if keys:
        on = F.lit(True)
        for k in keys:  # a NULL key is a group too
            on = on & slots[k].eqNullSafe(lists[k])
        joined = slots.join(lists, on, "inner").select(*[slots[c] for c in slots.columns], lists["_w"])
    else:
        joined = slots.withColumn("_one", F.lit(1)).join(
            F.broadcast(lists.withColumn("_one", F.lit(1))), "_one", "inner")
    hit = joined.select(*keys, "_x", F.explode(F.filter(
        "_w", lambda w: (w["_at"] >= F.col("_lo")) & (w["_at"] < F.col("_hi")))).alias("_h"))
    frac = F.col("_h._pos") - F.floor(F.col("_h._pos"))
    weight = F.when(F.col("_h._at") == F.floor(F.col("_h._pos")), 1.0 - frac).otherwise(frac)
    part = hit.select(*keys, F.col("_h._i").alias("_i"), "_x", weight.alias("_g")).where("_g > 0")
    aggs = [F.sum(F.when(F.col("_i") == i, F.col("_x") * F.col("_g"))).alias(n) for i, n in enumerate(names)]
    return part.groupBy(*keys).agg(*aggs) if keys else part.agg(*aggs)


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank with ties averaged, over the whole table."""
    tied = df.groupBy(F.col(value).alias("_tv")).agg(F.count(F.lit(1)).alias("_c"))
    run = carried(tied, [], ["_tv"], F.col("_c"), "_hi", how="sum")
    ranks = run.select("_tv", ((2 * F.col("_hi") - F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, df[value] == ranks["_tv"], "left").drop("_tv")


def nearest_in_time(left: DataFrame, right: DataFrame, stamp: str, right_id: str,
                    keys: Sequence[str] = ()) -> DataFrame:
    """For each left row the right row closest in ``stamp``; a tie goes to the earlier one."""
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys + [stamp]]
    lrow = left.select(*keys, stamp, F.struct(*lcols).alias("_l"), F.lit(None).cast(right.schema[right_id].dataType).alias("_rid"))
    # a right stamp seen more than once keeps its first row
    rfirst = right.groupBy(*keys, stamp).agg(F.min(right_id).alias("_rid"))
    rrow = rfirst.select(*keys, stamp, F.lit(None).cast(lrow.schema["_l"].dataType).alias("_l"), "_rid")
    # right rows sort first at equal stamps, so "last" sees them
    both = lrow.unionByName(rrow).withColumn("_side", F.col("_rid").isNull().cast("int"))
    point = F.when(F.col("_rid").isNotNull(), F.struct(F.col(stamp).alias("t"), F.col("_rid").alias("id")))
    order = [stamp, "_side", F.hash("_l")]
    back = carried(both, keys, order, point, "_prev", how="last")
    both_ways = carried(back, keys, order, point, "_next", how="next")
    got = both_ways.where("_rid is null")
    gap_p = F.col(stamp) - F.col("_prev.t")
    gap_n = F.col("_next.t") - F.col(stamp)
    use_next = F.col("_prev").isNull() | (F.col("_next").isNotNull() & (gap_n < gap_p))
    return got.select(
        *keys, stamp, "_l.*",
        F.when(use_next, F.col("_next.id")).otherwise(F.col("_prev.id")).alias(right_id),
        F.when(use_next, gap_n).otherwise(gap_p).alias("gap"))
