"""Operators on result tables: latest rows, comparisons, unions by schema version."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from gridspark.functions.keyed import uniform
from gridspark.operators.ordering import carried, ranked
from gridspark.session import cut


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. The choice is a max, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(row).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def latest_per_experiment(log: DataFrame, adhoc: str = "adhoc", floors: dict | None = None) -> DataFrame:
    """Newest row per experiment; ad-hoc rows are keyed dataset/method and kept only for the floors."""
    floors = floors or {}
    is_adhoc = F.col("experiment") == adhoc
    keep = ~is_adhoc
    for dataset, methods in floors.items():
        keep = keep | (is_adhoc & (F.col("dataset") == dataset) & F.col("method").isin(*methods))
    key = F.when(is_adhoc, F.concat_ws("/", "dataset", "method")).otherwise(F.col("experiment"))
    return latest(log.where(keep).withColumn("key", key), ["key"], ["stamp", "pos"])


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence, n) -> DataFrame:
    r = ranked(df, keys, order, "_k")
    return r.where((F.col("_k") - 1) % n == 0).drop("_k")


def evenly_spaced(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """Rows at positions ``floor(i*(N-1)/(n-1))``, each once."""
    r = ranked(df, [], order, "_k", count="_n") if df.columns else df
    step = (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))
    first = F.ceil((F.col("_k") - 1) / F.when(step > 0, step).otherwise(1.0))
    near = F.array(first - 1, first, first + 1)
    hit = F.exists(near, lambda i: (i >= 0) & (i <= n - 1) & (F.floor(i * step) == F.col("_k") - 1))
    return r.where(hit).drop("_k", "_n")


def time_blocks(df: DataFrame, keys: Sequence[str], order: Sequence, train: float = 0.8) -> DataFrame:
    r = ranked(df, keys, order, "_k", count="_n")
    return r.withColumn("split", F.when(F.col("_k") <= F.rint(train * F.col("_n")), "train").otherwise("test")).drop("_k", "_n")


def cap_by_stride(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """``records[::ceil(N/n)]``."""
    r = ranked(df, [], order, "_k", count="_n")
    return r.where((F.col("_k") - 1) % F.ceil(F.col("_n") / n) == 0).drop("_k", "_n")


def audit_stride(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """Every ``max(1, N // k)``-th row, then the first k."""
    r = ranked(df, [], order, "_k", count="_n")
    s = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return r.where(((F.col("_k") - 1) % s == 0) & ((F.col("_k") - 1) / s < k)).drop("_k", "_n")


def value_gaps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Differences of neighbouring distinct values."""
    d = df.select(*keys, value).distinct()
    c = carried(d, keys, [value], F.col(value), "_prev", how="last", inclusive=False)
    return c.where("_prev is not null").select(*keys, (F.col(value) - F.col("_prev")).alias("gap"))


@F.arrow_udf(ArrayType(BooleanType()))
def _apart(frames: pa.Array, gap: pa.Array, most: pa.Array) -> pa.Array:
    """Which frames, best first, are at least ``gap`` from all accepted before."""
    out = []
    for row, g, k in zip(frames.to_pylist(), gap.to_pylist(), most.to_pylist(), strict=True):
        held, got = [], []
        for f in row:
            i = bisect_left(held, f)
            fits = len(held) < k and (i == len(held) or held[i] - f >= g) and (i == 0 or f - held[i - 1] >= g)
            if fits:
                held.insert(i, f)
            got.append(fits)
        out.append(got)
    return pa.array(out, pa.list_(pa.bool_()))


def greedy_with_gap(scores: DataFrame, group: str, frame: str, score: str, per_group: int, gap: int, top: int) -> DataFrame:
    """Best first per group, at least ``gap`` frames apart, then the overall top.

    A frame that is accepted keeps out at most ``2 * gap - 2`` others, so ``per_group`` are accepted
    among a group's ``per_group * (2 * gap - 1)`` best frames. A rank filter keeps these, Spark
    applies it before the shuffle, and one pass over this bounded list decides. ``frame`` holds whole
    numbers; of rows of one frame the best counts, equal scores are ordered by frame.
    """
    rest = [c for c in scores.columns if c not in (group, frame)]
    one = scores.groupBy(group, frame).agg(F.max_by(F.struct(*rest), F.struct(score, *rest)).alias("_r"))
    best = W.partitionBy(group).orderBy(F.col(f"_r.{score}").desc(), frame)
    few = one.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= per_group * max(2 * gap - 1, 1))
    lists = few.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_k", F.col(frame).alias("_f"), "_r"))).alias("_l"))
    kept = lists.select(group, F.explode(F.arrays_zip("_l", _apart(F.col("_l._f").cast("array<bigint>"), F.lit(gap), F.lit(per_group)).alias("_ok"))).alias("_p")).where("_p._ok")
    picked = kept.select(group, F.col("_p._l._f").alias(frame), *[F.col("_p._l._r")[c].alias(c) for c in rest]).select(*scores.columns)
    return picked.orderBy(F.col(score).desc(), group, frame).limit(top)


def best_so_far(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running minimum and whether the row improved on everything before it."""
    c = carried(df, keys, order, F.col(value), "_before", how="min", inclusive=False)
    better = F.col("_before").isNull() | (F.col(value) < F.col("_before"))
    return c.select(*df.columns, F.least(value, "_before").alias("best"), better.alias("is_best"))


def best_variant(df: DataFrame, family: str, ident: str, value: str) -> DataFrame:
    """Lowest validation value per family; a missing value counts as infinite."""
    v = F.coalesce(F.col(value), F.lit(float("inf")))
    return df.groupBy(family).agg(F.min_by(ident, F.struct(v, F.col(ident))).alias(ident), F.min(v).alias(value))


def parse_ranks(tokens: DataFrame, text: str = "text") -> DataFrame:
    """``1 2 5-9`` to one row per rank."""
    tok = tokens.select(F.explode(F.split(F.trim(text), r"\s+")).alias("t"))
    a, b = F.regexp_extract("t", r"^(\d+)(?:-(\d+))?$", 1), F.regexp_extract("t", r"^(\d+)(?:-(\d+))?$", 2)
    lo = F.when(a == "", F.raise_error(F.concat(F.lit("bad rank "), "t")).cast("int")).otherwise(a.try_cast("int"))
    hi = F.when(b == "", lo).otherwise(b.try_cast("int"))
    return tok.select(F.explode(F.sequence(lo, hi)).alias("rank")).distinct()


def by_schema_version(lines: DataFrame, versions: Sequence[Sequence[str]], columns: Sequence[str], text: str = "value") -> DataFrame:
    """Rows of several past widths under one schema; an unknown width fails, absent cells are blank."""
    by_width = {len(v): list(v) for v in versions}
    cells = F.split(text, ",", -1)
    n = F.size(cells)
    known = F.when(n.isin(*by_width), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unknown layout of width "), n.cast("string"))).cast("boolean"))

    def cell(c: str) -> Column:
        e = F.lit("")
        for width, names in by_width.items():
            if c in names:
                e = F.when(n == width, F.get(cells, F.lit(names.index(c)))).otherwise(e)
        return e.alias(c)

    return lines.where(known).select(*[cell(c) for c in columns])


def paired(ref: DataFrame, cur: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows present and finite in both runs."""
    a = ref.withColumnRenamed("value", "ref")
    b = cur.select(*on, *[c for c in cur.columns if c not in a.columns and c != "value"], F.col("value").alias("cur"))
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return a.join(b, list(on)).where(fin("ref") & fin("cur"))


def cluster_means(pairs: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    return pairs.groupBy(*by, cluster).agg(F.avg("ref").alias("ref"), F.avg("cur").alias("cur"))


def relative_change(means: DataFrame, by: Sequence[str]) -> DataFrame:
    return means.groupBy(*by).agg((100.0 * (F.avg("cur") / F.avg("ref") - 1.0)).alias("est"),
                                  F.count(F.lit(1)).alias("n_clusters"))


def bootstrap_draws(means: DataFrame, by: Sequence[str], cluster: str, n_boot: int, seed: int, most: int = 500_000) -> DataFrame:
    """``n_boot`` resamples of the clusters with replacement, one row per draw.

    The resamples are dealt to tasks by (``by``, ``boot``) before they are expanded. Up to ``most`` numbered clusters,
    counted first, are sent to every task, so a draw finds its cluster where it is made and a sum over a
    resample needs no further shuffle. More clusters meet their draws by a shuffle join.
    """
    by = list(by)
    g = cut(ranked(means, by, [cluster], "_i", count="_n").withColumn("_i", F.col("_i") - 1))
    head = g.where("_i = 0").select(*by, "_n")
    few = g.count() <= most
    d = head.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    d = d.repartition(*by, "boot").select("*", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("slot"))
    u = uniform(seed, *[F.col(b) for b in by], F.col("boot"), F.col("slot"))
    d = d.withColumn("_i", F.floor(u * F.col("_n")))
    g = g.drop("_n")
    return d.drop("_n").join(F.broadcast(g) if few else g, [*by, "_i"]).drop("_i")


def bootstrap_ci(means: DataFrame, by: Sequence[str], cluster: str, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    d = bootstrap_draws(means, by, cluster, n_boot, seed)
    b = d.groupBy(*by, "boot").agg((100.0 * (F.avg("cur") / F.avg("ref") - 1.0)).alias("v"))
    # n_boot values per group: a fixed number, so the exact percentile is bounded
    q = b.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    q = q.select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return q.withColumn("sig", (F.col("lo") > 0) | (F.col("hi") < 0))


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Markdown lines with their position; floats as %.4f, NaN as n/a, NULL blank."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        v = F.col(c)
        if kinds[c] in ("double", "float"):
            v = F.when(F.isnan(v), "n/a").otherwise(F.format_string("%.4f", v))
            v = F.when(F.col(c).isNull(), "").otherwise(v)
            return v
        return F.coalesce(v.cast("string"), F.lit(""))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = ranked(rows.select(*dict.fromkeys([*columns, *order])), [], list(order), "_k").select(
        (F.col("_k") + 2).alias("line_no"), line.alias("line"))
    spark = rows.sparkSession
    head = spark.range(1, 3).select(F.col("id").alias("line_no"), F.when(
        F.col("id") == 1, "| " + " | ".join(columns) + " |").otherwise("|" + "|".join(["---"] * len(columns)) + "|").alias("line"))
    return head.unionByName(body)


def first_seen(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Distinct names with the place they were first seen."""
    return df.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(
        F.min(F.struct(*order)).alias("first"))
