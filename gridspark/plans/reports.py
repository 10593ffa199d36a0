"""Report plans over the append-only results log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scalar as S
from gridspark.operators import tables as T
from gridspark.operators.ordering import ranked
from gridspark.operators.projection import lenient_double
from gridspark.sources.sinks import split_list


def run_matrix(datasets: Sequence[str], methods: Sequence[str], spark) -> DataFrame:
    """Every cell of the dataset x method matrix, from two short parameter lists."""
    one = spark.range(1)
    d = one.select(F.explode(F.array(*[F.lit(x) for x in datasets])).alias("dataset"))
    return d.select("dataset", F.explode(F.array(*[F.lit(x) for x in methods])).alias("method"))


def benchmark_table(matrix: DataFrame, rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Matrix cells with their result, or why there is none."""
    key = ["dataset", "method"]
    j = matrix.join(rows, key, "left").join(failures, key, "left")
    note = F.when(F.col("absrel").isNull(), F.concat(F.lit("NOT RUN: "), F.coalesce("reason", F.lit("no result")))).otherwise("")
    return j.withColumn("notes", note).drop("reason")


def cached_runs(matrix: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """Runs still to do: those whose configuration hash has no row yet."""
    return matrix if force else matrix.join(log.select("config_hash"), "config_hash", "left_anti")


def backfill_hashes(log: DataFrame, configs: DataFrame) -> DataFrame:
    """Fill empty hashes from the configuration a run left behind, by (stamp, experiment)."""
    c = configs.select("stamp", "experiment", S.config_hash(F.col("leaves")).alias("_h"))
    have = F.when(F.col("config_hash") != "", F.col("config_hash"))
    return log.join(c, ["stamp", "experiment"], "left").withColumn("config_hash", F.coalesce(have, F.col("_h"), F.lit(""))).drop("_h")


def comparison(runs: DataFrame, ref: str, rows: Sequence[str], n_boot: int = 5000, seed: int = 0,
               keep: DataFrame | None = None) -> DataFrame:
    """Paired change against the reference run with cluster-bootstrap intervals.

    ``runs`` is ``(row_id, frame, grp, zone, metric, value)``; rows that were not
    run appear as such.
    """
    if keep is not None:
        runs = runs.join(keep, "frame", "left_semi")
    r = runs.where(F.col("row_id") == ref).drop("row_id")
    cur = runs.where(F.col("row_id").isin(*rows))
    cells = r.select("zone", "metric").distinct()
    cells = cells.select("*", F.explode(F.array(*[F.lit(x) for x in rows])).alias("row_id"))
    run_ids = cur.select("row_id").distinct().withColumn("_ran", F.lit(True))
    p = T.paired(r, cur, ["frame", "zone", "metric"])
    means = T.cluster_means(p, ["row_id", "zone", "metric"], "grp")
    by = ["row_id", "zone", "metric"]
    est = T.relative_change(means, by).join(T.bootstrap_ci(means, by, "grp", n_boot, seed), by)
    out = cells.join(run_ids, "row_id", "left").join(est, by, "left")
    cell = (F.when(F.col("_ran").isNull(), "not run yet").when(F.col("est").isNull(), "n/a")
            .otherwise(S.ci_cell(F.col("est"), F.col("lo"), F.col("hi"))))
    return out.select(*by, "est", "lo", "hi", cell.alias("cell"))


def subset_table(runs: DataFrame, flags: DataFrame, invert: bool = False) -> DataFrame:
    """Mean per row and zone metric over flagged frames (or the rest), NaN skipped."""
    keep = flags.where(F.coalesce("flag", F.lit(False)) != F.lit(invert)).select("frame")
    sel = runs.join(keep, "frame", "left_semi")
    ok = ~F.isnan("value")
    m = sel.groupBy("row_id", "zone", "metric").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.when(ok, F.col("value"))).alias("mean"))
    return m.withColumn("cell", F.when(F.col("mean").isNull(), "n/a").otherwise(F.format_string("%.4f", F.col("mean"))))


def wide(runs: DataFrame, zones: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Nested zone x metric means as one wide row per run."""
    names = [f"{z}_{m}" for z in zones for m in metrics]
    v = F.when(~F.isnan("value"), F.col("value"))
    return runs.withColumn("_zm", F.concat_ws("_", "zone", "metric")).withColumn("_v", v).groupBy("row_id").pivot("_zm", names).agg(F.avg("_v"))


def ablation_table(runs: DataFrame, val: DataFrame, families: dict[str, Sequence[str]], zones, metrics) -> DataFrame:
    """Wide rows plus, per family, the variant with the lowest validation error; families without one are skipped."""
    fam = F.coalesce(*[F.when(F.col("row_id").isin(*v), k) for k, v in families.items()])
    best = T.best_variant(val.withColumn("family", fam).where(F.col("family").isNotNull()), "family", "row_id", "val")
    best = best.where(F.col("val") != float("inf"))
    w = wide(runs, zones, metrics)
    return w.withColumn("family", F.lit("all")).unionByName(best.select("row_id", "family").join(w, "row_id"))


def report_table(log: DataFrame, include: str, published: DataFrame, inputs: DataFrame, adhoc: str = "adhoc", floors: dict | None = None) -> DataFrame:
    """Latest row per experiment with protocol label, sort rank and deviation from published numbers."""
    r = T.latest_per_experiment(log, adhoc, floors)
    r = r.where(F.col("key").rlike(include) | F.col("key").contains("/"))
    r = S.with_protocol(r, inputs)
    r = r.join(published, r["key"] == published["p_experiment"], "left")
    rmse = lenient_double(F.col("rmse").cast("string"))
    ours = rmse * F.col("p_factor")
    return r.select(
        "dataset", "key", F.col("label").alias("protocol"), F.col("rank").alias("sort_rank"), "method", "n_samples",
        lenient_double(F.col("absrel").cast("string")).alias("absrel"), rmse.alias("rmse"),
        ours.alias("published_unit_rmse"), ((ours - F.col("p_rmse")) / F.col("p_rmse")).alias("deviation"),
        S.stamp_day(F.col("stamp")).cast("string").alias("day"))


# Columns that a run has where the sensor's own holes were scored apart.
REGION_COLUMNS = ("holes_frac", "holes_absrel", "holes_rmse", "holes_delta1", "valid_absrel", "valid_rmse", "valid_delta1")


def with_regions(table: DataFrame, log: DataFrame, neural: Sequence[str], adhoc: str = "adhoc", floors: dict | None = None) -> DataFrame:
    """A report table with its region columns and the order of its rows within a dataset.

    A dataset shows the region columns (``has_regions``) if any of its rows has an error in holes; elsewhere
    they are null. ``line``: by the input's rank and label, networks before reference floors, method, key.
    """
    latest = T.latest_per_experiment(log, adhoc, floors)
    more = latest.select("key", *[lenient_double(F.col(c).cast("string")).alias(c) for c in REGION_COLUMNS if c in latest.columns])
    t = table.join(more, "key", "left")
    for c in REGION_COLUMNS:
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("double"))
    shows = t.groupBy("dataset").agg(F.max(F.col("holes_rmse").isNotNull()).alias("has_regions"))
    t = t.join(shows, "dataset").withColumns({c: F.when(F.col("has_regions"), F.col(c)) for c in REGION_COLUMNS})
    return ranked(t.withColumn("_floor", ~F.col("method").isin(*neural)), ["dataset"], ["sort_rank", "protocol", "_floor", "method", "key"], "line").drop("_floor")


def missing_experiments(configured: DataFrame, latest: DataFrame, include: str) -> DataFrame:
    return configured.where(F.col("key").rlike(include)).join(latest.select("key"), "key", "left_anti")


def domain_gap(latest: DataFrame, sensors: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Error on each sensor relative to the first one, with the raw sensor's own error."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("sensor"), F.lit(m).alias("model_key"), F.lit(raw).alias("raw_key"))
                     for i, (n, m, raw) in enumerate(sensors)])
    s = latest.sparkSession.range(1).select(F.explode(rows).alias("s")).select("s.*")
    keys = [k for _, m, raw in sensors for k in (m, raw)]
    picked = latest.where(F.col("key").isin(*keys)).select("key", "absrel", "rmse")
    m = picked.select(F.col("key").alias("model_key"), "absrel", "rmse")
    raw = picked.select(F.col("key").alias("raw_key"), F.col("absrel").alias("raw_absrel"), F.col("rmse").alias("raw_rmse"))
    j = s.join(m, "model_key", "left").join(raw, "raw_key", "left")
    ref = j.where("i = 0").select(F.lit(1).alias("_one"), F.col("absrel").alias("_a"), F.col("rmse").alias("_r"))
    out = j.withColumn("_one", F.lit(1)).join(ref, "_one", "left")
    rel = lambda v, r: F.when(F.col("i") > 0, (F.col(v) - F.col(r)) / F.col(r))
    return out.select("sensor", "absrel", "rmse", rel("absrel", "_a").alias("absrel_gap"), rel("rmse", "_r").alias("rmse_gap"),
                      "raw_absrel", "raw_rmse")


def mined_candidates(scores: DataFrame, group: str, frame: str, score: str, per_traj=2, gap=15, top=120) -> DataFrame:
    """Score, suppress neighbours, rank: the candidate list with its ranks."""
    kept = T.greedy_with_gap(scores, group, frame, score, per_traj, gap, top)
    # at most ``top`` rows are left, so the numbering window is bounded
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(1)).orderBy(F.col(score).desc(), group, frame)
    return kept.withColumn("rank", F.row_number().over(w))


def accepted_split(candidates: DataFrame, tokens: DataFrame, ident: str, dataset: str, split: str) -> DataFrame:
    """The split list of the candidates whose ranks a reviewer accepted (``1 2 5-9``); unknown ranks fail.

    ``tokens``: rows of a text column; ranks named twice count once. Ids are listed in their own order.
    """
    asked = T.parse_ranks(tokens)
    seen = asked.join(candidates.select("rank", ident), "rank", "left")
    known = F.when(F.col(ident).isNull(), F.raise_error(F.concat(F.lit("no such rank: "), F.col("rank").cast("string"))).cast("string")).otherwise(F.col(ident))
    rows = seen.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), known.alias("id"), known.alias("_order"))
    return split_list(rows, "_order", "id")


def table_title(rows: DataFrame, order: Sequence[str], limit: int = 120) -> DataFrame:
    """``<methods>__<datasets>`` in first-seen order, file-safe."""
    def names(c: str) -> DataFrame:
        f = T.first_seen(rows, c, order)
        # distinct names of a run list: a short dimension
        return f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", c))), lambda s: s[c]), "-").alias(c + "s"))

    j = names("method").withColumn("_o", F.lit(1)).join(names("dataset").withColumn("_o", F.lit(1)), "_o")
    return j.select(S.file_safe(F.concat_ws("__", "methods", "datasets"), limit).alias("title"))
