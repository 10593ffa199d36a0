"""Depth metrics per frame, per region, per zone and pooled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import projection as P

METRICS = ("absrel", "sqrel", "rmse", "mae", "rmse_log", "silog", "delta1", "delta2", "delta3")
HIGHER_IS_BETTER = ("delta1", "delta2", "delta3")


@dataclass(frozen=True)
class MetricConfig:
    # The protocol's default window and floors.
    min_depth: float = 1e-3
    max_depth: float = 10.0
    clamp_pred: bool = True
    crop: str = "none"
    eps: float = 1e-6
    min_valid_pixels: int = 1

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_depth < self.max_depth:
            raise ValueError("need 0 <= min_depth < max_depth")


def scored(px: DataFrame, cfg: MetricConfig = MetricConfig(), mask: str | None = None) -> DataFrame:
    """Crop, then add ``g``, ``p`` and ``valid``."""
    px = P.crop(px, cfg.crop)
    g = F.col("gt").cast("double")
    p = F.col("pred").cast("double")
    valid = P.gt_valid(g, cfg.min_depth, cfg.max_depth, F.col(mask) if mask else None)
    if cfg.clamp_pred:
        p = P.clamp_pred(p, cfg.min_depth, cfg.max_depth)
    else:
        valid = valid & P.finite(p)
    return px.withColumn("g", g).withColumn("p", p).withColumn("valid", F.coalesce(valid, F.lit(False)))


def error_aggs(valid: Column, eps: float = 1e-6) -> list[Column]:
    """The nine metrics as aggregates over rows with ``g``, ``p``; NaN when nothing is valid."""
    g, p = F.col("g"), F.col("p")
    gs, ps = F.greatest(g, F.lit(eps)), F.greatest(p, F.lit(eps))
    diff = p - g
    dlog = F.log(ps) - F.log(gs)
    ratio = F.greatest(ps / gs, gs / ps)

    def mean(e: Column) -> Column:
        return F.coalesce(F.avg(F.when(valid, e)), F.lit(float("nan")))

    def share(k: int) -> Column:
        return mean((ratio < 1.25 ** k).cast("double"))

    return [
        mean(F.abs(diff) / gs).alias("absrel"),
        mean(diff * diff / gs).alias("sqrel"),
        F.sqrt(mean(diff * diff)).alias("rmse"),
        mean(F.abs(diff)).alias("mae"),
        F.sqrt(mean(dlog * dlog)).alias("rmse_log"),
        (F.sqrt(F.greatest(mean(dlog * dlog) - mean(dlog) * mean(dlog), F.lit(0.0))) * 100.0).alias("silog"),
        share(1).alias("delta1"), share(2).alias("delta2"), share(3).alias("delta3"),
    ]


def per_frame(px: DataFrame, cfg: MetricConfig = MetricConfig(), by: Sequence[str] = ("frame",),
              mask: str | None = None) -> DataFrame:
    """One metric row per frame: a single shuffle with map-side partial sums."""
    s = scored(px, cfg, mask)
    n = F.count_if(F.col("valid"))
    return s.groupBy(*by).agg(*error_aggs(F.col("valid"), cfg.eps), n.alias("n_valid"),
                              (n / F.count(F.lit(1))).alias("valid_ratio"))


def image_pool(rows: DataFrame, cfg: MetricConfig = MetricConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-frame rows; frames with too few valid pixels are counted, not scored."""
    keep = F.col("n_valid") >= max(cfg.min_valid_pixels, 1)
    aggs = [F.coalesce(F.avg(F.when(keep, F.col(m))), F.lit(float("nan"))).alias(m) for m in METRICS]
    aggs += [F.count_if(keep).alias("n_samples"), F.count_if(~keep).alias("n_skipped")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def pixel_pool(px: DataFrame, cfg: MetricConfig = MetricConfig(), by: Sequence[str] = ("frame",),
               mask: str | None = None, regions: Sequence[str] = ()) -> DataFrame:
    """All valid pixels at once, as mergeable sums per frame so that skipped frames drop out."""
    s = scored(px, cfg, mask)
    v = F.col("valid")
    g, p = F.greatest(F.col("g"), F.lit(cfg.eps)), F.greatest(F.col("p"), F.lit(cfg.eps))
    d, dl = F.col("p") - F.col("g"), F.log(p) - F.log(g)
    ratio = F.greatest(p / g, g / p)
    sums = {"absrel": F.abs(d) / g, "sqrel": d * d / g, "se": d * d, "mae": F.abs(d), "sle": dl * dl, "dl": dl,
            "delta1": (ratio < 1.25).cast("double"), "delta2": (ratio < 1.25 ** 2).cast("double"),
            "delta3": (ratio < 1.25 ** 3).cast("double")}
    frame = s.groupBy(*by, *regions).agg(
        F.count_if(v).alias("n"), *[F.sum(F.when(v, e)).alias(k) for k, e in sums.items()])
    frame = frame.where(F.col("n") >= max(cfg.min_valid_pixels, 1))
    tot = frame.groupBy(*regions) if regions else frame
    t = tot.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_samples"), *[F.sum(k).alias(k) for k in sums])
    n = F.col("n")

    def mean(k: str) -> Column:
        return F.coalesce(F.col(k) / n, F.lit(float("nan")))

    return t.select(
        *regions, F.coalesce(n, F.lit(0)).alias("n_valid"), "n_samples",
        mean("absrel").alias("absrel"), mean("sqrel").alias("sqrel"), F.sqrt(mean("se")).alias("rmse"),
        mean("mae").alias("mae"), F.sqrt(mean("sle")).alias("rmse_log"),
        (F.sqrt(F.greatest(mean("sle") - mean("dl") * mean("dl"), F.lit(0.0))) * 100.0).alias("silog"),
        mean("delta1").alias("delta1"), mean("delta2").alias("delta2"), mean("delta3").alias("delta3"))


def zone_rows(px: DataFrame, zones: dict[str, Column], cfg: MetricConfig = MetricConfig(),
              by: Sequence[str] = ("frame",)) -> DataFrame:
    """Per frame and zone; a pixel may be in several zones, and NaN rows mark empty zones."""
    s = scored(px, cfg)
    names = F.array(*[F.struct(F.lit(z).alias("zone"), c.alias("inside")) for z, c in zones.items()])
    e = s.select(*by, "g", "p", "valid", F.explode(names).alias("_z"))
    ok = F.col("valid") & F.col("_z.inside")
    return e.groupBy(*by, F.col("_z.zone").alias("zone")).agg(
        *error_aggs(ok, cfg.eps), F.count_if(ok).alias("n_valid"))


def worst(rows: DataFrame, metric: str, n: int, key: str = "frame") -> DataFrame:
    """The n worst frames; NaN rows never count as worst."""
    m = F.col(metric)
    order = m.asc() if metric in HIGHER_IS_BETTER else m.desc()
    return rows.where(m.isNotNull() & ~F.isnan(m)).orderBy(order, F.col(key)).limit(n)


def latency_summary(df: DataFrame, by: Sequence[str], ms: str, batch_size: int = 1) -> DataFrame:
    """Median, mean, nearest-rank p95, population deviation and frames per second per group."""
    from gridspark.operators.ordering import quantiles, ranked

    by = list(by)
    base = df.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"),
                               F.count(F.lit(1)).alias("n"))
    med = quantiles(df, by, ms, [0.5], ["median_ms"])
    r = ranked(df.select(*by, ms), by, [ms], "_r", count="_n")
    p95 = (r.where(F.col("_r") - 1 == F.rint(0.95 * (F.col("_n") - 1)))
           .groupBy(*by).agg(F.min(ms).alias("p95_ms")))
    return (base.join(med, by).join(p95, by)
            .withColumn("fps", 1000.0 * batch_size / F.col("median_ms")))
