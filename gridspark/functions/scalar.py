"""Scalar column functions: names, ids, hashes, sensor formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of a run configuration that decide its numbers.
HASHED_KEYS = ("dataset", "degradation", "model", "eval", "seed")
HASHED_IF_SET = ("normals", "force_normals")
IGNORED_KEYS = ("docs", "notes")
# Coefficients of the rational erf approximation (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def path_part(path: Column, index: int) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(index))


def file_safe(name: Column, limit: int = 120) -> Column:
    """A name for files; one that is too long ends in a hash of the whole, so that no two meet."""
    safe = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "-")
    return F.when(F.length(safe) > limit, F.concat(F.left(safe, F.lit(limit - 9)), F.lit("-"), F.left(F.md5(safe), F.lit(8)))).otherwise(safe)


def natural_key(c: Column) -> Column:
    """Orderable: text and number parts in turn; numbers of any length compare by value."""
    text, digits = (F.regexp_extract_all(c, F.lit(r"(\D*)(\d*)"), F.lit(k)) for k in (1, 2))
    bare = F.transform(digits, lambda d: F.regexp_replace(d, r"^0+(?=\d)", ""))
    return F.transform(F.arrays_zip(text.alias("t"), bare.alias("d")), lambda p: F.struct(p["t"].alias("t"), F.length(p["d"]).alias("n"), p["d"].alias("d")))


def metric_line(metrics: dict[str, Column]) -> Column:
    return F.concat_ws("  ", *[F.format_string(f"{k}=%.4f", v) for k, v in metrics.items()])


def ci_cell(est: Column, lo: Column, hi: Column) -> Column:
    sig = F.when((lo > 0) | (hi < 0), " sig").otherwise("")
    return F.format_string("%+.1f%% [%+.1f, %+.1f]%s", est, lo, hi, sig)


def sensor_name(experiment: Column) -> Column:
    s = F.regexp_extract(experiment, r"_(l515|tof)(?:_|$)", 1)
    return F.when(s == "l515", "L515").when(s == "tof", "ToF").otherwise("D435")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def stamp_day(stamp: Column) -> Column:
    return F.to_date(F.to_timestamp(stamp, "yyyyMMdd-HHmmss"))


def config_hash(leaves: Column) -> Column:
    """12 hex digits of SHA-1 over the sorted leaves that decide a run's numbers.

    ``leaves`` maps dotted paths to text values; NULL values are dropped.
    """
    def kept(k: Column, v: Column) -> Column:
        parts = F.split(k, r"\.")
        top = F.element_at(parts, 1)
        ok = top.isin(*HASHED_KEYS) | top.isin(*HASHED_IF_SET)
        for bad in IGNORED_KEYS:
            ok = ok & ~F.array_contains(parts, bad)
        empty_optional = top.isin(*HASHED_IF_SET) & v.isin("", "false")
        return ok & v.isNotNull() & ~empty_optional

    entries = F.array_sort(F.map_entries(F.map_filter(leaves, kept)))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.sha1(F.array_join(lines, "\n")), 1, 12)


def merge_leaves(base: Column, over: Column) -> Column:
    """Deep merge on leaf paths: the override wins, and replaces whole subtrees it names."""
    hit = F.map_keys(over)

    def survives(k: Column, _v: Column) -> Column:
        return ~F.exists(hit, lambda o: (k == o) | k.startswith(F.concat(o, F.lit("."))) | o.startswith(F.concat(k, F.lit("."))))

    return F.map_concat(F.map_filter(base, survives), over)


def override_pair(text: Column) -> Column:
    """``a.b=value`` to a (path, value) struct."""
    parts = F.split(text, "=", 2)
    return F.struct(parts[0].alias("path"), parts[1].alias("value"))


def disparity(z: Column, fb: float) -> Column:
    return F.when(z > 0, F.lit(fb) / F.greatest(z, F.lit(1e-6))).otherwise(0.0)


def quantise_disparity(d: Column, subpixel_bits: int) -> Column:
    n = float(2 ** subpixel_bits)
    return F.rint(d * n) / n


def depth_from_disparity(d: Column, fb: float) -> Column:
    return F.when(d > 1e-9, F.lit(fb) / F.when(d > 1e-9, d).otherwise(1.0)).otherwise(0.0)


def axial_sigma(z: Column, theta: Column, sigma0=0.0012, alpha=0.0019, z0=0.4, beta=1e-4,
                theta0=60.0, theta_max=89.0, sigma_max=0.1) -> Column:
    zs = F.when(z > 0, z).otherwise(1.0)
    phi = F.least(F.greatest(theta, F.lit(0.0)), F.lit(math.radians(theta_max)))
    grazing = F.lit(beta) / F.sqrt(zs) * phi * phi / ((math.pi / 2 - phi) * (math.pi / 2 - phi))
    s = sigma0 + alpha * (zs - z0) * (zs - z0) + F.when(phi > math.radians(theta0), grazing).otherwise(0.0)
    return F.least(s, F.lit(sigma_max))


def lateral_sigma(theta: Column, sigma0=0.8, gamma=0.035, theta_max=89.0, sigma_max=10.0) -> Column:
    phi = F.least(F.greatest(theta, F.lit(0.0)), F.lit(math.radians(theta_max)))
    return F.least(sigma0 + gamma * phi / (math.pi / 2 - phi), F.lit(sigma_max))


def theta_dropout_p(theta: Column, theta0=60.0, p_min=0.0, eta=0.04, p_max=1.0) -> Column:
    over = F.greatest(F.degrees(theta) - theta0, F.lit(0.0))
    return F.least(F.greatest(p_min + eta * over, F.lit(0.0)), F.lit(p_max))


def depth_dropout_p(z: Column, base=0.02, z_min=0.6, z_ref=1.5, p_max=0.85) -> Column:
    r = F.greatest(z, F.lit(z_min)) / z_ref
    return F.least(F.greatest(base * r * r, F.lit(0.0)), F.lit(p_max))


def far_dropout_p(gt: Column, far_p: float) -> Column:
    return far_p * F.least(F.greatest((gt - 2.5) / 3.5, F.lit(0.0)), F.lit(1.0))


def range_sigma(z: Column, base=0.010, per_m=0.012) -> Column:
    return base + per_m * z


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def normal_quantile(p: float) -> float:
    """Plain number: the gate level for a wanted coverage."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def with_protocol(runs: DataFrame, inputs: DataFrame, experiment: str = "key") -> DataFrame:
    """Adds ``rank`` and ``label`` of the input a method was given, from the caller's dimension table.

    ``inputs``: priority, dataset, degradation, suffix, rank, label; a null matches anything, the suffix is a
    pattern for the experiment's name whose first group replaces ``{}`` in the label and gives a null
    rank. The row of least priority that matches is taken; a run that none matches has nulls.
    """
    name = F.col(experiment)
    fits = lambda c: F.col(f"_i.{c}").isNull() | (F.col(f"_i.{c}") == F.col(c))
    part = F.expr(f"regexp_extract(`{experiment}`, concat(coalesce(_i.suffix, ''), '()'), 1)")
    found = F.col("_i.suffix").isNull() | F.rlike(name, F.col("_i.suffix"))
    dim = F.broadcast(inputs.select(F.struct(*inputs.columns).alias("_i")))  # a few rows that the caller wrote down
    best = runs.select("*", F.monotonically_increasing_id().alias("_row")).join(dim, fits("dataset") & fits("degradation") & found, "left")
    best = best.select("*", F.when(F.col("_i").isNotNull(), F.struct(F.coalesce("_i.rank", part.try_cast("int")).alias("rank"), F.replace(F.col("_i.label"), F.lit("{}"), part).alias("label"))).alias("_p"))
    rest = [c for c in runs.columns if c != experiment]
    g = best.groupBy("_row", experiment).agg(F.min_by(F.struct(*rest, "_p"), "_i.priority").alias("_r"))
    return g.select(experiment, *[F.col("_r")[c].alias(c) for c in rest], F.col("_r._p.rank").alias("rank"), F.col("_r._p.label").alias("label"))
