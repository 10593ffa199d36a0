"""Sinks: result rows, run documents, split lists, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.ordering import ranked

# The columns of the results log, in order.
SUMMARY_COLUMNS = (
    "timestamp", "experiment", "dataset", "split", "method", "checkpoint", "degradation", "seed", "device",
    "n_samples", "n_skipped", "n_unreadable",
    "absrel", "sqrel", "rmse", "mae", "rmse_log", "silog", "delta1", "delta2", "delta3",
    "fps", "latency_ms_median", "holes_frac", "holes_absrel", "holes_rmse", "holes_delta1",
    "valid_absrel", "valid_rmse", "valid_delta1", "git_commit", "metric_config", "config_hash", "notes",
)


def fixed_columns(rows: DataFrame, columns: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Rows under the fixed column list as text; what a row does not have is blank."""
    have = set(rows.columns)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
                         for c in columns])


def append_summary(rows: DataFrame, path: str, columns: Sequence[str] = SUMMARY_COLUMNS) -> None:
    fixed_columns(rows, columns).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def write_per_sample(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_by_dataset(report: DataFrame, path: str) -> None:
    """One directory per dataset instead of one sheet per dataset."""
    report.write.mode("overwrite").partitionBy("dataset").parquet(path)


def run_document(config: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """One JSON document per run from its configuration and summary row."""
    j = config.join(summary, key, "left")
    doc = F.to_json(F.struct(F.col("leaves").alias("config"), F.struct(*[c for c in summary.columns if c != key]).alias("summary")))
    return j.select(key, doc.alias("doc"))


def split_list(rows: DataFrame, order: str, ident: str, part_size: int = 100_000) -> DataFrame:
    """``{dataset, split, ids}`` documents with ids in list order, in numbered parts of bounded length."""
    r = ranked(rows.select("dataset", "split", order, ident), ["dataset", "split"], [order, ident], "_k")
    part = F.floor((F.col("_k") - 1) / part_size).alias("part")
    g = r.groupBy("dataset", "split", part).agg(F.sort_array(F.collect_list(F.struct("_k", ident))).alias("_i"))
    return g.select("dataset", "split", "part", F.to_json(F.struct("dataset", "split", F.col("_i")[ident].alias("ids"))).alias("doc"))


def manifest(subset: DataFrame, seed: int, part_size: int = 1_000) -> DataFrame:
    """Seed, count and sorted ids of a subset per split, in numbered parts of at most ``part_size`` ids."""
    r = ranked(subset.select("split", "sample_id"), ["split"], ["sample_id"], "_k")
    return r.groupBy("split", F.floor((F.col("_k") - 1) / part_size).alias("part")).agg(
        F.count(F.lit(1)).alias("n_ids"), F.lit(seed).alias("seed"),
        F.array_join(F.sort_array(F.collect_list("sample_id")), ",").alias("ids"))
