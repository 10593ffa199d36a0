"""Continuous forms of the append-only log and of stream pairing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.session import checkpoint_root


def _place(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/gridspark-{what}-{uuid.uuid4().hex}"


def _holds_files(spark: SparkSession, path: str) -> bool:
    """False for an output that no batch has written to yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest_per_hash(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Streaming latest row per key: one aggregate whose state is a row per key."""
    rest = [c for c in stream.columns if c != key]
    g = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r"))
    return g.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def run_to_table(stream: DataFrame, key: str | None = None, place: str | None = None, report: dict | None = None) -> DataFrame:
    """Drain what is available into a stored table and read it back.

    ``place`` names a folder for output and progress: a later call with the same one resumes where this
    one ended and reads all that was ever stored. Without it the run starts anew in a folder of its own.
    Without ``key`` rows are appended. With it the stream runs in update mode:
    each micro-batch stores only the keys it changed, under its own number (a
    replayed batch overwrites itself), and reading takes a key's newest batch.
    ``report`` receives ``late``, the rows dropped behind the watermark, and ``state``, the rows of state left.
    """
    spark = stream.sparkSession
    base = place.rstrip("/") if place else _place(spark, "stream")
    out, state = f"{base}/rows", f"{base}/progress"
    w = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if key is None:
        w.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out) if _holds_files(spark, out) else spark.createDataFrame([], stream.schema)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = w.outputMode("update").foreachBatch(keep).start()
    query.awaitTermination()
    if report is not None:
        steps = [p.stateOperators for p in query.recentProgress if p.stateOperators]
        report["late"] = sum(o.numRowsDroppedByWatermark for s in steps for o in s)
        report["state"] = sum(o.numRowsTotal for o in steps[-1]) if steps else 0
    number = T.StructField("batch", T.LongType())
    rows = spark.read.schema(T.StructType([*stream.schema.fields, number])).parquet(out) if _holds_files(spark, out) else spark.createDataFrame([], T.StructType([*stream.schema.fields, number]))
    rest = [c for c in stream.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def pair_streams(left: DataFrame, right: DataFrame, ts: str, left_id: str, right_id: str, tolerance_s: int, lateness_s: int = 86_400) -> DataFrame:
    """All pairs of messages no further apart than the tolerance.

    Watermarks bound the state: a message may come up to ``lateness_s`` behind the newest one of its
    side, whatever the tolerance; Spark drops later ones and counts them in the query's progress
    (``numRowsDroppedByWatermark``).

    Time is cut into buckets of the tolerance's length: the right side has one
    bucket and the left side looks into three, so the join has an equality key
    and every pair comes out once.
    """
    tol = f"{int(tolerance_s)} seconds"
    late = f"{int(lateness_s)} seconds"
    us = int(tolerance_s) * 1_000_000
    b = F.floor(F.unix_micros("_lt") / us)
    a = left.withColumnRenamed(ts, "_lt").withWatermark("_lt", late).withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    r = right.withColumnRenamed(ts, "_rt").withWatermark("_rt", late).withColumn("_rb", F.floor(F.unix_micros("_rt") / us))
    near = (F.col("_b") == F.col("_rb")) & (F.col("_rt") >= F.col("_lt") - F.expr(f"INTERVAL {tol}")) & (F.col("_rt") <= F.col("_lt") + F.expr(f"INTERVAL {tol}"))
    gap = F.abs(F.unix_micros("_lt") - F.unix_micros("_rt"))
    return a.join(r, near).select(left_id, right_id, gap.alias("gap_us"))


def nearest_of_pairs(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The closest partner of each left message; the earlier id wins a tie."""
    return pairs.groupBy(left_id).agg(F.min_by(right_id, F.struct("gap_us", right_id)).alias(right_id), F.min("gap_us").alias("gap_us"))
