"""The two physical layouts: one row per frame (arrays) and one row per pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut

FEW = 500_000  # up to so many rows a table of frames is sent to all tasks


def spread(px: DataFrame) -> DataFrame:
    """Marks pixel rows as a side of a join that is sorted and merged, never sent to every task.

    Spark estimates an exploded table by the file it came from, many times too small, and would
    build the whole of it in the driver.
    """
    return px.hint("merge")


def of_frames(rows: DataFrame) -> DataFrame:
    """A table with a row per frame, stored, and sent to all tasks while it has at most ``FEW`` rows.

    Pixels then stay where they are. By Spark's estimate they would be shuffled by frame to meet it,
    and all later steps of a frame, each with a sort of its own, would pile up in one task.
    """
    t = cut(rows)
    return F.broadcast(t) if t.count() <= FEW else t


def frames_to_pixels(frames: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ("frame",),
                     column_major: bool = False) -> DataFrame:
    """Explode row-major arrays of length ``h*w``; ``column_major`` reads transposed packs."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    out = frames.select(*keep, "h", "w", F.posexplode(zipped).alias("_p", "_v"))
    if column_major:
        y, x = F.col("_p") % F.col("h"), F.floor(F.col("_p") / F.col("h"))
    else:
        y, x = F.floor(F.col("_p") / F.col("w")), F.col("_p") % F.col("w")
    return out.select(*keep, y.cast("int").alias("y"), x.cast("int").alias("x"), "h", "w",
                      *[F.col(f"_v.{a}").alias(a) for a in arrays])


def pixels_to_frames(px: DataFrame, arrays: Sequence[str], by: Sequence[str] = ("frame",)) -> DataFrame:
    """Pack pixels back to row-major arrays; a frame is bounded by its sensor."""
    row = F.struct("y", "x", *arrays)
    g = px.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"),
                            F.sort_array(F.collect_list(row)).alias("_r"))
    return g.select(*by, "h", "w", *[F.col("_r")[a].alias(a) for a in arrays])


def with_size(px: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Add the grid size ``h``, ``w`` of each frame."""
    if "h" in px.columns and "w" in px.columns:
        return px
    size = px.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return px.join(of_frames(size), list(by), "inner")
