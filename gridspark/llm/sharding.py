"""Sharding by histogram sort: find exact splitters first, then move every row once.

The sort key is (doc_id, place in the input), unique for every row, so that even a doc_id
with a third of all bytes can be split. Each round counts the exact rows and bytes below
candidate boundaries in every partition, adds the partial counts up, and narrows each
splitter's bracket; rounds run over a stored narrow table. Shards are cut into bins, and a
bin's offset follows from the counts, so that slots need no window over a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut


@dataclass(frozen=True)
class Settings:
    shards: int = 40
    bins_per_shard: int = 8
    tolerance: float = 0.002  # of a bin's ideal bytes
    probes: int = 16  # candidate boundaries a splitter and round
    most_rounds: int = 40


NULL_ID = -(1 << 63)


def _below(ids: np.ndarray, seqs: np.ndarray):
    """Partial counts of rows and bytes between neighbouring candidates (sorted pairs of id and place)."""
    keys = np.rec.fromarrays([ids, seqs]) if len(ids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
        for batch in batches:
            at = _place(keys, batch.column(0).to_numpy(), batch.column(1).to_numpy(), ids, seqs)
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(total, at, batch.column(2).to_numpy())
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(total[some])], ["cell", "n", "bytes"])

    return run


def _place(keys, k: np.ndarray, seq: np.ndarray, ids: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    """How many of the sorted candidates are at or below each row."""
    if keys is None:
        return np.zeros(len(k), np.int64)
    lo, hi = np.searchsorted(ids, k, side="left"), np.searchsorted(ids, k, side="right")
    out = hi.copy()
    tie = np.flatnonzero(lo < hi)
    # Among candidates of the row's own id the place decides.
    for v in np.unique(lo[tie]):
        of = tie[lo[tie] == v]
        out[of] = v + np.searchsorted(seqs[v: hi[of[0]]], seq[of], side="right")
    return out


def _count(slim: DataFrame, points: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes below each of the sorted points; len(points) + 1 numbers reach the driver."""
    ids, seqs = np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)
    got = slim.mapInArrow(_below(ids, seqs), "cell long, n long, bytes long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).toArrow()
    rows, total = np.zeros(len(points) + 1, np.int64), np.zeros(len(points) + 1, np.int64)
    rows[got["cell"].to_numpy()], total[got["cell"].to_numpy()] = got["n"].to_numpy(), got["bytes"].to_numpy()
    return np.cumsum(rows)[:-1], np.cumsum(total)[:-1]


def splitters(slim: DataFrame, s: Settings) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Boundaries of the bins with the exact rows and bytes below each.

    ``slim``: id, seq, size. A row belongs to the bin after a boundary at or below its key. A
    boundary is settled within the tolerance, or when no key is left in its bracket.
    """
    b = s.shards * s.bins_per_shard
    span = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.min("id"), F.max("id"), F.max("seq")).first()
    n, total = int(span[0]), int(span[1])
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(span[4]) + 1
    lowest = int(span[2])
    goal = [total * i / b for i in range(1, b)]
    slack = s.tolerance * total / b
    point = lambda x: (lowest + x // width, x % width)  # noqa: E731  a key as one number: (id, place)
    lo, hi = [0] * (b - 1), [(int(span[3]) - lowest + 1) * width] * (b - 1)
    lo_at, hi_at = [(0, 0)] * (b - 1), [(n, total)] * (b - 1)
    best: list[tuple[float, int, int, int]] = [(g, 0, 0, 0) for g in goal]
    for i, g in enumerate(goal):
        best[i] = min(best[i], (total - g, hi[i], n, total))
    for _ in range(s.most_rounds):
        asked: set[int] = set()
        for i in range(b - 1):
            if best[i][0] > slack and hi[i] - lo[i] > 1:
                step = (hi[i] - lo[i]) / (s.probes + 1)
                # Bytes are close to even within a bracket, so one probe aims where the goal should lie.
                share = (goal[i] - lo_at[i][1]) / max(hi_at[i][1] - lo_at[i][1], 1)
                asked.update({lo[i] + int(step * j) for j in range(1, s.probes + 1)} | {lo[i] + int(share * (hi[i] - lo[i]))})
        if not asked:
            break
        probes = sorted(asked)
        rows, size = _count(slim, [point(x) for x in probes])
        for i, g in enumerate(goal):
            j = int(np.searchsorted(size, g, side="right"))  # probes before j have at most g bytes below
            for k in (j - 1, j):
                if 0 <= k < len(probes):
                    best[i] = min(best[i], (abs(float(size[k]) - g), probes[k], int(rows[k]), int(size[k])))
            if j and probes[j - 1] > lo[i]:
                lo[i], lo_at[i] = probes[j - 1], (int(rows[j - 1]), int(size[j - 1]))
            if j < len(probes) and probes[j] < hi[i]:
                hi[i], hi_at[i] = probes[j], (int(rows[j]), int(size[j]))
    cuts = sorted((x, r, z) for _, x, r, z in best)
    return [point(x) for x, _, _ in cuts], np.array([r for _, r, _ in cuts]), np.array([z for _, _, z in cuts])


def shard(df: DataFrame, size: str, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Rows of ``df`` with shard_ (0 .. shards - 1) and slot_ (gapless from 0 in each shard, in key order).

    Null keys come first, a null or negative size counts as 0. Equal keys, repeated rows too, keep
    the order of the input. An empty table gives an empty one; with fewer rows than shards
    some shards are empty. Columns shard_ and slot_ are replaced.
    """
    s = settings
    names = [c for c in df.columns if c not in ("shard_", "slot_")]
    kept = cut(df.select(*names, F.struct(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.monotonically_increasing_id().alias("seq"),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("size")).alias("_key")))
    slim = kept.select("_key.id", "_key.seq", "_key.size")
    points, rows, _ = splitters(slim, s)
    ids, seqs = np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)

    @F.arrow_udf("int")
    def bin_of(k: pa.Array, seq: pa.Array) -> pa.Array:
        return pa.array(_place(ids if len(ids) else None, k.to_numpy(zero_copy_only=False), seq.to_numpy(zero_copy_only=False), ids, seqs).astype(np.int32))

    m = s.bins_per_shard
    before = np.concatenate([[0], rows])  # rows below each bin
    start = [int(before[k] - before[k - k % m]) if k < len(before) else 0 for k in range(s.shards * m)]
    placed = kept.withColumn("_bin", bin_of("_key.id", "_key.seq"))
    from pyspark.sql import Window

    order = Window.partitionBy("_bin").orderBy("_key.id", "_key.seq")
    offset = F.array(*[F.lit(x).cast("long") for x in start])
    return placed.withColumn("slot_", F.row_number().over(order) - 1 + F.element_at(offset, F.col("_bin") + 1)).select(
        *names, F.floor(F.col("_bin") / m).cast("int").alias("shard_"), F.col("slot_").cast("long"))
