"""Contours of masks and their approximation by polylines.

A border is a closed chain of mask pixels, each one a neighbour (of eight) of the last, that keeps
the outside on one side: one chain around every region and one around every hole. Pixels and
directions form states with exactly one successor, so a chain is a cycle of states. It starts at the
side, left or right of a pixel, that comes first in reading order.

Only the runs of a mask leave their row; a frame's runs meet in one task, bounded by the frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (dy, dx) of the eight neighbours, counter-clockwise from the right one.
AROUND = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
LEFT, RIGHT = 4, 0


def _turn(bits: int, d: int, step: int) -> int:
    """The first direction after ``d`` that has a neighbour, or -1."""
    return next((k % 8 for k in range(d + step, d + 9 * step, step) if bits >> k % 8 & 1), -1)


NEXT = [_turn(bits, d, 1) for bits in range(256) for d in range(8)]
BACK = [_turn(bits, d, -1) for bits in range(256) for d in range(8)]


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """Every border of the mask as an (n, 2) array of x, y, in the order of their first sides."""
    h, w = mask.shape
    m = np.zeros((h + 2, w + 2), bool)
    m[1:-1, 1:-1] = mask
    wide = w + 2
    bits = np.zeros(m.shape, np.uint8)
    for k, (dy, dx) in enumerate(AROUND):
        bits[1:-1, 1:-1] |= m[1 + dy:h + 1 + dy, 1 + dx:w + 1 + dx].astype(np.uint8) << k
    inner = m[1:-1, 1:-1]
    sides = np.stack([inner & ~m[1:-1, :-2], inner & ~m[1:-1, 2:]], 2)  # left of a pixel before right of it
    code, moves, done, out = bits.ravel().tolist(), [dy * wide + dx for dy, dx in AROUND], set(), []
    for y, x, side in zip(*(a.tolist() for a in np.nonzero(sides)), strict=True):
        p = (y + 1) * wide + x + 1
        d = BACK[code[p] * 8 + (RIGHT if side else LEFT)]
        if d < 0:  # a single pixel has both sides
            chain = [] if side else [p]
        elif p * 8 + d in done:
            continue
        else:
            chain, start = [], p * 8 + d
            while True:
                done.add(p * 8 + d)
                chain.append(p)
                k = NEXT[code[p] * 8 + d]
                p, d = p + moves[k], (k + 4) % 8
                if p * 8 + d == start:
                    break
        if chain:
            at = np.array(chain)
            out.append(np.stack([at % wide - 1, at // wide - 1], 1))
    return out


def polyline(points: np.ndarray, eps: float = 2.0, closed: bool = False) -> np.ndarray:
    """Positions of the corners: a stretch is split at its farthest point while that is beyond ``eps``.

    Distance is that to the line through the stretch's ends, or to the end where both are one place;
    the first of equally far points is taken. A closed chain returns to its start (position n).
    """
    p = np.concatenate([points, points[:1]]) if closed else points
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, v = p[b] - p[a], p[a + 1:b] - p[a]
        length = int(chord @ chord)
        far = (v[:, 0] * chord[1] - v[:, 1] * chord[0]) ** 2 if length else (v * v).sum(1)
        at = int(far.argmax())
        if far[at] > eps * eps * (length or 1):
            keep.add(a + 1 + at)
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return np.array(sorted(keep))


def _trace_frames(n_keys: int, names: list[str], eps: float, min_len: float, closed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                y, a, b = (np.asarray(batch.column(n_keys + j)[i].values, np.int64) for j in range(3))
                top, left = int(y.min()), int(a.min())
                edge = np.zeros((int(y.max()) - top + 1, int(b.max()) - left + 2), np.int32)
                np.add.at(edge, (y - top, a - left), 1)
                np.add.at(edge, (y - top, b - left + 1), -1)
                for c, chain in enumerate(trace(edge.cumsum(1)[:, :-1] > 0)):
                    ring = np.concatenate([chain, chain[:1]]) if closed else chain
                    corners = ring[polyline(chain, eps, closed)] + (left, top)
                    long_ = np.flatnonzero(np.hypot(*np.diff(corners, axis=0).T) >= min_len)
                    rows += [i] * len(long_)
                    found.append(np.column_stack([np.full(len(long_), c), long_, corners[long_], corners[long_ + 1]]))
            every = np.concatenate(found) if found else np.zeros((0, 6), int)
            keys = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(every[:, j].astype(np.int32)) for j in range(6)]], names)

    return run


def contour_segments(px: DataFrame, mask: Column, by: Sequence[str] = ("frame",), eps: float = 2.0, min_len: float = 4.0, closed: bool = False) -> DataFrame:
    """Pieces of the polylines of all borders: ``by``, contour, piece, x1, y1, x2, y2.

    Contours are numbered per frame in reading order of their first sides, pieces along the contour;
    pieces shorter than ``min_len`` are left out. Pixels that occur twice count once; a frame
    without mask pixels has no row, a single pixel has a contour without pieces.
    """
    by = list(by)
    m = px.where(mask).select(*by, "y", "x")
    row = W.partitionBy(*by, "y").orderBy("x")
    opens = F.coalesce(F.col("x") > F.lag("x").over(row) + 1, F.lit(True)).cast("int")
    runs = m.withColumn("_run", F.sum(opens).over(row)).groupBy(*by, "y", "_run").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    packed = runs.groupBy(*by).agg(F.collect_list(F.struct("y", "a", "b")).alias("r")).select(*by, "r.y", "r.a", "r.b")
    names = [*by, "contour", "piece", "x1", "y1", "x2", "y2"]
    schema = T.StructType([*[px.schema[k] for k in by], *[T.StructField(n, T.IntegerType()) for n in names[len(by):]]])
    return packed.mapInArrow(_trace_frames(len(by), names, eps, min_len, closed), schema)
