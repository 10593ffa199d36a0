"""Borders, polylines and regions against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import contour as C
from gridspark.operators import segment as S


def textbook_borders(mask):
    """Border following with marks on a padded picture, pixel by pixel."""
    h, w = mask.shape
    f = np.zeros((h + 2, w + 2), int)
    f[1:-1, 1:-1] = mask
    ring = list(C.AROUND)
    out, number = [], 1
    for y in range(1, h + 1):
        for x in range(1, w + 1):
            if f[y, x] == 0:
                continue
            if f[y, x] == 1 and f[y, x - 1] == 0:
                start = (0, -1)
            elif f[y, x] >= 1 and f[y, x + 1] == 0:
                start = (0, 1)
            else:
                continue
            number += 1
            d = ring.index(start)
            around = [(d - k) % 8 for k in range(8) if f[y + ring[(d - k) % 8][0], x + ring[(d - k) % 8][1]]]
            if not around:
                f[y, x] = -number
                out.append([(x - 1, y - 1)])
                continue
            first = (y + ring[around[0]][0], x + ring[around[0]][1])
            before, here, chain = first, (y, x), []
            while True:
                k0 = ring.index((before[0] - here[0], before[1] - here[1]))
                right_seen = False
                for k in range(1, 9):
                    d = ring[(k0 + k) % 8]
                    if f[here[0] + d[0], here[1] + d[1]]:
                        nxt = (here[0] + d[0], here[1] + d[1])
                        break
                    right_seen |= d == (0, 1)
                chain.append((here[1] - 1, here[0] - 1))
                if right_seen:
                    f[here] = -number
                elif f[here] == 1:
                    f[here] = number
                if nxt == (y, x) and here == first:
                    break
                before, here = here, nxt
            out.append(chain)
    return out


def plain_polyline(p, eps, closed):
    p = [*p, p[0]] if closed else list(p)

    def split(a, b):
        if b - a < 2:
            return []
        (ax, ay), (bx, by) = p[a], p[b]
        n = (bx - ax) ** 2 + (by - ay) ** 2
        far = [((p[i][0] - ax) * (by - ay) - (p[i][1] - ay) * (bx - ax)) ** 2 / n if n else (p[i][0] - ax) ** 2 + (p[i][1] - ay) ** 2 for i in range(a + 1, b)]
        at = a + 1 + far.index(max(far))
        return [*split(a, at), at, *split(at, b)] if max(far) > eps * eps else []

    return [0, *split(0, len(p) - 1), len(p) - 1]


def shapes():
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:64, :64]
    r = np.hypot(y - 31, x - 30)
    yield (r < 25) & (r > 12)
    yield (abs(y - x) < 3) | (abs(y - 40) < 2)
    for share in (0.1, 0.4, 0.6, 0.9):
        yield rng.random((64, 64)) < share
    yield np.ones((64, 64), bool)
    one = np.zeros((64, 64), bool)
    one[[5, 5, 5, 9, 20], [7, 8, 9, 63, 0]] = True
    yield one


def test_borders_equal_textbook_following():
    for mask in shapes():
        assert sorted(map(tuple, (map(tuple, c.tolist()) for c in C.trace(mask)))) == sorted(tuple(c) for c in textbook_borders(mask))


@pytest.mark.parametrize("closed", [False, True])
def test_polylines_equal_recursion(closed):
    for mask in shapes():
        for c in C.trace(mask):
            for eps in (0.5, 2.0):
                assert C.polyline(c, eps, closed).tolist() == sorted(set(plain_polyline([tuple(q) for q in c.tolist()], eps, closed)))


def test_segments_of_frames(spark):
    frames = list(shapes())
    rows = [(k, int(y) + 100, int(x), "z") for k, m in enumerate(frames) for y, x in zip(*np.nonzero(m))]
    rows += rows[:50]  # repeated pixels
    df = spark.createDataFrame(rows, "frame long, y int, x int, contour string")
    got = {tuple(r) for r in C.contour_segments(df, F.lit(True), eps=2.0, min_len=4.0).collect()}
    want = set()
    for k, m in enumerate(frames):
        for n, c in enumerate(C.trace(m)):
            corners = [tuple(c[i].tolist()) for i in plain_polyline([tuple(q) for q in c.tolist()], 2.0, False)]
            for i, (a, b) in enumerate(zip(corners, corners[1:])):
                if np.hypot(b[0] - a[0], b[1] - a[1]) >= 4.0:
                    want.add((k, n, i, a[0], a[1] + 100, b[0], b[1] + 100))
    assert got == want and len(want) > 50
    assert C.contour_segments(df.where("false"), F.lit(True)).count() == 0


def flood(mask, connect):
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connect == 8 else [])
    label = {}
    for y, x in zip(*(a.tolist() for a in np.nonzero(mask))):
        if (y, x) in label:
            continue
        label[y, x], todo = y * S.ROW + x, [(y, x)]
        while todo:
            a, b = todo.pop()
            for dy, dx in near:
                q = (a + dy, b + dx)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in label:
                    label[q] = y * S.ROW + x
                    todo.append(q)
    return label


@pytest.mark.parametrize("connect,tile", [(4, 256), (8, 256), (4, 16), (8, 10)])
def test_regions_equal_flood_fill(spark, connect, tile):
    rows, want = [], {}
    for k, m in enumerate(shapes()):
        rows += [(k, int(y), int(x), 0.5) for y, x in zip(*np.nonzero(m))]
        want |= {(k, y, x): v for (y, x), v in flood(m, connect).items()}
    df = spark.createDataFrame(rows, "frame long, y int, x int, node double")
    got = S.label_regions(df.withColumnRenamed("node", "extra"), F.lit(True), connect=connect, tile=tile)
    assert {(r.frame, r.y, r.x): r.label for r in got.collect()} == want
    assert got.columns == ["frame", "y", "x", "extra", "label"]


def test_spiral_across_many_tiles(spark):
    """One line, wound up over a frame 2,000 wide, is one region."""
    y, x, pts, step, turn = 0, 0, [], 1999, 0
    moves = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    pts.append((0, 0))
    while step > 1900:
        for _ in range(2):
            dy, dx = moves[turn % 4]
            for _ in range(step):
                y, x = y + dy, x + dx
                pts.append((y, x))
            turn += 1
        step -= 8
    df = spark.createDataFrame([(1, a, b) for a, b in dict.fromkeys(pts)], "frame long, y int, x int")
    got = S.label_regions(df, F.lit(True), tile=128)
    assert got.select("label").distinct().count() == 1 and got.count() == len(set(pts))
