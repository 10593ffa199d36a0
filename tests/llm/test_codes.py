import math

import numpy as np
import pytest

from gridspark.llm.codes import MOST, Settings, components, compress, dimension, keys, walk

SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int"


def brute(rows, s):
    """Rows (vec_id, vector, label), all vectors of the most common length."""
    kept = [(i, [math.floor(s.scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    kept = [(i, v + [0] * (-dim % s.parts), lab) for i, v, lab in kept if len(v) == dim]
    least = {}
    for i, v, _ in kept:
        if i is not None and (i not in least or v < least[i]):
            least[i] = v
    w = -(-dim // s.parts)
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(s.parts)]
    books = [[cut(least[i])[p] for i in sorted(least)[: s.entries]] for p in range(s.parts)]
    if not books[0]:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(b)), key=lambda e: (far(q, b[e]), e)) for q, b in zip(cut(v), books, strict=True)] for _, v, _ in kept]

    for _ in range(s.rounds):
        a = assign()
        for p in range(s.parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, a, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, a = [], assign()
    for (i, v, lab), c in zip(kept, a, strict=True):
        out.append((i, lab, "".join(f"{e:02x}" for e in c), sum(far(q, books[p][c[p]]) for p, q in enumerate(cut(v)))))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((*r, sum(o[3] for o in out if o[1] == r[1]), text) for r in out), key=str)


def got(spark, rows, s=Settings(), parts=4):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in compress(df, s).collect()), key=str)


@pytest.mark.parametrize("s", [Settings(entries=8), Settings(entries=5, parts=2, rounds=2, slice=3), Settings(entries=3, parts=3, scale=7)])
def test_equals_brute_force(spark, s):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 12) / 64 + rng.normal(0, 0.001, 12)).tolist(), int(i % 3)) for i in range(150)]
    assert got(spark, rows, s) == brute(rows, s)


def test_bad_vectors_ties_repeated_rows_and_null_labels(spark):
    s = Settings(entries=4)
    v = [0.5, -0.25, 0.0, 1.0, -1.0, 0.125, 3.0, -0.0009]
    rows = [(3, v, None), (3, v, None), (1, v, 7), (2, v[::-1], 7), (2, v, 7), (None, [x / 3 for x in v], None), (9, [0.0] * 8, 7),
            (10, None, 7), (11, [*v[:7], None], 7), (12, [*v[:7], math.nan], 7), (13, [*v[:7], math.inf], 7), (14, [1.0], 7), (15, [], None)]
    assert got(spark, rows, s) == brute(rows, s)
    # No vector has eight numbers that four parts divide unevenly; ten are filled up to twelve.
    ten = [(i, [x * i for x in [*v, 2.0, 5.0]], 1) for i in range(6)]
    assert got(spark, ten, s) == brute(ten, s)


def test_empty_tables_and_tables_without_ids(spark):
    assert got(spark, []) == [] == got(spark, [(1, None, 1)]) == got(spark, [(None, [1.0] * 4, 1)])
    assert got(spark, [(1, [], 1)]) == [(1, 1, "00000000", 0, 0, "")]


def test_huge_components_are_held(spark):
    rows = [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [-1e30, 0.0, 0.0, 0.0], 1)]
    assert [r[:4] for r in got(spark, rows)] == [(1, 1, "00000000", 0), (2, 1, "01000000", 0)]
    assert str(MOST) in got(spark, rows)[0][-1]


def test_dimension_is_the_most_common_one(spark):
    df = spark.createDataFrame([(i, [1.0] * n, 1, "", 0) for i, n in enumerate((4, 4, 6, 6, 2))] + [(9, [1.0, math.nan], 1, "", 0)], SCHEMA)
    assert dimension(df) == 6


def test_keys_order_like_components():
    x = np.random.default_rng(0).integers(-5, 5, (500, 4))
    assert sorted(map(tuple, x.tolist())) == [tuple(r) for r in x[keys(x).argsort(kind="stable")].tolist()]
    assert (components([k.tobytes() for k in keys(x)], 4) == x).all()


@pytest.mark.parametrize("width", [2, 512])
def test_walk_shares_prefixes_and_is_exact(width):
    rng = np.random.default_rng(1)
    rows, book = np.unique(rng.integers(0, 4, (900, 6)), axis=0), rng.integers(0, 4, (9, 6))
    near, far, seen = np.zeros(len(rows), int), np.zeros(len(rows), int), np.zeros(len(rows), int)

    def note(places, entries, distances):
        near[places], far[places] = entries, distances
        seen[places] += 1

    made = walk(rows, book, note, width)
    d = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (seen == 1).all() and (near == d.argmin(1)).all() and (far == d.min(1)).all()
    assert made < 0.6 * rows.size
