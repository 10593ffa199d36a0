import numpy as np
import pytest

from gridspark.llm.ann import Settings, search


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault((i, tuple(v)), np.array(v, float))
    keys = list(ok)
    out = {}
    if not keys:
        return out
    x = np.stack([ok[k] for k in keys])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([k[0] for k in keys])
    for q in np.flatnonzero(ids % every == 0):
        sim = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(sim, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(sim[j])) for j in order]
    return out


def run(spark, rows, settings=Settings()):
    df = spark.createDataFrame([(i, v, b"k") for i, v in rows], "vec_id long, embedding array<double>, key binary")
    out = {}
    for r in search(df, settings=settings).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(len(w) for w in want.values())


def test_small_table_is_exact_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(5, rows[5][1])]
    rows += [(350, None), (400, [0.0] * 8), (450, [1.0, None] * 4), (550, [float("nan")] * 8), (600, [float("inf")] + [1.0] * 7), (None, rows[7][1])]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w]
        assert np.allclose([x for _, x in got[q]], [x for _, x in w], atol=1e-12)


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert [i for i, _ in run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0])])[0]] == [2, 1]


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_on_random_vectors(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    if kind == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.4 * x
    rows = list(enumerate(x.tolist()))
    assert recall(run(spark, rows), brute(rows)) >= 0.9


def test_recall_on_given_embeddings(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(run(spark, rows), brute(rows)) >= 0.9


def test_recall_over_hundreds_of_lists(spark):
    rows = list(enumerate(np.random.default_rng(4).normal(size=(12_000, 64)).tolist()))
    # 800 lists: 32 of them hold too few of the neighbours.
    assert recall(run(spark, rows, Settings(list_size=15)), brute(rows)) >= 0.9
