import hashlib
import random

import numpy as np
import pytest

from gridspark.llm.suffix import Queues, Settings, dedup, suffix_order


def common(a, b, cap):
    n = 0
    while n < min(len(a), len(b), cap) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("memory", [64 << 20, 200])
def test_suffix_order_and_common_prefixes(memory):
    rng = random.Random(1)
    for trial in range(150):
        cap = rng.choice([3, 8, 10, 20])
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(97, 123))])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 12))]
        if trial % 3 == 0:
            pieces += [p[rng.randrange(len(p)):] + b"x" for p in pieces]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
        text[np.cumsum([len(p) + 1 for p in pieces]) - 1] = 0
        raw = text.tolist()
        suffix = lambda i: raw[i: raw.index(0, i)]
        batches = list(suffix_order(text, cap, memory))
        at = np.concatenate([b[0] for b in batches]).tolist()
        lcp = np.concatenate([b[1] for b in batches]).tolist()
        assert sorted(at) == [i for i, c in enumerate(raw) if c]
        keys = [suffix(i)[:cap] for i in at]
        assert keys == sorted(keys, reverse=True)
        for k in range(1, len(at)):
            real = common(suffix(at[k]), suffix(at[k - 1]), cap)
            assert lcp[k] == real or (real == 0 and lcp[k] == 1)  # the first of a character


def test_queues_spill_and_keep_order():
    q = Queues(500)
    want = {c: [] for c in (1, 2, 3)}
    rng = np.random.default_rng(1)
    for k in range(60):
        c, n = int(rng.integers(1, 4)), int(rng.integers(1, 9))
        q.put(c, np.arange(n) + k, np.full(n, k, np.uint8))
        want[c] += [(i + k, k) for i in range(n)]
        if k == 30:
            a, b = q.take(2)
            assert list(zip(a, b)) == want[2]
            want[2] = []
    for c in want:
        a, b = q.take(c)
        assert list(zip(a, b)) == want[c]
    assert q.file is not None
    q.close()


def brute(rows, n=50):
    least = {}
    key = lambda d: (d is None, d or 0)
    docs = [(d, (t or "").encode()) for d, t in rows]
    for d, t in docs:
        for i in range(len(t) - n + 1):
            g = t[i:i + n]
            if g not in least or key(d) < least[g]:
                least[g] = key(d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if least[t[i:i + n]] < key(d):
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, settings=Settings()):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    got = dedup(df, settings).collect()
    return sorted(((r.doc_id, r.cut_.n_bytes, r.cut_.n_removed, r.cut_.n_spans, hashlib.sha256(bytes(r.cut_.kept)).hexdigest()) for r in got), key=str)


def test_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and", "über", "日本", "x" * 30, "ababab", "q"]) + str(rng.randrange(50))
    pool = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 7))]
        rows.append((k // 2 if k % 5 else k, rng.choice([" ", "\n"]).join(parts)[rng.randrange(9):]))
    rows += rows[:5]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, Settings(memory=1000)) == brute(rows)


def test_edges(spark):
    a = "0123456789" * 5
    rows = [(1, None), (2, ""), (3, a), (4, a), (4, a), (None, a), (None, a + "!"), (5, a[:-1]), (6, "x" + a + "y"), (7, a * 400), (8, "z" * 5000), (9, "z" * 49), (10, "z" * 50)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_in_another_order_over_partitions(spark):
    rng = random.Random(8)
    pool = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(9)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.6 else str(rng.random()) for _ in range(5))) for k in range(40)]
    twice = rows + rows[::-1]
    df = spark.createDataFrame(spark.sparkContext.parallelize(twice, 2), "doc_id long, text string")
    got = sorted(((r.doc_id, r.cut_.n_bytes, r.cut_.n_removed, r.cut_.n_spans, hashlib.sha256(bytes(r.cut_.kept)).hexdigest()) for r in dedup(df).collect()), key=str)
    assert got == brute(twice)


def test_shuffles_of_minimizers_are_gone_before_pieces_are_sorted(spark, monkeypatch, tmp_path):
    from gridspark.llm import suffix

    rng = random.Random(5)
    pool = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(9)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.6 else str(rng.random()) for _ in range(5))) for k in range(60)]
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    scratch = str(tmp_path)

    def noting(name, step):
        def run(table):
            import glob
            import os
            import time
            import uuid

            def held():
                return {f.split("_")[1] for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

            names = held()
            if name == "sort":  # Spark deletes in the background
                noted = {kind: {k for f in glob.glob(f"{scratch}/{kind}-*") for k in open(f).read().split()} for kind in ("shared", "before")}
                early = noted["shared"] - noted["before"]
                until = time.time() + 2
                while names & early and time.time() < until:
                    time.sleep(0.05)
                    names = held()
            with open(f"{scratch}/{name}-{uuid.uuid4().hex}", "w") as out:
                out.write(" ".join(names))
            return step(table)

        return run

    seen = lambda name: {k for f in tmp_path.glob(f"{name}-*") for k in f.read_text().split()}
    monkeypatch.setattr(suffix, "_shared", noting("shared", suffix._shared))
    sort = suffix._sort
    monkeypatch.setattr(suffix, "_sort", lambda s: noting("sort", sort(s)))
    noting("before", lambda _: None)(None)
    assert run(spark, rows) == brute(rows)
    minimizers = seen("shared") - seen("before")
    assert minimizers and seen("sort")
    assert not minimizers & seen("sort")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_minimizers_do_not_depend_on_the_step(monkeypatch):
    from gridspark.llm import suffix

    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(0, 256, 700), np.full(300, 65), rng.integers(0, 3, 500)]).astype(np.uint8)
    whole = suffix._minimizers(data, Settings())
    assert len(whole) == len(data) - 49
    for step in (1, 7, 64, 1450, 1451):
        monkeypatch.setattr(suffix, "STEP", step)
        assert (suffix._minimizers(data, Settings()) == whole).all()
