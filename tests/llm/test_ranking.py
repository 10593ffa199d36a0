import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridspark.llm.ranking import Settings, item_terms, search, term_at_a_time

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(split(t))) for d, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(w for _, b in bags for w in b)
    want = defaultdict(Counter)
    for i, t in set(items):
        want[i].update(split(t))
    out = []
    for i, q in want.items():
        found = []
        for (d, b), n in zip(bags, lengths):
            score = 0
            for w, c in q.items():
                if b[w]:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, s=Settings(), parts=3):
    d = spark.createDataFrame([(i, t, i, "w") for i, t in docs], "doc_id long, text string, score long, terms string").repartition(parts)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in search(d, q, s).collect()), key=str)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(300)] + ["Ähre", "ähre", "THE", "a1", "中文"]
    text = lambda m: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(m)))
    return [(i, text(80)) for i in range(n)], [(i, text(30)) for i in range(12)]


@pytest.mark.parametrize("s", [Settings(), Settings(k=3, block_bytes=2000, terms_per_pass=40, filter_bits=8)])
def test_equals_brute_force(spark, s):
    docs, items = corpus(400, 5)
    assert got(spark, docs, items, s) == brute(docs, items, s.k)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    docs = [(5, "x y"), (5, "x y"), (3, "Y,x!"), (None, "x y"), (9, None), (8, ""), (7, "-- \n"), (6, "x " * 400_000 + "y"), (4, "z" * 2_000_000)]
    items = [(1, "X y y"), (1, "X y y"), (1, "z"), (2, None), (3, "..."), (None, "y"), (4, "nowhere")]
    out = got(spark, docs, items)
    assert out == brute(docs, items)
    assert [d for i, _, d, _ in sorted((r for r in out if r[0] == 1), key=lambda r: r[1])][:4] == [3, 5, 5, None]


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] == got(spark, [(1, "a")], []) == got(spark, [], [])
    assert got(spark, [(1, None)], [(1, "a")]) == []


def test_a_term_that_all_documents_have_still_counts(spark):
    docs = [(i, "common") for i in range(30)]
    assert got(spark, docs, [(1, "common")]) == brute(docs, [(1, "common")])


def test_accumulators_are_limited_and_results_exact():
    rng = np.random.default_rng(2)
    stopped = 0
    for _ in range(200):
        n, postings = 2000, []
        for size in (5, 15, 40, 900, 1900):
            places = np.sort(rng.choice(n, size, replace=False))
            added = rng.integers(1, 6, size) * max(1, 4000 // size)
            postings.append((int(added.max()), places, added))
        whole = np.zeros(n, np.int64)
        for _, p, a in postings:
            whole[p] += a
        ids = rng.permutation(n)
        best, score, made = term_at_a_time(postings, n, ids, 10)
        order = np.lexsort((ids, -whole))[:10]
        assert best.tolist() == order.tolist() and score.tolist() == whole[order].tolist()
        stopped += made < np.count_nonzero(whole)
    assert stopped > 150


def test_terms_of_items(spark):
    q = spark.createDataFrame([(1, "a A b"), (1, "a A b"), (1, "b")], "item_id long, text string")
    assert sorted(r.qtf for r in item_terms(q).collect()) == [2, 2]
