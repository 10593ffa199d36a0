import random
import re
from itertools import combinations

import pytest

from gridspark.llm.ngram_join import Settings, classes, join


def shingles(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for hits in index.values():
        for i, j in combinations(hits, 2):
            if (i, j) not in seen:
                seen.add((i, j))
                k = len(sets[i] & sets[j])
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or root(i) in least else None
    return sorted(((d, len(sets[i]), d if not sets[i] else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, settings=Settings()):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sid string")
    return sorted((tuple(r) for r in classes(df, settings).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        k = rng.randrange(len(out))
        what = rng.random()
        if what < 0.4:
            out[k] = f"new{rng.randrange(99999)}"
        elif what < 0.7 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, f"more{rng.randrange(99999)}")
    return out


@pytest.mark.parametrize("sample", [4000, 0])
def test_brute_force_on_edited_copies(spark, sample):
    rng = random.Random(3)
    rows, k = [], 0
    passage = [f"p{i}" for i in range(40)]
    for base in range(60):
        n = rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 200, 700])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        if rng.random() < 0.4:
            words = words[: n // 2] + passage + words[n // 2:]
        for _ in range(rng.randrange(1, 9)):
            rows.append((k, " ".join(edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1])))))
            k += 1
    assert result(spark, rows, Settings(sample=sample)) == brute(rows)


def test_tiny_sets_meet_in_crowded_segments(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = [f"t{rng.randrange(4000)}" for _ in range(rng.choice([7, 8, 9, 10]))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "tail"]))]
    assert result(spark, rows) == brute(rows)


def test_nulls_empty_repeats_and_long(spark):
    long = " ".join(f"l{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "A b c d e F"), (6, "one"), (7, "One"),
            (8, long), (9, long + " end"), (None, None)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_links_are_verified_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spark, rows) == brute(rows)
    sets, links = join(docs)
    text = dict(rows)
    of = {r.sid: shingles(text[r.doc_id]) for r in sets.collect()}
    for u, v in links.collect():
        k = len(of[u] & of[v])
        assert 100 * k >= 75 * (len(of[u]) + len(of[v]) - k)
