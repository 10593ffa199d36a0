import random

from gridspark.llm.tiling import Settings, contaminated, tile


def naive(doc, item, shortest):
    """Greedy tiling by trying all starts anew for every tile."""
    fd, ft, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fd[i + n] and ft[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < shortest:
            return sum(t for t in out)
        fd[i:i + n] = [False] * n
        ft[j:j + n] = [False] * n
        out.append(n)


def test_tiles_match_naive_greedy():
    rng = random.Random(4)
    for _ in range(120):
        item = [rng.randrange(1, 60) for _ in range(rng.randrange(5, 60))]
        parts = []
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(len(item))
            parts.append(item[a:a + rng.randrange(3, 40)])
            parts.append([rng.randrange(100, 200)] * rng.randrange(1, 3))
        doc = [x for p in parts for x in p]
        got = tile(doc, item, 5)
        used = [k for i, j, n in got for k in range(j, j + n)]
        assert len(used) == len(set(used))
        assert all(doc[i:i + n] == item[j:j + n] and n >= 5 for i, j, n in got)
        assert sum(n for _, _, n in got) == naive(doc, item, 5)


def find(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, seeds string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n long")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in contaminated(d, b).collect())


def test_whole_reordered_partial_and_clean(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]
    shuffled = item[30:] + noise(3) + item[10:20] + noise(2) + item[:10] + noise(1) + item[20:30]
    docs = [
        (1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(20) + shuffled).upper()), (3, " ".join(noise(9) + item[:10] + noise(9))),
        (4, " ".join(noise(300))), (5, None), (6, ""), (None, ", ".join(item)), (1, " ".join(noise(50) + item + noise(50))), (7, " ".join(noise(5) + item[:20] + noise(30000))),
        (8, " ".join(item)), (8, " ".join(item)),
    ]
    assert find(spark, docs, [(0, " ".join(item)), (1, None), (2, "a b c"), (3, "")]) == [(-1, 0), (1, 0), (1, 0), (2, 0), (7, 0), (8, 0)]
    assert find(spark, [], [(0, " ".join(item))]) == [] and find(spark, docs, []) == []


def test_given_benchmark(spark, sf):
    """Against brute force: every document that holds an item's words in a row is found."""
    import re

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())) + " "
    want = {(d, i) for d, t in docs for i, x in items if norm(x) in norm(t)}
    got = set(find(spark, docs, items))
    assert want and want <= got
