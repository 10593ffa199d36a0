import random
import re
from math import ceil

from gridspark.llm.licenses import Settings, scan

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(d, t, s):
    w = words(t)
    base = [(i, label) for p, label in s.phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    labels, best = {x for _, x in base}, 0.0
    for line in (t or "").split("\n"):
        have = set(words(line))
        for label, text in s.notices:
            need = set(words(text))
            k = len(have & need)
            if k >= ceil(s.containment * len(need) - 1e-9):
                labels.add(label)
                best = max(best, k / len(need))
    return (d, len(w), sorted(base), sorted(labels), round(1.0 if base else best, 9))


def run(spark, rows, s=Settings()):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, w string, n int")
    got = scan(df, s)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return sorted(((r.doc_id, r.n_words, sorted((b["at"], b["label"]) for b in r.bases), list(r.labels), round(r.score, 9)) for r in got.collect()), key=str)


def test_brute_force(spark):
    rng, s = random.Random(8), Settings()
    pool = [x for _, t in s.notices for x in t.split()] + ["GNU", "General", "public", "LICENSE", "cc", "by", "MIT", "é", "mit-license", "x1"]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = rng.choice(s.notices)[1].split() if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
            line = [x for x in line if rng.random() > rng.choice([0, 0.1, 0.2, 0.3])]
            rng.random() < 0.3 and rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", ", "]).join(line))
        rows.append((k // 2, rng.choice(["\n", " "]).join(lines)))
    assert run(spark, rows) == sorted((brute(d, t, s) for d, t in rows), key=str)


def test_edges(spark):
    s = Settings()
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "Apache License, apache\nlicense cc-by mit license"), (4, "xapache license"), (4, "xapache license"),
            (5, "word " * 30000 + "MIT License"), (6, "cc cc by by"), (7, "日本語 GNU GENERAL PUBLIC LICENSE 😀")]
    assert run(spark, rows) == sorted((brute(d, t, s) for d, t in rows), key=str)
    assert run(spark, []) == []


def test_given_documents(spark, sf):
    s = Settings()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == sorted((brute(d, t, s) for d, t in rows), key=str)


def test_query_finds_wrapped_notices(spark, tmp_path):
    import textwrap

    from gridspark.llm.queries import QUERIES

    s = Settings()
    rows, want = [], {}
    for k, (label, text) in enumerate(s.notices):
        body = "Some words before it. " + text + " and some more words after it that do not matter here"
        rows.append((k, "\n".join("# " + x for x in textwrap.wrap(body, 24))))
        want[k] = label
    # All words of a notice, spread over a long paragraph.
    rows.append((100, "\n".join(f"{x} filler one two three" for x in s.notices[9][1].split())))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert all(want[k] in got[k].labels.split(",") and got[k].score == 1.0 for k in want)
    assert got[100].labels == "" and got[100].score == 0


def test_windows_brute_force(spark):
    rng, s = random.Random(9), Settings(wrapped=True)
    pool = [x for _, t in s.notices for x in t.split()] + ["x1", "other"]
    rows = []
    for k in range(60):
        text = [x for _ in range(rng.randrange(0, 4)) for x in rng.choice(s.notices)[1].split() + rng.choices(pool, k=3) if rng.random() > 0.1]
        rows.append((k, "".join(x + rng.choice([" ", " ", "\n"]) for x in text)))
    want = []
    for d, t in rows:
        _, n, base, labels, score = brute(d, t, s)
        w = words(t)
        for label, text in s.notices:
            need = set(words(text))
            k = max((len(need & set(w[i:i + len(words(text))])) for i in range(len(w))), default=0)
            if k >= ceil(s.containment * len(need) - 1e-9):
                labels, score = sorted({*labels, label}), max(score, round(k / len(need), 9))
        want.append((d, n, base, labels, score))
    assert run(spark, rows, s) == sorted(want, key=str)
