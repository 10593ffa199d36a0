import random
import re

from gridspark.llm.common import BATCH, bound_batches
from gridspark.llm.spans import PASSAGES, Settings, dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    """(start byte, words) of each sentence, worked out on the bytes one by one."""
    data, out, new = text.encode(), [], True
    for m in re.finditer(rb"[^\x20\x09-\x0D]+|\n", data):
        if m[0] == b"\n":
            new = True
            continue
        if new:
            out.append((m.start(), []))
        out[-1][1].append(m[0].decode().translate(FOLD))
        new = m[0][-1:] in b".!?"
    return out, data


def brute(rows, span=2, least=8):
    places = {}
    docs = [split(t or "") for _, t in rows]
    for (d, t), (sents, _) in zip(rows, docs):
        for i in range(len(sents) - span + 1):
            key = tuple(tuple(w) for _, w in sents[i:i + span])
            if sum(map(len, key)) >= least:
                places.setdefault(key, set()).add((d is None, d or 0, i))
    out = []
    for (d, t), (sents, data) in zip(rows, docs):
        gone = set()
        for i in range(len(sents) - span + 1):
            key = tuple(tuple(w) for _, w in sents[i:i + span])
            if sum(map(len, key)) >= least and min(places[key]) < (d is None, d or 0, i):
                gone |= set(range(i, i + span))
        ends = [s for s, _ in sents[1:]] + [len(data)]
        kept, here = b"", 0
        for i in sorted(gone):
            kept += data[here:sents[i][0]]
            here = ends[i]
        kept += data[here:]
        out.append((d, None if t is None else kept.decode(), len(data) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, spans long")
    got = dedup(df, Settings(**kw)).collect()
    return sorted(((r.doc_id, r.text, r.cut_.n_removed) for r in got), key=str)


def test_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "?", "\n", " x\n\n"]) for _ in range(40)]
    rows = [(k // 2 if k % 7 else k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(80)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, span=3) == brute(rows, span=3)


def test_edges(spark):
    p = "One two three four. Five six seven eight nine! "
    rows = [(1, None), (2, ""), (3, p), (4, "é " + p + "ü"), (4, "é " + p + "ü"), (None, p.upper()), (5, p + p), (6, "a b.\n" * 30000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def brute_passages(rows, least=8):
    """Every run of whole sentences with at least ``least`` words, of any length."""
    docs = [split(t or "") for _, t in rows]
    places, out = {}, []
    runs = [[(i, j, tuple(tuple(w) for _, w in sents[i:j])) for i in range(len(sents)) for j in range(i + 1, len(sents) + 1)] for sents, _ in docs]
    runs = [[(i, j, key) for i, j, key in r if sum(map(len, key)) >= least] for r in runs]
    for (d, _), r in zip(rows, runs):
        for i, _, key in r:
            places.setdefault(key, set()).add((d is None, d or 0, i))
    for (d, t), (sents, data), r in zip(rows, docs, runs):
        gone = {k for i, j, key in r if min(places[key]) < (d is None, d or 0, i) for k in range(i, j)}
        ends = [s for s, _ in sents[1:]] + [len(data)]
        kept, here = b"", 0
        for i in sorted(gone):
            kept += data[here:sents[i][0]]
            here = ends[i]
        kept += data[here:]
        out.append((d, None if t is None else kept.decode(), len(data) - len(kept)))
    return sorted(out, key=str)


def test_passages_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12]))) + rng.choice([".", "!", "?", "\n"]) for _ in range(16)]
    rows = [(k // 2 if k % 7 else k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(80)]
    assert run(spark, rows, passages=True) == brute_passages(rows)
    assert run(spark, [], passages=True) == []


def test_common_sentences_stay_and_passages_go(spark):
    rng = random.Random(5)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, passage = word(12) + ".", ". ".join(word(9) for _ in range(6)) + "."
    rows = [(k, f"{word(30)}. {common} {word(25)}.") for k in range(20)]
    rows += [(k, f"{word(7)} {passage} {word(30)}.") for k in range(20, 23)]  # its first sentence runs into other text
    got = run(spark, rows, min_words=PASSAGES.min_words, passages=PASSAGES.passages)
    assert got == brute_passages(rows, PASSAGES.min_words)
    lost = {d: n for d, _, n in got}
    first = len(passage.split(". ")[0]) + 2
    assert [lost[k] for k in range(21)] == [0] * 21
    assert [lost[k] for k in (21, 22)] == [len(passage) + 1 - first] * 2


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.set(BATCH, "3MB")
        bound_batches(spark)
        assert spark.conf.get(BATCH) == "3MB"
        spark.conf.unset(BATCH)
        bound_batches(spark)
        assert spark.conf.get(BATCH) == "8MB"
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def test_given_documents_by_passages(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(split(t or "")[0]) <= 60]  # the brute force looks at all runs
    assert len(rows) > 100
    assert run(spark, rows, min_words=PASSAGES.min_words, passages=PASSAGES.passages) == brute_passages(rows, PASSAGES.min_words)


def test_query_cuts_short_lines_and_single_sentences(spark, tmp_path):
    from gridspark.llm.queries import QUERIES

    short = "\n".join(f"Ater. WORD{k}!!" for k in range(20)) + "\n"
    single = " ".join(f"w{k}" for k in range(60))
    rows = [(1, short), (2, "Something else.\n" + short + "Other end."), (3, single), (4, single), (5, "Before it.\n" + single + "\nAfter it.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: len(short), 3: 0, 4: len(single), 5: len(single) + 1}


def joined_rows(df):
    """Rows that the join by span makes."""
    spark = df.sparkSession
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, counts = store.executionMetrics(last), store.planGraph(last).allNodes().iterator(), []
    while nodes.hasNext():
        node = nodes.next()
        if "Join" in node.name() and "span#" in node.desc():
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows":
                    counts.append(int(values.get(m.accumulatorId()).get().replace(",", "")))
    return counts


def test_a_line_repeated_within_documents_is_one_row_each(spark):
    line = "one two three four five six seven eight. "
    rows = [(k, f"Only {k} here\n{line * 200}") for k in range(30)]
    assert run(spark, rows, passages=True) == sorted(
        [(d, t[: t.index("one")] + (line if d == 0 else ""), len(line) * (199 if d == 0 else 200)) for d, t in rows], key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (made,) = joined_rows(dedup(df, Settings(passages=True)))
    assert made <= 2 * len(rows)
