import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm.quality import Settings, classify, fit, score


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, path string")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = classify(docs, known).join(held, "doc_id").select("quality", "toxic", "quality_.keep").toPandas()
    clean = (got.quality == 1) & (got.toxic == 0)
    assert got.keep[clean].mean() > 0.98
    assert (~got.keep[(got.quality == 0)]).mean() > 0.95
    assert (~got.keep[(got.toxic == 1)]).mean() > 0.9


def words(rng, n, extra=()):
    return " ".join([*(f"word{rng.integers(300)}" for _ in range(n)), *extra])


def corpus(seed=1, n=600):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 5 == 0
        rows.append((k, words(rng, 40, ["spamword"] * 3 * bad + ["rude"] * toxic), "en", f"s{k % 3}"))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_sites_move_undecided_documents(spark):
    """Text without evidence takes its site's rate; a site of one document stays near the mean."""
    rows, labels = [], []
    for k in range(900):
        bad = (k % 10 == 0) if k % 2 else (k % 10 != 0)
        rows.append((k, f"plain{k} words here " * 3 + ("spamword " * 3 if bad else "finething " * 3), "en", "clean" if k % 2 else "spam"))
        labels.append((k, int(not bad), 0))
    rows += [(1000, "nothing to go by", "en", "clean"), (1001, "nothing to go by", "en", "spam"), (1002, "nothing to go by", "en", "lonely"), (1003, None, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_ for r in classify(table(spark, rows), lab, settings=Settings(min_docs=5)).filter("doc_id >= 1000").collect()}
    assert got[1000].host_good > got[1002].host_good > got[1001].host_good
    assert got[1000].good > got[1001].good
    assert len(got) == 4


def test_edges_and_other_columns(spark):
    rows, labels = corpus()
    rows += [(7000, None, "en", "s0"), (7001, "", None, "s0"), (None, "word1 rude", "en", None), (0, rows[0][1], "en", "s0"), (7002, "word1 " * 200000, "en", "s1")]
    labels += [(None, 1, 0), (5, None, 1), (6, 0, None), (0, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = table(spark, rows)
    got = classify(df, lab)
    assert got.columns == [*df.columns, "quality_"] and got.count() == len(rows)
    same = got.filter("doc_id = 0").select("quality_").distinct()
    assert same.count() == 1
    assert got.filter("quality_.keep is null or isnan(quality_.good) or isnan(quality_.toxic)").count() == 0
    assert classify(df.limit(0), lab).count() == 0
    assert classify(df, lab.limit(0)).filter("not quality_.keep").count() == 0


def test_model_separates_and_survives_one_class():
    rows, labels = corpus()
    texts = pa.array([r[1] for r in rows])
    good, toxic = (np.array([x[i] for x in labels]) for i in (1, 2))
    m = fit(texts, good, toxic)
    g, t = score(m, texts)
    assert ((g > 0) == (good > 0)).mean() > 0.98 and ((t > 0) == (toxic > 0)).mean() > 0.98
    g, t = score(fit(texts, np.ones(len(good)), np.zeros(len(good))), texts)
    assert not g.any() and not t.any()
    assert [len(x) for x in score(fit(pa.array([], pa.string()), good[:0], good[:0]), texts)] == [len(rows)] * 2


@pytest.mark.parametrize("parts", [1, 7])
def test_layout_does_not_matter(spark, parts):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(table(spark, rows).repartition(parts), lab).orderBy("doc_id").select("quality_.good").toPandas().good
    want = classify(table(spark, rows).coalesce(1), lab).orderBy("doc_id").select("quality_.good").toPandas().good
    assert np.allclose(got, want, atol=1e-6)
