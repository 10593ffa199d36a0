"""Quality classifier: text evidence joined with what is known of its host and path.

A logistic model over telling words and binned shape features gives each document
its evidence, as log odds against the labelled share, on two questions: is it good,
is it toxic. Hosts
and paths (host and language here) add a prior: the mean posterior of their
documents, shrunk towards the level above with a strength that is estimated from
the spread between sites (empirical Bayes, method of moments). A site with few
documents takes its parent's rate; one with many keeps its own.

The model is fitted on at most ``Settings.sample`` labelled documents, chosen by
the hash of their id. Site statistics cover every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import FOLD, MARKS, Block, U, blocks, bound_batches, distinct_sorted, hand_back, mix, words
from gridspark.session import cut

BITS = 19  # the upper half of the buckets is for word beginnings
_HALF = 0.5
UNKNOWN = {"good": 0.99, "toxic": 0.01}  # shares where nothing is labelled: no text is under suspicion
STEM = 4  # bytes of a word's beginning


@dataclass(frozen=True)
class Settings:
    sample: int = 5_000  # most labelled documents that the model is fitted on
    min_docs: int = 6  # labelled documents a word must be in
    z: float = 5.0  # evidence that a word's rates differ, in standard errors
    lift: float = 8.0  # ratio by which they differ at least
    telling: int = 256  # most words in the model
    ridge: float = 0.3
    good_at: float = 0.5  # kept if P(good) is at least this ...
    toxic_at: float = 0.3  # ... and P(toxic) is less than this
    small_sites: int = 50_000  # a site table of more rows is joined by shuffle


@dataclass
class Model:
    """Weights per hashed word and per shape bin, for ``good`` and ``toxic``."""

    base: dict[str, float]  # share among the labelled
    bias: dict[str, float]
    word: dict[str, np.ndarray]
    shape: dict[str, list[np.ndarray]]
    settings: Settings = field(default_factory=Settings)


#: Borders of the shape bins.
EDGES = (
    np.array([2, 5, 10, 20, 50, 100, 200, 500, 1000.0]),  # words
    np.array([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),  # distinct words / sqrt-scaled words
    np.array([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3]),  # share of symbol bytes
    np.array([0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.4, 0.6]),  # share of capital letters
    np.array([0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2]),  # share of digits
    np.array([3, 4, 5, 6, 7, 8, 10, 14.0]),  # bytes a word
    np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8]),  # words that equal the one before
    np.array([0.0, 0.05, 0.1, 0.2, 0.5, 0.8]),  # share of capitals-only words among words of three bytes or more
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*map(ord, "#$%&*<>@^_`{|}~\\=+/[]")]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every distinct hashed word and word beginning, and the shape bins (documents x features)."""
    w, n = words(block, MARKS), len(block)
    bucket = (w.hash >> U(65 - BITS)).astype(np.int64)
    stem = np.flatnonzero(w.end - w.start > STEM)
    head = np.zeros(len(stem), U)
    with np.errstate(over="ignore"):
        for j in range(STEM):
            head = head * U(0x100) + FOLD[block.data[w.start[stem] + j]]
    begins = (mix(head) >> U(65 - BITS)).astype(np.int64) | (1 << (BITS - 1))
    seen = np.zeros(0, np.int64)
    if len(bucket):
        seen = np.concatenate([(w.doc << BITS) | bucket, (w.doc[stem] << BITS) | begins])
    pair = distinct_sorted(seen)
    doc, bucket = pair >> BITS, pair & ((1 << BITS) - 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[block.data], dtype=np.int32)])
        return np.diff(total[block.offsets]) / np.maximum(np.diff(block.offsets), 1)

    count = np.diff(w.bounds)
    per = np.maximum(count, 1)
    distinct = np.bincount(doc[bucket < 1 << (BITS - 1)], minlength=n)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = w.end - w.start
    caps = np.concatenate([[0], np.cumsum(_UPPER[block.data])])
    long = size >= 3
    shouted = long & (caps[w.end] - caps[w.start] == size)
    raw = (
        count, distinct / np.maximum(np.minimum(per, 20 * np.sqrt(per)), 1), share(_SYMBOL), share(_UPPER), share(_DIGIT),
        np.bincount(w.doc, size, n) / per, np.bincount(w.doc, again, n) / per,
        np.bincount(w.doc, shouted, n) / np.maximum(np.bincount(w.doc, long, n), 1),
    )
    return doc, bucket, np.stack([np.searchsorted(e, x, side="left") for e, x in zip(EDGES, raw, strict=True)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the last column of the normal equations is the intercept."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(texts: pa.Array, good: np.ndarray, toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Ridge logistic regression over telling words and shape bins; a sample of one class gives an even-handed model.

    Telling words have rates that differ by ``settings.lift`` and by ``settings.z`` standard errors.
    The intercept is moved by the labelled share's log odds, so that what remains is evidence.
    """
    docs, buckets, shapes, seen = [], [], [], 0
    for b in blocks(texts):
        d, k, s = features(b)
        docs.append((d + seen).astype(np.int32))
        buckets.append(k.astype(np.int32))
        shapes.append(s)
        seen += len(b)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    shape = np.concatenate(shapes) if shapes else np.zeros((0, len(EDGES)), np.int64)
    m = Model({}, {}, {}, {}, settings)
    sizes = [len(e) + 1 for e in EDGES]
    onehot = np.zeros((seen, sum(sizes)), np.float32)
    for j, at in enumerate(np.concatenate([[0], np.cumsum(sizes)[:-1]])):
        onehot[np.arange(seen), at + shape[:, j]] = 1
    for name, y in (("good", good), ("toxic", toxic)):
        y = y.astype(bool)
        n1, n0 = int(y.sum()), int((~y).sum())
        m.base[name] = (n1 + _HALF) / (n1 + n0 + 1) if len(y) else UNKNOWN[name]
        m.word[name], m.bias[name], m.shape[name] = np.zeros(1 << BITS), 0.0, [np.zeros(k) for k in sizes]
        if not min(n1, n0):
            continue
        c1 = np.bincount(bucket[y[doc]], minlength=1 << BITS)
        c0 = np.bincount(bucket[~y[doc]], minlength=1 << BITS)
        p1, p0 = (c1 + _HALF) / (n1 + 1), (c0 + _HALF) / (n0 + 1)
        pool = (c1 + c0 + 1) / (n1 + n0 + 2)
        z = np.abs(p1 - p0) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0))
        z[(c1 + c0 < settings.min_docs) | (z < settings.z) | (np.abs(np.log(p1 / p0)) < np.log(settings.lift))] = 0
        telling = np.argsort(-z, kind="stable")[: settings.telling]
        telling = telling[z[telling] > 0]
        column = np.full(1 << BITS, -1)
        column[telling] = np.arange(len(telling))
        x = np.zeros((seen, len(telling) + onehot.shape[1]), np.float32)
        has = column[bucket] >= 0
        x[doc[has], column[bucket[has]]] = 1
        x[:, len(telling):] = onehot
        w, bias = _logistic(x, y.astype(np.float64), settings.ridge)
        m.word[name][telling] = w[: len(telling)]
        m.bias[name] = bias - float(np.log(m.base[name] / (1 - m.base[name])))
        m.shape[name] = np.split(w[len(telling):], np.cumsum(sizes)[:-1])
    return m


def score(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Evidence (log odds) for being good and for being toxic."""
    out: dict[str, list[np.ndarray]] = {"good": [], "toxic": []}
    for b in blocks(texts):
        doc, bucket, shape = features(b)
        for name, llr in out.items():
            x = m.bias[name] + np.bincount(doc, m.word[name][bucket], len(b))
            for j, w in enumerate(m.shape[name]):
                x = x + w[shape[:, j]]
            llr.append(x)
    return tuple(np.concatenate(v) if v else np.zeros(0) for v in out.values())


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.sample`` labelled documents; the only rows that reach the driver.

    Labels with a null id or a null mark are left out; of several labels of one id the lowest
    quality and the highest toxicity count. The ids with the smallest hashes are taken.
    """
    want = (
        labels.select("doc_id", "quality", "toxic").dropna()
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    )
    # The ids are few, so they go to the texts and no text is shuffled.
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(want), "doc_id")
    # Ids may repeat in the documents, so the rows are bounded once more; copies teach nothing twice.
    got = texts.orderBy(F.xxhash64("doc_id"), "text").limit(settings.sample).dropDuplicates(["text"]).select("text", "quality", "toxic").toArrow()
    return fit(got["text"].combine_chunks(), got["quality"].to_numpy() > 0, got["toxic"].to_numpy() > 0, settings)


def evidence(m: Model) -> Column:
    """A column function of the text: struct of both log odds.

    It counts as nondeterministic, as a filter that is inferred from a join would otherwise judge
    each text a second time, by a second worker in the same task.
    """

    @F.arrow_udf("good double, toxic double")
    def judge(texts: pa.Array) -> pa.Array:
        hand_back()  # what earlier stages and batches left in the worker
        g, t = score(m, texts)
        return pa.StructArray.from_arrays([pa.array(g), pa.array(t)], ["good", "toxic"])

    return judge.asNondeterministic()


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _moments(sites: DataFrame, name: str, parent: Column) -> Column:
    """Strength (in documents) of the parent's rate: within-site over between-site variance.

    ``m`` is a site's mean posterior and ``n`` its documents. The spread of ``m`` beyond what
    its own sampling explains is the variance between sites; without any, the strength is large.
    """
    within = parent * (1 - parent)
    excess = F.sum(F.col("n") * ((F.col(name) - parent) ** 2)) - F.sum(within)
    between = excess / F.sum("n")
    return F.when(between > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.avg(within) / between))).otherwise(1e6)


def site_priors(scored: DataFrame, base: dict[str, float]) -> DataFrame:
    """host, path -> p_good, p_toxic, by one aggregation per level.

    ``scored``: host, path, good, toxic (posteriors by the text alone). Rows with an unknown host
    or path form a site of their own.
    """
    path = scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("s_good"), F.sum("toxic").alias("s_toxic"))
    path = cut(path)
    host = path.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s_good", "s_toxic")])
    for name in base:
        host = host.withColumn(name, F.col(f"s_{name}") / F.col("n"))
    everything = host.agg(*[(F.sum(f"s_{k}") / F.sum("n")).alias(f"g_{k}") for k in base])
    host = host.crossJoin(F.broadcast(everything))  # one row
    k = host.agg(*[_moments(host, x, F.col(f"g_{x}")).alias(f"k_{x}") for x in base])
    host = host.crossJoin(F.broadcast(k))
    host = host.select("host", *[((F.col(f"s_{x}") + F.col(f"k_{x}") * F.col(f"g_{x}")) / (F.col("n") + F.col(f"k_{x}"))).alias(f"h_{x}") for x in base])
    path = path.join(host, path["host"].eqNullSafe(host["host"])).drop(host["host"])
    for name in base:
        path = path.withColumn(name, F.col(f"s_{name}") / F.col("n"))
    k = path.agg(*[_moments(path, x, F.col(f"h_{x}")).alias(f"k_{x}") for x in base])
    path = path.crossJoin(F.broadcast(k))
    eps = 1e-4
    return path.select("host", "path", *[
        F.greatest(F.lit(eps), F.least(F.lit(1 - eps), (F.col(f"s_{x}") + F.col(f"k_{x}") * F.col(f"h_{x}")) / (F.col("n") + F.col(f"k_{x}")))).alias(f"p_{x}")
        for x in base])


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Every row of ``documents`` with its verdict, in a struct column ``quality_``.

    ``quality_``: good, toxic (posterior probabilities), text_good, text_toxic (by the text alone),
    host_good, host_toxic (prior of its site), keep. Null and empty texts are judged as empty texts
    (no words, all shapes in their lowest bin). Repeated rows are judged alike, each one counts in
    its site. Without labels the evidence is even and only ``UNKNOWN`` remains, so that every row
    is kept. Columns of any name pass through, but for ``quality_``, which is replaced.
    """
    bound_batches(documents.sparkSession)
    m = train(documents, labels, settings)
    judge = evidence(m)
    rest = [c for c in documents.columns if c != "quality_"]
    base = {k: float(v) for k, v in m.base.items()}

    def judged(df: DataFrame) -> DataFrame:
        return df.withColumn("_e", judge(F.coalesce("text", F.lit(""))))

    def posterior(llr: str, prior: Column) -> Column:
        return 1 / (1 + F.exp(-(F.col(llr) + _logit(prior))))

    alone = judged(documents.select(F.col(host).alias("host"), F.col(path).alias("path"), "text")).select(
        "host", "path", *[posterior(f"_e.{k}", F.lit(base[k])).alias(k) for k in base])
    sites = cut(site_priors(alone, base).select(F.struct(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "p_good", "p_toxic").alias("_s")))
    if sites.count() <= settings.small_sites:
        sites = F.broadcast(sites)
    whole = judged(documents.select(*rest)).withColumn("_e", F.struct(F.col("_e.good").alias("good"), F.col("_e.toxic").alias("toxic")))
    both = whole.join(sites, F.col(host).eqNullSafe(F.col("_s._host")) & F.col(path).eqNullSafe(F.col("_s._path")), "left")
    p = {k: posterior(f"_e.{k}", F.col(f"_s.p_{k}")) for k in base}
    return both.select(*rest, F.struct(
        p["good"].alias("good"), p["toxic"].alias("toxic"),
        posterior("_e.good", F.lit(base["good"])).alias("text_good"), posterior("_e.toxic", F.lit(base["toxic"])).alias("text_toxic"),
        F.col("_s.p_good").alias("host_good"), F.col("_s.p_toxic").alias("host_toxic"),
        ((p["good"] >= settings.good_at) & (p["toxic"] < settings.toxic_at)).alias("keep")).alias("quality_"))
