"""Approximate nearest neighbours by cosine, over balanced posting lists.

Centroids are fitted on a bounded sample, with a penalty on full clusters so that lists come
out even. Every vector is indexed: in the list of its nearest centroid and, near a border, in
further ones, unless a list already taken lies closer to that centroid than the vector does.
A query walks a neighbour graph of the centroids in memory and reads the lists whose
distance is within a ratio of the nearest. How many lists that takes is measured: for a sample
of queries the exact neighbours are found by brute force, and probes grow, beyond the ratio if
need be, until the sample's recall is reached. Long lists are split into parts, so no group grows
with the data. Equal vectors are one entry, so copies of a vector cost nothing. Scores are
cosines of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut


@dataclass(frozen=True)
class Settings:
    k: int = 5
    list_size: int = 256  # vectors a list is meant to hold
    most_lists: int = 4_096  # lists grow beyond list_size when this many do not suffice
    sample: int = 20_000  # vectors that the centroids are fitted on
    rounds: int = 12
    border: float = 1.25  # a vector goes to further lists up to this ratio of its distance to the nearest
    copies: int = 4  # lists a vector is in at most
    ratio: float = 1.6  # lists that a query reads, by distance against the nearest
    least_probes: int = 8
    most_probes: int = 32  # unless the measured recall asks for more
    recall: float = 0.95  # of the sample's exact neighbours, found in the lists read
    measured: int = 128  # queries of the sample
    links: int = 12  # neighbours of a centroid in the graph
    part: int = 2_048  # entries or queries of a list that are handled at a time


def fit(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit vectors; a cluster's pull weakens as it fills."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), lists, replace=False)]
    fill = np.zeros(lists)
    for _ in range(rounds):
        at = np.concatenate([np.argmax(b @ c.T - 0.05 * fill, 1) for b in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(at, minlength=lists)
        fill = 0.5 * fill + 0.5 * n * lists / len(x)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        empty = n == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


class Graph:
    """Centroids with links to their neighbours, searched best first."""

    def __init__(self, c: np.ndarray, links: int):
        self.c = c
        near = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, 1: links + 1]
        self.links = [set(map(int, r)) for r in near]
        for i, r in enumerate(near):
            for j in r:
                self.links[int(j)].add(i)
        # One way in from every unconnected part.
        self.entries, left = [], set(range(len(c)))
        while left:
            start = min(left)
            self.entries.append(start)
            todo = [start]
            left.discard(start)
            while todo:
                for j in self.links[todo.pop()]:
                    if j in left:
                        left.discard(j)
                        todo.append(j)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the ``width`` nearest centroids as (distance, number), nearest first."""
        seen = set(self.entries)
        d = lambda ids: np.sqrt(np.maximum(2 - 2 * (self.c[ids] @ q), 0)).tolist()
        todo = list(zip(d(self.entries), self.entries, strict=True))
        heapq.heapify(todo)
        best = [(-x, i) for x, i in todo]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= width and x > -best[0][0]:
                break
            fresh = [j for j in self.links[i] if j not in seen]
            seen.update(fresh)
            for y, j in zip(d(fresh), fresh, strict=True) if fresh else ():
                if len(best) < width or y < -best[0][0]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-x, i) for x, i in best)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(1, keepdims=True)  # keeps squares of huge and tiny values finite
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _post(c: np.ndarray, s: Settings):
    between = c @ c.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = _unit(_matrix(batch.column(1))) @ c.T
            order = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * s.copies]
            dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sim, order, 1), 0))
            row, lists = [], []
            for i in range(len(order)):
                taken: list[int] = []
                for j, d in zip(order[i], dist[i], strict=True):
                    if taken and (len(taken) == s.copies or d > s.border * dist[i, 0]):
                        break
                    # A list that is nearer to this centroid than the vector is covers this side.
                    if all(2 - 2 * between[j, t] >= d * d for t in taken):
                        taken.append(int(j))
                row += [i] * len(taken)
                lists += taken
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(x.take(pa.array(row)) for x in batch.columns)], ["list", "key", "vec"])

    return run


def _exact(ids: np.ndarray, q: np.ndarray, k: int):
    """The k nearest of a batch for each of the few queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = q @ _unit(_matrix(batch.column(1))).T
            m = min(k + 1, sim.shape[1])
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            rows = pa.array(top.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.take_along_axis(sim, top, 1).ravel())], ["q", "key", "vec", "sim"])

    return run


def probes(entries: DataFrame, queries: DataFrame, c: np.ndarray, s: Settings) -> tuple[int, float]:
    """How many lists a query reads at most, and up to which ratio, for the wanted recall on a sample of queries."""
    if len(c) <= s.least_probes:
        return s.most_probes, s.ratio
    some = entries.join(queries.select("key").distinct(), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(s.measured).select("key", "vec").toArrow()
    if not some.num_rows:
        return s.most_probes, s.ratio
    q = _unit(_matrix(some["vec"].combine_chunks()))
    near = entries.mapInArrow(_exact(np.arange(len(q)), q, s.k), "q long, key binary, vec array<double>, sim double")
    # The query itself is among its nearest.
    near = near.filter(F.col("key") != F.element_at(F.array(*[F.lit(k) for k in some["key"].to_pylist()]), (F.col("q") + 1).cast("int")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "key"))).filter(F.col("r") <= s.k)
    posted = near.select(F.struct("q", "key").alias("key"), "vec").mapInArrow(_post(c, s), "list int, key struct<q: long, key: binary>, vec array<double>")
    got = posted.select("list", "key.q", "key.key").toArrow().to_pylist()  # k neighbours of each query of the sample
    dist = np.sqrt(np.maximum(2 - 2 * (q @ c.T), 0))
    rank = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1)
    # For each neighbour, the place of the first list that holds it, and whether the ratio lets it in.
    first: dict = {}
    for x in got:
        at = (int(rank[x["q"], x["list"]]), float(dist[x["q"], x["list"]]))
        first[x["q"], x["key"]] = min(first.get((x["q"], x["key"]), at), at)
    if not first:
        return s.most_probes, s.ratio
    close = dist.min(1)
    within = sorted(r for (i, _), (r, d) in first.items() if r < s.least_probes or d <= s.ratio * close[i])
    need = int(np.ceil(s.recall * len(first)))
    if len(within) >= need:
        return max(s.most_probes, within[need - 1] + 1), s.ratio
    return max(s.most_probes, sorted(r for r, _ in first.values())[need - 1] + 1), float("inf")


def _probe(c: np.ndarray, s: Settings, most: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(c, s.links) if 2 * most < len(c) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, lists = [], []
            for i, q in enumerate(_unit(_matrix(batch.column(1)))):
                if graph:
                    near = graph.search(q, 2 * most)
                else:  # a walk would see nearly all centroids
                    dist = np.sqrt(np.maximum(2 - 2 * (c @ q), 0))
                    near = [(float(dist[j]), int(j)) for j in np.argsort(dist, kind="stable")]
                pick = [j for n, (d, j) in enumerate(near[:most]) if n < s.least_probes or d <= ratio * max(near[0][0], 1e-300)]
                row += [i] * len(pick)
                lists += pick
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(x.take(pa.array(row)) for x in batch.columns)], ["list", "key", "vec"])

    return run


def _score(s: Settings):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.binary()), "key": pa.array([], pa.binary()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not entries.num_rows:
            return none
        x, y = (_matrix(t["vec"].combine_chunks()) for t in (queries, entries))
        qk, ek = queries["key"].to_pylist(), entries["key"].to_pylist()
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        ux, uy = _unit(x), _unit(y)
        out: list[list] = [[], [], []]
        for i in range(0, len(x), 256):
            sim = ux[i: i + 256] @ uy.T
            m = min(s.k + 2, sim.shape[1])  # one may be the query itself; one more for ties of rounding
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            for a, r in enumerate(top):
                for j in np.flatnonzero(sim[a] >= sim[a, r].min() - 1e-12):
                    if ek[j] != qk[i + a]:
                        prod = nx[i + a] * ny[j]
                        exact = float(x[i + a] @ y[j] / prod) if np.isfinite(prod) and prod > 1e-300 else float(sim[a, j])
                        out[0].append(qk[i + a])
                        out[1].append(ek[j])
                        out[2].append(exact)
        return pa.table({"q": pa.array(out[0], pa.binary()), "key": pa.array(out[1], pa.binary()), "score": pa.array(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, itself excepted.

    ``vectors``: vec_id, embedding; further columns are ignored. Vectors that are null, empty, zero,
    hold a null or a non-finite component, have no id, or another length than most, take no part. Rows
    that repeat an id and a vector count once. Ties go to the smaller vec_id.
    """
    s = settings
    dense = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(
        "vec_id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vec, x -> x <> 0)")
    # -0.0 and 0.0 are one value.
    dense = dense.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    sizes = dense.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).toArrow().to_pylist()
    dim = sizes[0]["n"] if sizes else 0
    dense = dense.filter(F.size("vec") == dim)
    keyed = dense.withColumn("key", F.unhex(F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").cast("binary"))))
    members = cut(keyed.select("key", "vec_id").distinct())
    first = Window.partitionBy("key").orderBy("vec_id")
    least = cut(members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= s.k + 1))
    entries = cut(keyed.join(least.filter("n = 1").select("key", "vec_id"), ["key", "vec_id"], "left_semi").dropDuplicates(["key"]).select("key", "vec"))
    queries = cut(members.filter(is_query).select("key", F.col("vec_id").alias("query_id")))

    n = entries.count()
    lists = int(min(max(n // s.list_size, 1), s.most_lists, max(min(n, s.sample), 1)))
    sample = _matrix(entries.orderBy(F.xxhash64("key"), "key").limit(s.sample).select("vec").toArrow()["vec"].combine_chunks())
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c = fit(_unit(sample), lists, s.rounds)

    posted = cut(entries.mapInArrow(_post(c, s), "list int, key binary, vec array<double>"))
    asked = cut(entries.join(queries.select("key").distinct(), "key", "left_semi").mapInArrow(_probe(c, s, *probes(entries, queries, c, s)), "list int, key binary, vec array<double>"))
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / s.part).cast("int").alias(name))
    plan = F.broadcast(parts(posted, "np").join(parts(asked, "nq"), "list"))  # at most most_lists rows
    dealt = lambda df, own: df.join(plan, "list").withColumn(own, F.pmod(F.xxhash64("key"), F.col({"p": "np", "q": "nq"}[own])).cast("int"))
    left = dealt(asked, "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("np") - 1))).select("list", "p", "q", "key", "vec")
    right = dealt(posted, "p").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("list", "p", "q", "key", "vec")
    by = ["list", "p", "q"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_score(s), "q binary, key binary, score double")
    near = near.groupBy("q", "key").agg(F.max("score").alias("score"))
    near = near.join(least.filter("n = 1").select("key", F.col("vec_id").alias("lowest")), "key")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "lowest")
    near = near.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= s.k)
    own = entries.join(queries.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("q"), "key", F.expr(
        "aggregate(vec, 0D, (a, x) -> a + x * x)").alias("d")).select("q", "key", F.expr("d / (sqrt(d) * sqrt(d))").alias("score"))
    found = near.select("q", "key", "score").union(own).join(least.select("key", "vec_id"), "key").select("q", "vec_id", "score")
    # A class of equal queries shares its candidates; each leaves itself out.
    short = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(short)).filter(F.col("r") <= s.k + 1)
    each = queries.withColumnRenamed("key", "q").join(found, "q").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
