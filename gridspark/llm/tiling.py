"""Benchmark decontamination by greedy string tiling.

Seeds (runs of ``seed`` tokens) of the benchmark fill a filter of fixed size that goes to
every task. Documents keep only the stretches whose seeds pass it; these few are joined with
the benchmark's seeds exactly. For each document and item that share enough seeds, running
Karp-Rabin matching looks for long common stretches first: at each search length the windows
of the item and of the stretches are hashed, matches are grown to their full length, the
longest are marked where they overlap no earlier tile, and the length shrinks down to the
seed. The share of the item under tiles is its coverage, whatever order the parts come in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import MARKS, U, blocks, bound_batches, mix, runs, words


@dataclass(frozen=True)
class Settings:
    seed: int = 5  # tokens of the shortest tile
    coverage: float = 0.5  # share of an item's tokens under tiles
    first_length: int = 20  # first search length
    filter_bits: int = 22  # log2 of the filter's size


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _window_hashes(tokens: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of the windows of ``s`` unmarked tokens, rolled along."""
    top, h, run = pow(_BASE, s - 1, _PRIME), 0, 0
    for i, t in enumerate(tokens):
        if not free[i]:
            h, run = 0, 0
            continue
        if run == s:
            h = (h - tokens[i - s] * top) % _PRIME
            run -= 1
        h = (h * _BASE + t) % _PRIME
        run += 1
        if run == s:
            yield i - s + 1, h


def tile(doc: list[int], item: list[int], shortest: int, first_length: int = 20) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length), none overlapping another in either sequence."""
    free_d, free_t = [True] * len(doc), [True] * len(item)
    tiles: list[tuple[int, int, int]] = []
    s = max(shortest, min(first_length, len(item)))
    while True:
        table: dict[int, list[int]] = {}
        for j, h in _window_hashes(item, free_t, s):
            table.setdefault(h, []).append(j)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for i, h in _window_hashes(doc, free_d, s):
            for j in table.get(h, ()):
                if i and j and free_d[i - 1] and free_t[j - 1] and doc[i - 1] == item[j - 1] and s == shortest:
                    continue  # part of a match that began one earlier
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_t[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= s:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[2], m[1])):
            if all(free_d[i: i + n]) and all(free_t[j: j + n]):
                free_d[i: i + n] = [False] * n
                free_t[j: j + n] = [False] * n
                tiles.append((i, j, n))
        if s == shortest:
            # What an earlier tile cut short may still hold a shorter match.
            if not any(n >= s for n, _, _ in found) or not tiles or not _again(found, free_d, free_t, s):
                return tiles
        else:
            s = max(shortest, s // 2)


def _again(found: list[tuple[int, int, int]], free_d: list[bool], free_t: list[bool], s: int) -> bool:
    """Whether some match still has ``s`` tokens in a row that are free on both sides."""
    for n, i, j in found:
        run = 0
        for k in range(n):
            run = run + 1 if free_d[i + k] and free_t[j + k] else 0
            if run == s:
                return True
    return False


def _items(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                w = words(b, MARKS)
                for i in range(len(b)):
                    code = w.hash[w.bounds[i]: w.bounds[i + 1]]
                    if len(code) >= s.seed:
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).slice(b.first + i, 1), batch.column(1).slice(b.first + i, 1),
                            pa.array([code.view(np.int64)]), pa.array([np.unique(runs(code, s.seed, 31)).view(np.int64)])],
                            ["item_id", "ik", "item", "seeds"])

    return run


def _stretches(s: Settings, sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for b in blocks(batch.column(2)):
                w = words(b, MARKS)
                code = runs(w.hash, s.seed, 31)
                if not len(code):
                    continue
                low = (code & U((1 << s.filter_bits) - 1)).astype(np.int64)
                hit = np.flatnonzero((sieve[low >> 6] >> (low & 63).astype(U)) & U(1) & (w.doc[: len(code)] == w.doc[s.seed - 1:]))
                if not len(hit):
                    continue
                for group in np.split(hit, np.flatnonzero(np.diff(w.doc[hit])) + 1):
                    parts = []
                    for g in np.split(group, np.flatnonzero(np.diff(group) > 1) + 1):
                        parts += [w.hash[g[0]: g[-1] + s.seed], np.zeros(1, U)]  # 0 keeps stretches apart
                    rows[0].append(b.first + int(w.doc[group[0]]))
                    rows[1].append(np.concatenate(parts).view(np.int64))
                    rows[2].append(np.unique(code[group]).view(np.int64))
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.int64()))],
                ["doc_id", "dk", "stretch", "seeds"])

    return run


def _tile(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tiles, covered = [], [], []
            for doc, item in zip(batch.column(4), batch.column(5), strict=True):
                item = item.as_py()
                found = tile(doc.as_py(), item, s.seed, s.first_length)
                n.append(len(item))
                tiles.append(len(found))
                covered.append(sum(t[2] for t in found))
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n, pa.int64()), pa.array(tiles, pa.int64()), pa.array(covered, pa.int64())],
                ["doc_id", "dk", "item_id", "ik", "n_tokens", "n_tiles", "n_covered"])
            keep = np.array(covered, float) >= s.coverage * np.array(n, float)
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, dk, item_id, ik, n_tokens, n_tiles, n_covered of documents that hold an item.

    dk and ik are hashes of the texts: rows that share an id but not the text are judged apart,
    repeated rows once. Tokens are runs of digits, letters and non-ASCII characters after
    lower-casing A-Z. Items of fewer tokens than a seed, null and empty texts match nothing. Null
    ids are ids like others.
    """
    s = settings
    bound_batches(documents.sparkSession)
    slim = lambda df, i, k: df.select(F.col(i), F.xxhash64("text").alias(k), F.coalesce("text", F.lit("")).alias("text"))
    items = slim(benchmark, "item_id", "ik").dropDuplicates(["item_id", "ik"]).mapInArrow(_items(s), "item_id long, ik long, item array<long>, seeds array<long>")
    seeds = items.select("item_id", "ik", F.size("item").alias("n"), F.explode("seeds").alias("seed"))
    low = F.col("seed").bitwiseAND((1 << s.filter_bits) - 1)
    filled = seeds.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()  # at most 2 ** filter_bits / 64 rows
    sieve = np.zeros(1 << max(s.filter_bits - 6, 0), U)
    sieve[filled["w"].to_numpy()] = filled["bits"].to_numpy().view(U)
    docs = slim(documents.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "dk").mapInArrow(
        _stretches(s, sieve), "doc_id long, dk long, stretch array<long>, seeds array<long>").dropDuplicates(["doc_id", "dk"])
    shared = docs.select("doc_id", "dk", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("doc_id", "dk", "item_id", "ik").agg(
        F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    # A tile of L tokens holds L - seed + 1 seeds, at least one for every ``seed`` tokens, but equal
    # seeds of an item count once: an item that repeats itself may need as few as one.
    shared = shared.filter("shared >= 1")
    a, b, c = shared.alias("a"), docs.alias("b"), items.alias("c")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    pairs = a.join(b, same("a.doc_id", "b.doc_id") & (F.col("a.dk") == F.col("b.dk"))).join(c, same("a.item_id", "c.item_id") & (F.col("a.ik") == F.col("c.ik")))
    return pairs.select("a.doc_id", "a.dk", "a.item_id", "a.ik", "b.stretch", "c.item").mapInArrow(
        _tile(s), "doc_id long, dk long, item_id long, ik long, n_tokens long, n_tiles long, n_covered long")
