"""Vector code compression: four parts a vector, each replaced by the nearest entry of its codebook.

Components become whole numbers, so every distance, sum and floor is exact and the same on any
partitioning. Training reads the distinct parts with their counts. They are packed so that bytes
order like components, dealt by ranges of that order and stored, so a task holds parts that share
long prefixes. They form a trie: a node stands for the components up to a dimension and carries its
distances to all entries up to there, which all parts below it share. It is walked depth-first over
the sorted parts; at a leaf the nearest entry is the argmin, and the part's components times its
count join the sums of that entry. Only these sums, entries times components, reach the driver.

A branch with one part left is not walked step by step: its remaining components are taken at once,
together with the other such branches of its node. Children of a node are taken a few at a time, so
memory is bounded by depth times the width of such a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut

#: Largest absolute component: sums of squared differences of a vector stay within 64 bits.
MOST = 1 << 27


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    #: At most 256, as a code has two hex digits a part.
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    #: Children of a trie node, or single branches, that are handled at once.
    slice: int = 512


def whole(vectors: pa.Array, dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as int64, padded to equal parts)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, offsets = vectors.values, np.array(vectors.offsets)
    length = np.diff(offsets)
    x = np.array(flat.cast(pa.float64()).fill_null(np.nan))
    good = np.isfinite(x)
    ok = (length == dim) & np.array(vectors.is_valid())
    bad = np.concatenate([[0], np.cumsum(~good)])
    ok &= bad[offsets[1:]] == bad[offsets[:-1]]
    at = np.flatnonzero(ok)
    out = np.zeros((len(at), -(-dim // s.parts) * s.parts), np.int64)
    if dim and len(at):
        out[:, :dim] = np.clip(np.floor(s.scale * x[offsets[at][:, None] + np.arange(dim)]), -MOST, MOST).astype(np.int64)
    return at, out


def keys(parts: np.ndarray) -> np.ndarray:
    """Rows of int64 components as byte strings that order like them."""
    return np.ascontiguousarray((parts + (1 << 31)).astype(">u4")).view(f"V{4 * parts.shape[1]}")[:, 0] if parts.shape[1] else np.zeros(len(parts), "V1")


def components(packed: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), ">u4").astype(np.int64).reshape(len(packed), width) - (1 << 31) if width else np.zeros((len(packed), 0), np.int64)


def walk(rows: np.ndarray, book: np.ndarray, found: Callable[[np.ndarray, np.ndarray, np.ndarray], None], width: int = 512) -> int:
    """Depth-first over the trie of ``rows``, which are distinct and sorted.

    ``found(places, nearest entries, distances)`` is called at leaves. Returns how many times a
    node's distances were made, of ``rows.size`` without sharing.
    """
    depth, made = rows.shape[1], 0

    def leaves(at: np.ndarray, level: int, shared: np.ndarray) -> None:
        """Single branches below one node: the components from ``level`` on at once."""
        for i in range(0, len(at), width):
            part = at[i:i + width]
            d = np.repeat(shared[None], len(part), 0)
            for j in range(level, depth):
                d += (rows[part, j, None] - book[None, :, j]) ** 2
            near = d.argmin(1)  # the first of equal ones
            found(part, near, d[np.arange(len(part)), near])

    stack = [(0, len(rows), 0, np.zeros(len(book), np.int64))] if len(rows) else []
    while stack:
        lo, hi, level, shared = stack.pop()
        if level == depth or hi - lo == 1:
            made += depth - level
            leaves(np.arange(lo, hi), level, shared)
            continue
        column = rows[lo:hi, level]
        heads = lo + np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        ends = np.append(heads[1:], hi)
        if len(heads) > width:  # the other children wait under the same node
            stack.append((int(heads[width]), hi, level, shared))
            heads, ends = heads[:width], ends[:width]
        single = ends - heads == 1
        if single.any():
            made += int(single.sum()) * (depth - level)
            leaves(heads[single], level, shared)
        heads, ends = heads[~single], ends[~single]
        made += len(heads)
        values = shared[None] + (rows[heads, level, None] - book[None, :, level]) ** 2
        stack += [(int(heads[i]), int(ends[i]), level + 1, values[i]) for i in reversed(range(len(heads)))]
    return made


def _parts(dim: int, s: Settings):
    """Vectors -> part, packed, n: the distinct parts of a batch and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch.column(0), dim, s)
            for p, cut_ in enumerate(np.split(x, s.parts, 1)):
                key, n = np.unique(keys(cut_), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(key), p, np.int32)), pa.array([k.tobytes() for k in key], pa.binary()), pa.array(n.astype(np.int64))], ["part", "packed", "n"])

    return run


def _sums(books: np.ndarray, s: Settings):
    """Distinct parts -> part, entry, n, sums: what each entry's parts add up to, once per task."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            part, weight = np.array(batch.column(0)), np.array(batch.column(2))
            rows = components(batch.column(1).to_pylist(), width)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)  # sorted, as the stored parts are

                def add(places, near, _, at=at, p=p):
                    order = near.argsort(kind="stable")
                    entry, head = np.unique(near[order], return_index=True)
                    times = weight[at[places[order]]]
                    n[p, entry] += np.add.reduceat(times, head)
                    sums[p, entry] += np.add.reduceat(rows[at[places[order]]] * times[:, None], head)

                walk(rows[at], books[p], add, s.slice)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, dim: int, s: Settings):
    """Vectors -> row columns, code, error: every kept row's final entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(2), dim, s)
            code, error = np.zeros((len(at), s.parts), np.uint8), np.zeros(len(at), np.int64)
            for p, cut_ in enumerate(np.split(x, s.parts, 1)):
                _, first, back = np.unique(keys(cut_), return_index=True, return_inverse=True)
                near, far = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)

                def note(places, entries, distances, near=near, far=far):
                    near[places], far[places] = entries, distances

                walk(cut_[first], books[p], note, s.slice)
                code[:, p], error = near[back], error + far[back]
            hexed = [c.tobytes().hex() for c in code]
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(hexed, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The most common length of the vectors that hold numbers only, the longer one of equally common."""
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    row = vectors.filter(good).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return None if row is None else row["n"]


def _first_vectors(vectors: DataFrame, dim: int, s: Settings) -> np.ndarray:
    """The vectors of the least ids, one an id (the least of several), as parts x entries x components."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(1), dim, s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([k.tobytes() for k in keys(x)], pa.binary())], ["vec_id", "packed"])

    least = vectors.filter("vec_id is not null").select("vec_id", "embedding").mapInArrow(kept, "vec_id long, packed binary")
    rows = least.groupBy("vec_id").agg(F.min("packed").alias("packed")).orderBy("vec_id").limit(s.entries).toArrow()
    width = -(-dim // s.parts) * s.parts
    return np.stack(np.split(components(rows["packed"].to_pylist(), width), s.parts, 1))


def train(vectors: DataFrame, dim: int, settings: Settings = Settings()) -> np.ndarray:
    """Codebooks (parts x entries x components) after all rounds; fewer entries where there are fewer ids."""
    s = settings
    books = _first_vectors(vectors, dim, s)
    if not books.shape[1]:
        return books
    # Ranges of whole keys: equal parts of all batches meet in one task, where they are summed.
    dealt = vectors.select("embedding").mapInArrow(_parts(dim, s), "part int, packed binary, n long").repartitionByRange("part", "packed")
    distinct = cut(dealt.groupBy("part", "packed").agg(F.sum("n").alias("n")).sortWithinPartitions("part", "packed"))
    for _ in range(s.rounds):
        got = distinct.mapInArrow(_sums(books, s), "part int, entry int, n long, sums array<long>")
        each = got.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
        p, e, j, n, v = (np.array(c.combine_chunks()) for c in each.columns)
        books = books.copy()
        books[p, e, j] = v // n
    return books


def compress(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks: every row of ``vectors`` that is kept.

    ``vectors``: vec_id, embedding, label; other columns are not read. Dropped are null vectors, those
    that hold null or non-finite components, and those of another length than the most common one; a
    length that the parts do not divide is filled up with zeros. Components are floor(scale * x), held
    within 2 ** 27 so that distances fit 64 bits. The codebooks start from the least vec_ids (a null id
    is coded but starts no entry; of several rows of an id the least vector does). Of equal distances
    the first entry wins, entries without parts stay. Repeated rows count each and are coded each.
    ``label_error`` sums errors over equal labels, nulls together. Without a usable id or row the
    result is empty. ``codebooks``: all components, by part, entry and place, as text.
    """
    s = settings
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    dim = dimension(vectors)
    kind = vectors.schema["label"].dataType.simpleString()
    books = train(vectors, dim, s) if dim is not None else np.zeros((s.parts, 0, 0), np.int64)
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks string")
    coded = cut(vectors.select("vec_id", "label", "embedding").mapInArrow(_codes(books, dim, s), f"vec_id long, label {kind}, code string, error long"))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    text = ",".join(map(str, books.ravel().tolist()))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(text).alias("codebooks"))
