"""Set-similarity join of documents on word n-grams by partitioning the universe.

Sets whose sizes lie in the same or in adjacent size bands are compared under one
scheme. A scheme deals the universe of shingles into ``m`` segments by hash. Two
linked sets differ in at most H shingles, hence in at most H segments, so a set with
more than H non-empty segments agrees with its partner on one of them: the hash of a
segment's subset is a signature. Allocation gives each set H + 1 segments (value 1),
the cheapest first by a cost estimated on a bounded sample (common subsets last), and
none to the rest (value 0). As all sets follow one order, the first H + 1 of both
partners meet. Sets with too few non-empty segments index every subset together with
its one-deletion neighbourhood (value 2); where even that is too little, every shingle.

Signatures travel packed, one row per batch and bucket. Sets that meet are compared
with the least set of their meeting point first; once these links have formed
components, only pairs across components are left to compare. Pairs whose
sizes or parity bitmaps show too large a difference go first; every link is verified on the
full sets of 64-bit shingle hashes. Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import BLOCK_BYTES, SPACES, U, Block, blocks, bound_batches, constants, hand_back, mix, runs, words
from gridspark.llm.links import components
from gridspark.session import cut


@dataclass(frozen=True)
class Settings:
    n: int = 5  # words a shingle
    num: int = 75  # linked if den * |intersection| >= num * |union|
    den: int = 100
    sample: int = 8_000  # documents whose signatures set the costs
    common: int = 65_536  # most signatures with a known cost
    docs_per_bucket: int = 1_024
    small: int = 500_000  # rows (of 8 bytes) up to which a list of ids is sent to all tasks


FEW = 6  # points of a set that are looked up to compare a pair once


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their bounds."""
    w = words(block, SPACES)
    count = np.diff(w.bounds)
    h = runs(w.hash, n, 5)
    if len(h):
        h = h[w.doc[: len(h)] == w.doc[n - 1:]]
    many = np.maximum(count - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(many)])
    parts, sizes = [], np.zeros(len(block), np.int64)
    c = constants(n, 7)
    for i in range(len(block)):
        if many[i]:
            s = np.sort(h[ends[i]: ends[i + 1]])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif count[i]:
            with np.errstate(over="ignore"):
                s = mix(np.array([(w.hash[w.bounds[i]: w.bounds[i + 1]] * c[: count[i]]).sum() + U(count[i])], U))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit name for each set (0 for the empty one), from its members and its size."""
    sizes = np.diff(bounds)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat), dtype=U)])
    with np.errstate(over="ignore"):
        return np.where(sizes > 0, mix((total[bounds[1:]] - total[bounds[:-1]]) + sizes.astype(U) * U(0x9E3779B97F4A7C15)) >> U(1), U(0)).astype(np.int64)


def parity(members: np.ndarray, s: Settings) -> bytes:
    """Which cells hold an odd number of the set's shingles.

    Two sets differ in at least as many shingles as their parities in cells, however far both are
    folded. Sixteen cells for each shingle that may differ leave few chances to hide a difference.
    """
    cells = 64
    while cells < 16 * differ(len(members), len(members), s.num, s.den):
        cells *= 2
    odd = np.bincount((mix(members ^ U(0x0F0F0F0F0F0F0F0F)) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Cells in which two parities differ, the larger one folded to the size of the smaller."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)).sum())


@lru_cache
def band_edges(num: int, den: int, top: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < top:
        edges.append(edges[-1] * den // num + 1)
    return np.array(edges)


def differ(a: int, b: int, num: int, den: int) -> int:
    """Most shingles by which linked sets of these sizes can differ, never less for larger sets."""
    return (a + b) * (den - num) // (den + num)


def segments(band: int, s: Settings) -> int:
    top = int(band_edges(s.num, s.den)[band + 1]) - 1
    h = differ(top, top * s.den // s.num, s.num, s.den)
    return (8 if top < 64 else 2) * (h + 1)


def signatures(members: np.ndarray, s: Settings, common: np.ndarray) -> np.ndarray:
    """All signatures that one set is indexed under."""
    n, edges = len(members), band_edges(s.num, s.den)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    spread = mix(members ^ U(0xA5A5A5A5A5A5A5A5))
    plans = [(own, differ(n, n * s.den // s.num, s.num, s.den))]
    if own:
        partner = int(edges[own]) - 1  # the largest of the band below
        if partner * s.den // s.num >= n:
            plans.append((own - 1, differ(n, partner, s.num, s.den)))
    out = []
    for band, h in plans:
        m = segments(band, s)
        seg = ((spread >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        at = seg[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        with np.errstate(over="ignore"):
            tag = (U(band) << U(48)) + at[first].astype(U) * U(0x9E3779B97F4A7C15)
            whole = np.add.reduceat(spread[order], first)
            exact = mix(whole + tag)
        if len(exact) > h:
            if len(exact) > h + 1:
                costly = common[np.minimum(np.searchsorted(common, exact), len(common) - 1)] == exact if len(common) else np.zeros(len(exact), bool)
                exact = exact[np.lexsort((exact, costly))[: h + 1]]
            out.append(exact)
            continue
        size = np.diff(np.append(first, n))
        with np.errstate(over="ignore"):
            less = np.repeat(whole + tag, size) - spread[order]
            less = less[np.repeat(size > 1, size)]
            out += [exact, mix((whole + tag) ^ U(0x5555)), mix(less ^ U(0x5555))]
            if len(size) + int((size > 1).sum()) <= h:
                out.append(mix(spread + (U(band) << U(48)) + U(0x33)))
    return np.concatenate(out)


def _common(documents: DataFrame, total: int, s: Settings) -> np.ndarray:
    """Sorted signatures that several sampled sets share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = Settings(s.n, s.num, s.den)
        for batch in batches:
            for b in blocks(batch.column(0)):
                flat, at = shingle_sets(b, s.n)
                ids = set_ids(flat, at)
                for i in np.unique(ids, return_index=True)[1]:
                    if ids[i]:
                        sig = np.unique(_every(flat[at[i]: at[i + 1]], free)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.full(len(sig), ids[i]))], ["sig", "sid"])

    if total <= 0:
        return np.zeros(0, U)
    part = documents.select("text").sample(min(1.0, s.sample / total), 7) if total > s.sample else documents.select("text")
    seen = part.mapInArrow(count, "sig long, sid long").distinct().groupBy("sig").count().filter("count >= 4")
    rows = seen.orderBy(F.desc("count"), "sig").limit(s.common).select("sig").toArrow()["sig"].to_numpy()
    return np.sort(rows.view(U))


def _every(members: np.ndarray, s: Settings) -> np.ndarray:
    """The exact signatures of all non-empty segments in both schemes."""
    n, edges = len(members), band_edges(s.num, s.den)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    spread = mix(members ^ U(0xA5A5A5A5A5A5A5A5))
    out = []
    for band in {own, max(own - 1, 0)}:
        seg = ((spread >> U(32)) * U(segments(band, s)) >> U(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        at = seg[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        with np.errstate(over="ignore"):
            out.append(mix(np.add.reduceat(spread[order], first) + (U(band) << U(48)) + at[first].astype(U) * U(0x9E3779B97F4A7C15)))
    return np.concatenate(out)


def _emit(buckets: int, s: Settings, common: np.ndarray):
    bits = int(buckets).bit_length() - 1
    names = ["bucket", "sigs", "sids", "ids", "tks", "sizes", "parities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hand_back()  # what earlier stages and batches left in the worker
            for b in blocks(batch.column(2)):
                flat, at = shingle_sets(b, s.n)
                sids, sizes = set_ids(flat, at), np.diff(at)
                ids, tks = (batch.column(k).slice(b.first, len(b)).to_pylist() for k in (0, 1))
                sigs, owner = [], []
                bits_of: list = [None] * len(b)
                for i in np.unique(sids, return_index=True)[1]:  # equal sets of a block are indexed once
                    if sids[i]:
                        x = signatures(flat[at[i]: at[i + 1]], s, common)
                        sigs.append(x)
                        owner.append(np.full(len(x), sids[i]))
                        bits_of[i] = parity(flat[at[i]: at[i + 1]], s)
                rows: list[tuple] = [(int(abs(int(sids.sum()))) % buckets, None, sids.tobytes(), ids, tks, sizes.tobytes(), bits_of)]
                if sigs:
                    sig, own = np.concatenate(sigs), np.concatenate(owner)
                    order = np.argsort(sig)
                    sig, own = sig[order], own[order]
                    to = (sig >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
                    cuts = np.searchsorted(to, np.arange(buckets + 1))
                    low = ((sig << U(bits)) >> U(32)).astype(np.uint32)
                    rows += [(k, low[x:y].tobytes(), own[x:y].tobytes(), None, None, None, None) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()),
                    pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.list_(pa.binary()))], names)
        hand_back()  # the worker waits for its next task

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: documents (kind 0: id, set, size), pairs to verify (kind 1) and meeting points of three or more (kind 2)."""
    hand_back()
    kind, a, b, n, tk, bits = [], [], [], [], [], []

    def add(k: int, x, y, z, t=None, p=None) -> None:
        kind.append(np.full(len(y), k, np.int32))
        a.append(x if isinstance(x, pa.Array) else pa.array(x, pa.int64()))
        b.append(y)
        n.append(z)
        tk.append(pa.array(t, pa.int64()) if t else pa.nulls(len(y), pa.int64()))
        bits.append(pa.array(p, pa.binary()) if p else pa.nulls(len(y), pa.binary()))

    bucket = table.column("bucket")[0].as_py()
    blob = {c: table.column(c).to_pylist() for c in ("sigs", "sids", "sizes")}
    for i, sizes in enumerate(blob["sizes"]):
        if sizes is not None:
            sids = np.frombuffer(blob["sids"][i], np.int64)
            add(0, pa.array(table.column("ids")[i].as_py(), pa.int64()), sids, np.frombuffer(sizes, np.int64), table.column("tks")[i].as_py(), table.column("parities")[i].as_py())
    has = [i for i, x in enumerate(blob["sigs"]) if x is not None]
    if has:
        sig = np.concatenate([np.frombuffer(blob["sigs"][i], np.uint32) for i in has])
        sid = np.concatenate([np.frombuffer(blob["sids"][i], np.int64) for i in has])
        # Signatures of one set only are most of them: drop those before the full sort.
        order = np.argsort(sig, kind="stable")
        sig, sid = sig[order], sid[order]
        same = sig[1:] == sig[:-1]
        near = np.zeros(len(sig), bool)
        near[1:] |= same
        near[:-1] |= same
        sig, sid = sig[near], sid[near]
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        if len(sig):
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])])
            sig, sid = sig[new], sid[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(first, len(sig)))
            center = np.repeat(sid[first], size)
            other = np.repeat(size > 1, size)
            other[first] = False
            pairs = np.unique(np.stack([center[other], sid[other]], 1), axis=0)
            add(1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            wide = np.repeat(size > 2, size)
            add(2, (np.int64(bucket) << 32) | sig[wide].astype(np.int64), sid[wide], np.zeros(int(wide.sum()), np.int64))
    return pa.table({
        "kind": pa.array(np.concatenate(kind) if kind else [], pa.int32()), "a": pa.chunked_array(a, pa.int64()),
        "b": pa.array(np.concatenate(b) if b else [], pa.int64()), "n": pa.array(np.concatenate(n) if n else [], pa.int64()),
        "tk": pa.chunked_array(tk, pa.int64()), "bits": pa.chunked_array(bits, pa.binary())})


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK_BYTES // 2):
                flat, at = shingle_sets(b, s.n)
                ids = set_ids(flat, at)
                pick = [i for i in np.unique(ids, return_index=True)[1] if ids[i]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[pick], pa.int64()), pa.array([flat[at[i]: at[i + 1]].tobytes() for i in pick], pa.binary())], ["sid", "members"])
        hand_back()  # the worker waits for its next task

    return run


def _likely(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = [apart(x, y) <= differ(int(a), int(b), s.num, s.den) for a, b, x, y in zip(*sizes, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        hand_back()

    return run


def _across(s: Settings):
    """Pairs of one meeting point and of two components that sizes and parities leave open.

    ``low`` holds the first few points of each set: where two sets share an earlier one, they are compared there.
    """

    def run(table: pa.Table) -> pa.Table:
        hand_back()
        point, sid, part, n = (table[c].to_numpy() for c in ("point", "sid", "part", "n"))
        bits = table["bits"].to_pylist()
        low = np.full((len(sid), FEW), np.iinfo(np.int64).max)
        for i, x in enumerate(table["low"].to_pylist()):
            low[i, : len(x)] = x
        order = np.lexsort((sid, point))
        first = np.flatnonzero(np.concatenate([[True], point[order][1:] != point[order][:-1]]))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o in np.split(order, first[1:]):
            width = min(len(bits[i]) for i in o)
            cells = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint8).reshape(-1, width), 0) for i in o]).view(np.uint64)
            size, of, name = n[o], part[o], sid[o]
            # A small group is compared at once, a large one row by row.
            step = len(o) if len(o) <= 128 else 1
            for i in range(0, len(o) - 1, step):
                x, y = np.triu_indices(len(o), 1) if step > 1 else (np.full(len(o) - 1 - i, i), np.arange(i + 1, len(o)))
                ok = np.flatnonzero((of[x] != of[y]) & (np.minimum(size[x], size[y]) * s.den >= np.maximum(size[x], size[y]) * s.num))
                if len(ok):
                    x, y = x[ok], y[ok]
                    most = (size[x] + size[y]) * (s.den - s.num) // (s.den + s.num)
                    ok = np.bitwise_count(cells[x] ^ cells[y]).sum(1, dtype=np.int64) <= most
                    x, y = x[ok], y[ok]
                    a, b = low[o[x]][:, :, None], low[o[y]][:, None, :]
                    ok = ~((a == b) & (a < point[o[0]])).any((1, 2))
                    us.append(name[x[ok]])
                    vs.append(name[y[ok]])
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return run


def _verify(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                ok = len(p) * s.den >= len(q) * s.num
                if ok:
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    ok = s.den * both >= s.num * (len(p) + len(q) - both)
                keep.append(ok)
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
            yield kept
        hand_back()

    return run


def join(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc_id long, text) -> (sets, links), both stored.

    ``sets``: doc_id, tk (hash of the text), sid, n_shingles, one row per row of ``documents``; sid names the set, equal
    sets have equal sids, 0 is the empty set (null, empty or blank text), which links with nothing.
    ``links``: u, v, verified links between different sets that hold all their components together:
    of the pairs inside a component that is joined already, not each one is compared.
    """
    s = settings
    bound_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    total = documents.count()
    buckets = 1 << max(4, (total // s.docs_per_bucket).bit_length())
    common = _common(documents, total, s)
    packed = documents.mapInArrow(_emit(buckets, s, common), "bucket int, sigs binary, sids binary, ids array<long>, tks array<long>, sizes binary, parities array<binary>")
    met = cut(packed.groupBy("bucket").applyInArrow(_meet, "kind int, a long, b long, n long, tk long, bits binary"))
    sets = met.filter("kind = 0").select(F.col("a").alias("doc_id"), "tk", F.col("b").alias("sid"), F.col("n").alias("n_shingles"))
    stars = cut(met.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    points = met.filter("kind = 2").select(F.col("a").alias("point"), F.col("b").alias("sid"))

    marks = cut(met.filter("kind = 0 and bits is not null").groupBy("b").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).withColumnRenamed("b", "sid"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and parities leave open."""
        x = marks.select(F.col("sid").alias("u"), F.col("n").alias("nx"), F.col("bits").alias("x"))
        y = marks.select(F.col("sid").alias("v"), F.col("n").alias("ny"), F.col("bits").alias("y"))
        sized = pairs.join(x, "u").join(y, "v").filter(F.least("nx", "ny") * s.den >= F.greatest("nx", "ny") * s.num)
        return sized.select("u", "v", "nx", "ny", "x", "y").mapInArrow(_likely(s), "u long, v long")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("sid")).union(pairs.select(F.col("v").alias("sid"))).distinct()
        one = cut(sets.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("_id")).select("_id").distinct())
        if one.count() <= s.small:
            one = F.broadcast(one)
        texts = documents.join(one, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        members = texts.mapInArrow(_sets(s), "sid long, members binary").join(wanted, "sid", "left_semi").dropDuplicates(["sid"])
        members = cut(members)
        x = members.select(F.col("sid").alias("u"), F.col("members").alias("x"))
        y = members.select(F.col("sid").alias("v"), F.col("members").alias("y"))
        return pairs.join(y, "v").join(x, "u").select("u", "v", "x", "y").mapInArrow(_verify(s), "u long, v long")

    first = cut(verified(cut(likely(stars))))
    label = components(first)
    known = points.join(label.withColumnRenamed("u", "sid"), "sid", "left").select("point", "sid", F.coalesce("v", "sid").alias("part"))
    split = known.groupBy("point").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("point")
    rest = known.join(split, "point", "left_semi")
    # Open pairs are told apart where their members meet, so that none travels that sizes and parities rule out.
    low = rest.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("point")), 1, FEW).alias("low"))  # a set has few points
    met_with = rest.join(low, "sid").join(marks, "sid").select((F.xxhash64("point") % buckets).alias("deal"), "point", "sid", "part", "n", "bits", "low")
    open_ = met_with.groupBy("deal").applyInArrow(_across(s), "u long, v long").distinct()
    pairs = cut(open_.join(stars, ["u", "v"], "left_anti"))
    links = cut(verified(pairs).union(first))
    return sets, links


def classes(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, tk, sid, n_shingles, part, component_id for every row of ``documents``.

    component_id is the smallest doc_id of the component (null if all ids in it are null); a
    document without words is its own component. Rows that repeat an id get one row each.
    """
    sets, links = join(documents, settings)
    label = components(links)
    named = sets.join(label.withColumnRenamed("u", "sid"), "sid", "left").select("doc_id", "tk", "sid", "n_shingles", F.coalesce("v", "sid").alias("part"))
    least = named.filter("sid <> 0").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "part", "left").select(
        "doc_id", "tk", "sid", "n_shingles", "part", F.when(F.col("sid") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``documents`` with one row of each component: that of the least (doc_id, tk), null ids last.

    Rows without words stay. Of rows that agree in id and text one stays, whichever it is.
    """
    named = cut(classes(documents, settings).filter("sid <> 0").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.col("tk").alias("_tk"), "part"))
    first = named.groupBy("part").agg(F.min(F.struct("_id", "_tk")).alias("lo"))
    rest = cut(named.join(first, "part").filter("struct(_id, _tk) <> lo").select("_id", "_tk").distinct())
    twice = cut(named.groupBy("_id", "_tk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id", "_tk"))
    repeated = twice.count()
    rest, twice = (F.broadcast(x) if n <= settings.small // 4 else x for x, n in ((rest, rest.count()), (twice, repeated)))
    keyed = documents.withColumn("_key", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("tk")))
    same = (F.col("_key.id") == F.col("_id")) & (F.col("_key.tk") == F.col("_tk"))
    left = keyed.join(rest, same, "left_anti")
    if not repeated:  # the texts are read once
        return left.select(documents.columns)
    single, several = left.join(twice, same, "left_anti"), left.join(twice, same, "left_semi").dropDuplicates(["_key"])
    return single.union(several).select(documents.columns)
