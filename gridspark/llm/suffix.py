"""Substring dedup on suffix order, exact for every string of ``length`` bytes.

Equal texts are settled by their hashes. Of the rest, each window of ``length`` bytes is named by
the least hash among its grams (its minimizer). Runs of windows with one minimizer are counted
per shard of the hash range; runs whose minimizer no other document has are done. The few that
are left travel with their bytes to the shard of their minimizer, so equal windows meet in one
shard, and a shard sorts the suffixes of its distinct pieces by external induced sorting:

* the sample (leftmost S-type suffixes) is sorted by words of eight bytes;
* all L-type suffixes follow in one pass over the characters upwards, all S-type suffixes in one
  downwards. The priority queue of a pass is one queue for each character, as what it takes in
  comes in order; entries are (suffix, common prefix with the entry before), whole batches at a
  time, and go to disk beyond ``memory`` bytes;
* common prefixes are carried along as minima over what was passed since the queue's last entry.

Neighbours with a common prefix of at least ``length`` bytes form a class, and the least doc_id of
a class removes the window from all others. Windows never cross documents. Order beyond
``length`` bytes does not matter, so the sample needs no deeper recursion.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import BYTE_VALUE, U, Block, blocks, mix, powers
from gridspark.session import cut

LAST_ID = (1 << 63) - 1
STEP = 1 << 15  # windows hashed at a time


@dataclass(frozen=True)
class Settings:
    length: int = 50  # bytes of a string that counts
    gram: int = 20  # bytes of a hashed gram
    docs_per_bucket: int = 1_024
    memory: int = 64 << 20  # bytes of a queue pass kept in memory


# --- suffix order of one shard ---------------------------------------------------------------


class Queues:
    """One queue for each character; entries come in order. Beyond ``memory`` bytes the longest goes to disk."""

    def __init__(self, memory: int):
        self.parts: list[list] = [[] for _ in range(257)]
        self.size = np.zeros(257, np.int64)
        self.held, self.memory, self.file = 0, memory, None

    def put(self, c: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        self.parts[c].append((at, lcp))
        self.size[c] += at.nbytes + lcp.nbytes
        self.held += at.nbytes + lcp.nbytes
        while self.held > self.memory and self.size.max() > 0:
            self._spill(int(np.argmax(self.size)))

    def _spill(self, c: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # unnamed: gone with the task, whatever happens
        out = []
        for part in self.parts[c]:
            if isinstance(part[0], np.ndarray):
                at, lcp = part
                self.file.seek(0, 2)
                where = self.file.tell()
                self.file.write(at.tobytes() + lcp.tobytes())
                part = (where, len(at))
            out.append(part)
        self.parts[c] = out
        self.held -= int(self.size[c])
        self.size[c] = 0

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        at, lcp = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for part in self.parts[c]:
            if not isinstance(part[0], np.ndarray):
                where, n = part
                self.file.seek(where)
                raw = self.file.read(n * 9)
                part = (np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, n * 8))
            at.append(part[0])
            lcp.append(part[1])
        self.held -= int(self.size[c])
        self.size[c] = 0
        self.parts[c] = []
        return np.concatenate(at), np.concatenate(lcp)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Pass:
    """Sends the predecessors of scanned suffixes to their queues and carries common prefixes."""

    def __init__(self, text: np.ndarray, queues: Queues, cap: int):
        self.text, self.queues, self.cap = text.astype(np.uint8), queues, cap
        self.since = np.zeros(257, np.int64)  # least common prefix passed since a queue's last entry

    def bucket(self) -> None:
        self.since[:] = 0  # suffixes of another first character share nothing

    def scan(self, at: np.ndarray, lcp: np.ndarray, keep) -> None:
        """``at``: suffixes in scan order, ``lcp``: each with the one scanned before it."""
        if not len(at):
            return
        before = at - 1
        char = self.text[before]  # before the first one stands the 0 that closes the last piece
        pick = np.flatnonzero(keep(char))
        to = char[pick]
        order = np.argsort(to, kind="stable")
        pick, to = pick[order], to[order]
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        whole = int(lcp.min())
        last = self.since.copy()
        self.since = np.minimum(self.since, whole)
        for k, first in enumerate(edges):
            end = edges[k + 1] if k + 1 < len(edges) else len(pick)
            of, c = pick[first:end], int(to[first])
            # Minima from behind the queue's last entry up to this one.
            bounds = np.concatenate([[0], of[:-1] + 1])
            low = np.minimum.reduceat(lcp[: of[-1] + 1], bounds)
            low[0] = min(int(low[0]), int(last[c]))
            self.queues.put(c, before[of], np.minimum(low, self.cap - 1) + np.uint8(1))
            tail = lcp[of[-1] + 1:]
            self.since[c] = int(tail.min()) if len(tail) else 1 << 30


def _common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of two suffixes, within their pieces."""
    n = 0
    while n < cap and text[a + n] == text[b + n] and text[a + n]:
        n += 1
    return n


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words that differ by ``x``."""
    n = np.zeros(len(x), np.uint8)
    for k in range(8):
        n += x < U(1 << 8 * k)
    return n


def _sample_order(text: np.ndarray, star: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``star`` in order, and the common prefix of each with the one before.

    Words of eight characters are compared; what lies beyond the end of a piece is 0. Only suffixes that agree
    with a neighbour in a whole word are put in order by the next one.
    """
    ends = np.flatnonzero(text == 0)
    room = ends[np.searchsorted(ends, star)] - star
    padded = np.concatenate([text.astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    every = np.ndarray((len(text) + cap + 8,), ">u8", padded, strides=(1,))  # the word at each byte
    keep = np.array([0, *((0xFFFFFFFFFFFFFFFF << 8 * (8 - k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], U)
    lcp = np.zeros(len(star), np.uint16)
    star, where, group = star.copy(), np.arange(len(star)), None
    for done in range(0, cap, 8):
        if not len(where):
            break
        at, left = star[where], room[where]
        word = every[at + done].astype(U) & keep[np.clip(left - done, 0, 8)]
        order = np.argsort(word)
        if group is not None:  # by group, then by word
            rank = np.cumsum(np.concatenate([[False], word[order[1:]] != word[order[:-1]]]))
            order = order[np.argsort((group[order] << 32) | rank)]
        star[where], room[where], word = at[order], left[order], word[order]
        # Group numbers stand in order already, so sorting left them as they were.
        differs = word[1:] ^ word[:-1]
        near = np.ones(len(differs), bool) if group is None else group[1:] == group[:-1]
        width = _common_bytes(differs)
        same = near & (differs == 0)
        short = np.flatnonzero(same & ((word[1:] & U(0xFF)) == 0))  # a 0 ends the piece; what follows it does not count
        width[short] = np.minimum(left[order][1:][short] - done, 8)
        lcp[where[1:][near]] += width[near]
        same[short] = False
        going = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        group = np.cumsum(np.concatenate([[True], ~same]))[going]
        where = where[going]
    return star, np.minimum(lcp, cap).astype(np.uint8)


def suffix_order(text: np.ndarray, cap: int, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes, from the last to the first, as batches of (place, common prefix with the one before in this order).

    ``text``: characters 1 .. 255 (a byte of UTF-8 plus one), every piece closed by a 0. Common prefixes stop at the end of a piece
    and at ``cap``; suffixes that agree that far are in any order. Places of zeros are left out.
    """
    n = len(text)
    if not n:
        return
    heads = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])  # of equal characters
    rises = np.append(text[heads[1:]] > text[heads[:-1]], False)
    small = np.repeat(rises, np.diff(np.append(heads, n)))  # S-type: the next other character is larger
    small[text == 0] = True
    del heads, rises
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    star = star[text[star] != 0]
    ends = np.flatnonzero(text == 0)
    star, lcp = _sample_order(text, star, cap)
    first = text[star]
    top = int(text.max())
    starts = np.searchsorted(first, np.arange(top + 2))

    ups, lists = Queues(memory), Queues(memory)
    up = _Pass(text, ups, cap)
    up.bucket()
    # Ends of pieces share nothing: the suffixes before them are single characters.
    up.scan(ends, np.zeros(len(ends), np.uint8), lambda c: c > 0)
    for c in range(1, top + 1):
        up.bucket()
        last = -1
        while True:
            at, low = ups.take(c)
            if not len(at):
                break
            lists.put(c, at, low)
            last = int(at[-1])
            up.scan(at, low, lambda x: x >= c)
        x, y = starts[c], starts[c + 1]
        if y > x:
            low = lcp[x:y].copy()
            low[0] = _common(text, last, int(star[x]), cap) if last >= 0 else 0
            up.scan(star[x:y], low, lambda v: v > c)
    ups.close()
    del star, lcp

    downs = Queues(memory)
    down = _Pass(text, downs, cap)
    for c in range(top, 0, -1):
        down.bucket()
        last = -1
        while True:
            at, low = downs.take(c)
            if not len(at):
                break
            last = int(at[-1])
            yield at, low
            down.scan(at, low, lambda x: (x <= c) & (x > 0))
        at, low = lists.take(c)
        if len(at):
            back = np.zeros(len(at), np.uint8)
            back[1:] = low[:0:-1]
            at = at[::-1]
            back[0] = _common(text, last, int(at[0]), cap) if last >= 0 else 0
            yield at, back
            down.scan(at, back, lambda x: (x < c) & (x > 0))
    downs.close()
    lists.close()


# --- candidate runs ---------------------------------------------------------------------------


def _minimizers(data: np.ndarray, s: Settings) -> np.ndarray:
    """The least hash among the grams of each window, computed for as many windows at a time as the caches hold."""
    w, out = s.length - s.gram + 1, []
    for a in range(0, len(data) - s.length + 1, STEP):
        part = data[a: a + STEP + s.length - 1]
        n = len(part)
        with np.errstate(over="ignore"):
            c = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUE[part] * powers(n), dtype=U)])
            # Weights grow by one odd factor a byte; its inverse makes grams of all places comparable.
            low = mix((c[s.gram:] - c[: -s.gram]) * powers(n - s.gram + 1, inverse=True))
        have = 1
        while have < w:
            step = min(have, w - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        out.append(low)
    return np.concatenate(out)


def window_runs(block: Block, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: document, first window, last window (bytes in the document), minimizer."""
    none = np.zeros(0, np.int64)
    if len(block.data) < s.length:
        return none, none, none, np.zeros(0, U)
    low = _minimizers(block.data, s)
    m = len(low)
    new = np.ones(m, bool)
    new[1:] = low[1:] != low[:-1]
    new[block.offsets[block.offsets < m]] = True
    first = np.flatnonzero(new)
    doc = block.doc_of(first)
    # A run ends before the next one or where the document leaves no room for a window.
    end = np.minimum(np.append(first[1:], m) - 1, block.offsets[doc + 1] - s.length)
    inside = end >= first
    doc, first, end = doc[inside], first[inside], end[inside]
    return doc, first - block.offsets[doc], end - block.offsets[doc], low[first]


def _emit(buckets: int, s: Settings):
    bits = int(buckets).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's name is its partition and its number there: blocks of equal rows stay apart.
        task, block = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for b in blocks(batch.column(2)):
                doc, _, _, low = window_runs(b, s)
                if not len(doc):
                    continue
                head = np.searchsorted(doc, doc)
                ordinal = (np.arange(len(doc)) - head).astype(np.uint32)
                docs, local = np.unique(doc, return_inverse=True)
                rows = pa.array(docs + b.first)
                ids, tks = batch.column(0).take(rows), batch.column(1).take(rows)
                name, block = task | block, block + 1
                order = np.argsort(low)
                low, local, ordinal = low[order], local[order].astype(np.uint16), ordinal[order]
                to = (low >> U(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                code = ((low << U(bits)) >> U(32)).astype(np.uint32)
                out = [(name % buckets, name, None, None, None, ids.to_pylist(), tks.to_pylist())]
                out += [(k, name, code[x:y].tobytes(), local[x:y].tobytes(), ordinal[x:y].tobytes(), None, None) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "block", "code", "doc", "at", "ids", "tks"])

    return run


BLOCKS = "block long, doc binary, at binary, ids array<long>, tks array<long>"


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: what each block has of minimizers that two documents hold."""
    rows = {c: table[c].to_pylist() for c in table.column_names}
    out: list[tuple] = [(rows["block"][i], None, None, x, rows["tks"][i]) for i, x in enumerate(rows["ids"]) if x is not None]
    has = [i for i, x in enumerate(rows["code"]) if x is not None]
    if has:
        code = np.concatenate([np.frombuffer(rows["code"][i], np.uint32) for i in has])
        doc = np.concatenate([np.frombuffer(rows["doc"][i], np.uint16) for i in has])
        at = np.concatenate([np.frombuffer(rows["at"][i], np.uint32) for i in has])
        of = np.repeat(np.arange(len(has), dtype=np.int64), [len(rows["code"][i]) // 4 for i in has])
        order = np.argsort(code, kind="stable")
        sorted_ = code[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        owner = ((of << 16) | doc)[order]
        many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        keep = np.sort(order[np.repeat(many, np.diff(np.append(first, len(order))))])
        cuts = np.searchsorted(of[keep], np.arange(len(has) + 1))
        for k, i in enumerate(has):
            mine = keep[cuts[k]: cuts[k + 1]]
            if len(mine):
                out.append((rows["block"][i], doc[mine].tobytes(), at[mine].tobytes(), None, None))
    return _blocks(out)


def _blocks(out: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["block", "doc", "at", "ids", "tks"])


def _by_doc(table: pa.Table) -> pa.Table:
    """One block: the ordinals of the shared runs of each document."""
    none = pa.table({"id": pa.array([], pa.int64()), "tk": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
    rows = {c: table[c].to_pylist() for c in table.column_names}
    named = [i for i, x in enumerate(rows["ids"]) if x is not None]
    has = [i for i, x in enumerate(rows["doc"]) if x is not None]
    if not has or not named:
        return none
    ids, tks = rows["ids"][named[0]], rows["tks"][named[0]]
    doc = np.concatenate([np.frombuffer(rows["doc"][i], np.uint16) for i in has])
    at = np.concatenate([np.frombuffer(rows["at"][i], np.uint32) for i in has])
    pair = np.unique((doc.astype(np.int64) << 32) | at)
    doc, at = pair >> 32, (pair & 0xFFFFFFFF).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    parts = np.split(at, first[1:])
    return pa.table({"id": pa.array([ids[d] for d in doc[first]], pa.int64()), "tk": pa.array([tks[d] for d in doc[first]], pa.int64()),
                     "runs": pa.array([p.tobytes() for p in parts], pa.binary())})


def _pieces(shards: int, s: Settings):
    """Bytes of the shared runs, packed for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(3)):
                doc, start, end, low = window_runs(b, s)
                bounds = np.searchsorted(doc, np.arange(len(b) + 1))
                wanted = [bounds[i] + np.frombuffer(batch.column(2)[b.first + i].as_buffer(), np.uint32).astype(np.int64) for i in range(len(b))]
                pick = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
                if not len(pick):
                    continue
                doc, start, end, low = doc[pick], start[pick], end[pick], low[pick]
                size = end - start + s.length
                first = b.offsets[doc] + start
                # Equal pieces of a block travel once; 64-bit hashes name them.
                with np.errstate(over="ignore"):
                    c = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUE[b.data] * powers(len(b.data)), dtype=U)])
                    name = mix((c[first + size] - c[first]) * powers(len(b.data), inverse=True)[first] + low + size.astype(U))
                to = (mix(low) % U(shards)).astype(np.int64)
                order = np.lexsort((name, to))
                doc, start, size, first, to, name = (v[order] for v in (doc, start, size, first, to, name))
                new = np.concatenate([[True], (name[1:] != name[:-1]) | (to[1:] != to[:-1])])
                ids, tks = batch.column(0).to_numpy()[b.first:][doc], batch.column(1).to_numpy()[b.first:][doc]
                cuts = np.searchsorted(to, np.arange(shards + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)):
                    o = slice(cuts[k], cuts[k + 1])
                    one, z = first[o][new[o]], size[o][new[o]]
                    where = np.arange(int(z.sum())) + np.repeat(one - (np.cumsum(z) - z), z)
                    out.append((int(k), b.data[where].tobytes(), z.astype(np.uint32).tobytes(), (np.cumsum(new[o]) - 1).astype(np.uint32).tobytes(),
                                ids[o].tobytes(), tks[o].tobytes(), start[o].astype(np.uint32).tobytes()))
                kinds = (pa.int32(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "data", "size", "piece", "ids", "tks", "start"])

    return run


def _sort(s: Settings):
    """One shard: byte ranges of its windows that a smaller doc_id holds as well."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: b"".join(table[c].to_pylist()) for c in ("size", "piece", "ids", "tks", "start")}
        ids, tks = (np.frombuffer(col[c], np.int64) for c in ("ids", "tks"))
        own, piece, start = (np.frombuffer(col[c], np.uint32).astype(np.int64) for c in ("size", "piece", "start"))
        raw = b"".join(table["data"].to_pylist())
        per = [(len(a) // 4, len(b) // 4) for a, b in zip(table["size"].to_pylist(), table["piece"].to_pylist(), strict=True)]
        shift = np.repeat(np.cumsum([0] + [a for a, _ in per])[:-1], [b for _, b in per])
        first = np.cumsum(own) - own
        # Equal pieces are sorted once.
        seen: dict[bytes, int] = {}
        kind = np.fromiter((seen.setdefault(raw[a: a + z], len(seen)) for a, z in zip(first.tolist(), own.tolist(), strict=True)), np.int64, len(own))
        size, kind = own[piece + shift], kind[piece + shift]
        pieces = list(seen)
        least = np.full(len(pieces), LAST_ID)
        np.minimum.at(least, kind, ids)
        del seen, raw, first, own
        length = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
        begin = np.cumsum(length + 1) - (length + 1)
        stop = begin + length
        text[stop] = 0
        owner = np.repeat(np.arange(len(pieces)), length + 1)
        full = stop[owner] - np.arange(len(text)) >= s.length  # places where a whole window fits
        holds = np.where(full, least[owner], LAST_ID)
        best = np.full(len(text), LAST_ID)
        group_at: list[np.ndarray] = []

        def settle() -> None:
            if group_at:
                x = np.concatenate(group_at)
                if len(x):
                    best[x] = holds[x].min()
                group_at.clear()

        for at, lcp in suffix_order(text, s.length, s.memory):
            opens = lcp < s.length
            cutat = np.flatnonzero(opens)
            head = at[: cutat[0]] if len(cutat) else at
            group_at.append(head[full[head]])
            if not len(cutat):
                continue
            settle()
            # Whole classes inside the batch; the last may go on in the next one.
            body = at[cutat[0]: cutat[-1]]
            if len(body):
                edges = cutat[:-1] - cutat[0]
                low = np.minimum.reduceat(holds[body], edges)
                best[body] = np.repeat(low, np.diff(np.append(edges, len(body))))
            tail = at[cutat[-1]:]
            group_at.append(tail[full[tail]])
        settle()

        # Windows of every piece against the least id of their class.
        count = size - s.length + 1
        row = np.repeat(np.arange(len(size)), count)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        gone = best[begin[kind[row]] + k] < ids[row]
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Runs of marks are cut where another piece begins.
        inner = np.flatnonzero(gone[1:] & gone[:-1] & (row[1:] != row[:-1])) + 1
        a, z = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([z, inner]))
        r = row[a] if len(a) else a
        return pa.table({"id": pa.array(ids[r]), "tk": pa.array(tks[r]), "start": pa.array(start[r] + k[a] if len(a) else a, pa.int64()),
                         "end": pa.array(start[r] + k[z - 1] + s.length if len(a) else a, pa.int64())})

    return run


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept, n, removed, runs = [], [], [], []
    for i, x in enumerate(texts.cast(pa.binary())):
        data = x.as_py() or b""
        n.append(len(data))
        out, here, gone, many = [], 0, 0, 0
        until = -1
        for sp in sorted((p["start"], p["end"]) for p in (spans[i].as_py() or ())):
            a, z = sp
            if a > until:
                many += 1
                out.append(data[here:a])
                gone += z - a
            elif z > until:
                gone += z - until
            until = max(until, z)
            here = until
        out.append(data[here:] if many else data)
        kept.append(b"".join(out))
        removed.append(gone)
        runs.append(many)
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in (n, removed, runs))], ["kept", "n_bytes", "n_removed", "n_spans"])


def _spans(slim: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """id, tk, spans: the byte ranges that go, stored."""
    lowest = whole.groupBy("md").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    copies = cut(whole.join(lowest, "md").filter("id > lo").select("id", "tk", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")).distinct(), release=True)

    buckets = 1 << max(4, (whole.count() // s.docs_per_bucket).bit_length())
    packed = slim.mapInArrow(_emit(buckets, s), "bucket int, block long, code binary, doc binary, at binary, ids array<long>, tks array<long>")
    runs = packed.groupBy("bucket").applyInArrow(_shared, BLOCKS).groupBy("block").applyInArrow(_by_doc, "id long, tk long, runs binary")
    # The minimizers of all windows leave the disks before texts and pieces come to them.
    runs = cut(runs.join(copies, ["id", "tk"], "left_anti").dropDuplicates(["id", "tk"]), release=True)
    texts = runs.join(slim.withColumnsRenamed({"id": "_i", "tk": "_t"}), (F.col("id") == F.col("_i")) & (F.col("tk") == F.col("_t"))).select("id", "tk", "runs", "text")
    pieces = texts.mapInArrow(_pieces(buckets, s), "shard int, data binary, size binary, piece binary, ids binary, tks binary, start binary")
    spans = pieces.groupBy("shard").applyInArrow(_sort(s), "id long, tk long, start long, end long")
    spans = spans.union(copies).groupBy("id", "tk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return cut(spans, release=True)


def dedup(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``documents`` with a struct column ``cut_``: kept (binary), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    doc_id. Null texts are empty. Null ids come after all others and are equal to each other. Rows with equal
    ids remove nothing from each other; those with equal texts too are treated alike. Columns of any name pass
    through, but for ``cut_``, which is replaced. ``kept`` may end inside a UTF-8 character.
    """
    s = settings
    names = [c for c in documents.columns if c != "cut_"]
    keyed = documents.select(*names, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("tk")).alias("_key"))
    slim = keyed.select("_key.id", "_key.tk", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= s.length)
    whole = cut(slim.select("id", "tk", F.md5("text").alias("md"), F.octet_length("text").cast("long").alias("n")))
    spans = _spans(slim, whole, s)
    spans = spans.withColumnsRenamed({"id": "_i", "tk": "_t", "spans": "_spans"})
    both = keyed.join(spans, (F.col("_key.id") == F.col("_i")) & (F.col("_key.tk") == F.col("_t")), "left")
    return both.withColumn("cut_", F.arrow_udf(_without, "kept binary, n_bytes long, n_removed long, n_spans long")(F.coalesce("text", F.lit("")), "_spans")).select(*names, "cut_")
