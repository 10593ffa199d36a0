"""Byte-level BPE by recursive queries in an embedded SQL engine, one per task.

Spark deals out the rows. Within a task the split pattern cuts texts into words; words
that the task has not met yet become rows (word, position, token), and a recursive query
joins neighbouring tokens with the merge table and contracts each word's leftmost pair of
least rank, until no word has a pair left. Each place of a word is then a look-up, and so is
each token's bytes when ids are decoded.

The recursion keeps every round's rows, so words of more than ``LONG`` bytes take the same
step in a loop that keeps the last round only. There a step contracts all places of the
least pair at once where the merge table shows that this changes nothing: no pair with the
new token ranks below it.
"""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridspark.llm.common import bound_batches

LONG = 256  # bytes of a word up to which the recursive query takes it
WORDS = 12_000  # words a query
KNOWN = 200_000  # words a worker remembers before it drops those that it met least
ROWS = 400_000  # tokens decoded at a time

#: Neighbours of the rows of ``source`` with the merge that joins them, and each word's leftmost pair of least
#: rank. Positions grow through all words, so one sort by position keeps words together.
STEP = """
    c AS (SELECT x.w, x.p, x.t, x.q, m.k::BIGINT * 4294967296 + x.p AS r
          FROM (SELECT w, p, t, CASE WHEN lead(w) OVER o = w THEN lead(t) OVER o END AS n, lead(p) OVER o AS q
                FROM {source} WINDOW o AS (ORDER BY p)) x
          LEFT JOIN merges m ON x.t = m.a AND x.n = m.b),
    g AS (SELECT w, min(r) AS r, arg_min(q, r) AS gone FROM c GROUP BY w)
"""

ENCODE = f"""
WITH RECURSIVE s(w, p, t, live) AS (
    SELECT w, p, t, true FROM fresh
    UNION ALL
    SELECT * FROM (
        WITH {STEP.format(source="s WHERE live")}
        SELECT c.w, c.p, CASE WHEN c.r = g.r THEN (g.r // 4294967296)::INT ELSE c.t END, g.r IS NOT NULL
        FROM c JOIN g USING (w) WHERE g.gone IS NULL OR c.p <> g.gone)
) SELECT w, t FROM s WHERE NOT live ORDER BY p
"""

#: One round for long words. ``hit``: the places of the least pair; in a run of overlapping ones every other.
LONG_STEP = f"""
CREATE OR REPLACE TEMP TABLE nxt AS
WITH {STEP.format(source="cur")},
    h AS (SELECT c.w, c.p, c.q, (g.r // 4294967296)::INT AS k, c.r = g.r AS lead_one,
                 lag(c.q) OVER (PARTITION BY c.w ORDER BY c.p) AS before
          FROM c JOIN g USING (w) WHERE c.r // 4294967296 = g.r // 4294967296),
    runs AS (SELECT *, sum(CASE WHEN before = p THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS run FROM h),
    hit AS (SELECT w, p, q, k FROM (
                SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS n FROM runs)
            WHERE n % 2 = 1 AND (lead_one OR k IN (SELECT k FROM calm)))
SELECT c.w, c.p, coalesce(hit.k, c.t) AS t
FROM c LEFT JOIN hit ON c.w = hit.w AND c.p = hit.p
WHERE NOT EXISTS (SELECT 1 FROM hit d WHERE d.w = c.w AND d.q = c.p)
"""


class Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Coder:
    """Merge table in a database of its own, vocabulary and the words met so far."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": "", "preserve_insertion_order": False})
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        a, b, k = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    a.append(x)
                    b.append(y)
                    k.append(rank)
        self._fill("merges", a=a, b=b, k=k)
        self.vocab = pa.array(map({k: t for t, k in ranks.items()}.get, range(max(ranks.values()) + 1)), pa.large_binary())
        # Tokens in no pair that ranks below them.
        self.db.execute("CREATE TABLE calm AS SELECT DISTINCT k FROM merges EXCEPT SELECT x FROM (SELECT a AS x, k FROM merges UNION ALL SELECT b, k FROM merges) WHERE k < x")
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._forget()

    def _fill(self, name: str, **columns: list) -> None:
        self.db.register("given", pa.table({c: pa.array(v, pa.int32()) for c, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.known = Numbers()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int64)

    def _thin(self) -> None:
        """Keep the words that were met again, half of the room's worth at most, and count anew."""
        n = len(self.known)
        often = np.sort(np.argsort(-self.met[:n], kind="stable")[:KNOWN // 2])
        often = often[self.met[often] > 1]
        words, size = list(self.known), self.size[often]
        ids = self._gather(often)
        self._forget()
        self.known.update((words[k], i) for i, k in enumerate(often.tolist()))
        self._store(np.arange(len(often)), ids, size)

    def _store(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        used, end = self.used + len(ids), len(self.known)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        if end > len(self.start):
            self.start, self.size, self.met = (np.concatenate([v, np.zeros(max(len(v), end - len(v)), np.int64)]) for v in (self.start, self.size, self.met))
        self.flat[self.used: used] = ids
        self.start[numbers], self.size[numbers] = self.used + np.cumsum(size) - size, size
        self.used = used

    def rest(self) -> None:
        """Between tasks a worker keeps the tables only and hands freed memory back to the system."""
        self._forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def _rows(self, texts: list[bytes]) -> pa.Table:
        size = np.array([len(x) for x in texts])
        return pa.table({
            "w": np.repeat(np.arange(len(texts), dtype=np.int32), size),
            "p": np.arange(int(size.sum()), dtype=np.int32),
            "t": self.single[np.frombuffer(b"".join(texts), np.uint8)]})

    def contract(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each word has."""
        if max(map(len, texts)) <= LONG:
            self.db.register("fresh", self._rows(texts))
            got = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("fresh")
        else:
            self.db.register("fresh", self._rows(texts))
            self.db.execute("CREATE OR REPLACE TEMP TABLE cur AS SELECT * FROM fresh")
            self.db.unregister("fresh")
            left = -1
            while (now := self.db.execute("SELECT count(*) FROM cur").fetchall()[0][0]) != left:
                left = now
                self.db.execute(LONG_STEP)
                self.db.execute("CREATE OR REPLACE TEMP TABLE cur AS SELECT * FROM nxt")
            got = self.db.sql("SELECT w, t FROM cur ORDER BY w, p").to_arrow_table()
        return got["t"].to_numpy(), np.bincount(got["w"].to_numpy(), minlength=len(texts))

    def _learn(self, first: int) -> None:
        """Tokens of all words from number ``first`` on."""
        fresh = [x.encode() for x in islice(self.known, first, None)]
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        order = np.argsort(size, kind="stable")  # words of one length take like numbers of rounds
        short, long = order[size[order] <= LONG], order[size[order] > LONG]
        for group in [*(short[i: i + WORDS] for i in range(0, len(short), WORDS)), *long.reshape(-1, 1)]:
            self._store(first + group, *self.contract([fresh[k] for k in group.tolist()]))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1]) if len(at) else 0) + np.repeat(self.start[at] - ends + size, size)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and where each text's begin, with the end."""
        if len(self.known) > KNOWN:
            self._thin()
        first, counts = len(self.known), [0]

        def found() -> Iterator[list[str]]:
            for x in texts:
                words = self.pattern.findall(x)
                counts.append(len(words))
                yield words

        try:
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found())), np.int64)
            if len(self.known) > first:
                self._learn(first)
        except BaseException:
            self._forget()  # numbered words without tokens
            raise
        self.met[:len(self.known)] += np.bincount(at, minlength=len(self.known))
        ends = np.concatenate([[0], np.cumsum(self.size[at])])
        return self._gather(at), ends[np.cumsum(counts)]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return (ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def decode_all(self, ids: pa.ListArray) -> list[bytes]:
        """Bytes of each list of ids; unknown ids are an error."""
        ends, t = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten()
        if len(t) and (t.null_count or not 0 <= pc.min(t).as_py() <= pc.max(t).as_py() < len(self.vocab)):
            raise ValueError("an id is not in the vocabulary")
        pieces, at, done = [], np.zeros(len(ends), np.int64), 0
        for a in range(0, len(t), ROWS):
            got = self.vocab.take(t.slice(a, ROWS))
            if got.null_count:
                raise ValueError("an id is not in the vocabulary")
            place = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
            here = slice(*np.searchsorted(ends, [a + 1, a + len(got) + 1]))
            at[here] = done + place[ends[here] - a]
            pieces.append(got.buffers()[2].to_pybytes()[: int(place[-1])])
            done += int(place[-1])
        whole = b"".join(pieces)
        return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


SLICE = 1 << 20  # characters of text that are encoded at a time


def encode(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns but ``text``, and ``ids``: array<int>, the tokens of the whole text (null and empty: none).

    With ``decoded`` the same worker turns the ids back into bytes, as :func:`decode` does for stored ids:
    one database a task instead of two. Rows are coded one by one, so repeated rows and any doc_ids
    are alike. Columns named ``ids`` (and ``decoded``) are replaced.
    """
    bound_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c not in (text, "ids", *["decoded"] * decoded)]
    source = documents.select(*rest, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "`ids` array<int>", *["`decoded` binary"] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in batches:
            column, i = batch.column(len(rest)), 0
            while i < batch.num_rows:
                texts, n, first = [], 0, i
                while i < batch.num_rows and (not texts or n < SLICE):
                    x = column[i].as_py() or ""
                    texts.append(x)
                    n += len(x)
                    i += 1
                flat, ends = c.encode_flat(texts)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                more = [pa.array(c.decode_all(ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, i - first) for k in range(len(rest))), ids, *more], [*rest, "ids", *["decoded"] * decoded])
        c.rest()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: binary, the bytes of ``ids`` (null: empty)."""
    from pyspark.sql import functions as F

    @F.arrow_udf("binary")
    def back(ids: pa.Array) -> pa.Array:
        return pa.array(coder(ranks_path, pattern).decode_all(ids), pa.binary())

    return encoded.withColumn("decoded", back(F.coalesce("ids", F.array().cast("array<int>"))))
