"""Word splitting and hashing over whole Arrow batches, and keys shared by the operators.

Texts arrive as Arrow string arrays. Their bytes lie in one buffer, so words,
shingles and sentences of a block of documents are found and hashed by NumPy in
a few passes, with no Python object per word. A block holds about one megabyte
or one document, whichever is more; memory follows the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_ODD = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (wraps around)."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        for shift, odd in ((30, U(0xBF58476D1CE4E5B9)), (27, U(0x94D049BB133111EB))):
            x ^= x >> U(shift)
            x *= odd
        x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U) + U(1)) * _STEP + U(seed)) | U(1)


BYTE_VALUE = constants(256, 11)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but digits, ASCII letters and bytes of non-ASCII characters.
MARKS = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    MARKS[_a:_b] = False

_powers = {False: np.ones(1, U), True: np.ones(1, U)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of an odd word, or of its inverse."""
    if len(_powers[inverse]) < n:
        step = U(pow(int(_ODD), -1, 1 << 64)) if inverse else _ODD
        with np.errstate(over="ignore"):
            _powers[inverse] = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n, 1024) - 1, step)]))
    return _powers[inverse][:n]


@dataclass
class Block:
    """Bytes of documents ``first`` .. ``first + len(offsets) - 2`` of an Arrow array."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The array cut at document borders, at each one for a limit of 0; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(wide):
        return
    ends = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    body = wide.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(wide):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1) if limit else i + 1
        yield Block(i, data[ends[i]:ends[j]], ends[i:j + 1] - ends[i])
        i = j


@dataclass
class Words:
    start: np.ndarray  # byte where the word begins, within the block
    end: np.ndarray
    doc: np.ndarray  # document within the block
    hash: np.ndarray
    bounds: np.ndarray  # first word of each document, and the number of words


def words(block: Block, gap: np.ndarray = SPACES, fold: bool = True) -> Words:
    """Maximal runs of bytes outside ``gap``, hashed after lower-casing A-Z."""
    data, n = block.data, len(block.data)
    inside = ~gap[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = block.offsets[:-1]
    heads = heads[heads < n]
    opens[heads] = inside[heads]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(opens)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U), np.zeros(len(block) + 1, np.int64))
    first = np.searchsorted(at, start)
    length = np.diff(np.append(first, len(at)))
    values = BYTE_VALUE[FOLD[data[at]] if fold else data[at]]
    with np.errstate(over="ignore"):
        values = values * powers(int(length.max()))[np.arange(len(at)) - np.repeat(first, length)]
        code = mix(np.add.reduceat(values, first) + length.astype(U))
    doc = block.doc_of(start)
    return Words(start, start + length, doc, code, np.searchsorted(doc, np.arange(len(block) + 1)))


def runs(codes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive codes; runs over document borders are the caller's to drop."""
    if len(codes) < n:
        return np.zeros(0, U)
    c = constants(n, seed)
    with np.errstate(over="ignore"):
        acc = codes[: len(codes) - n + 1] * c[0]
        for j in range(1, n):
            acc = acc + codes[j: len(codes) - n + 1 + j] * c[j]
    return mix(acc)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for millions of integers a sort beats hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a whole text (null counts as empty), built in the JVM."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.unhex(F.md5(t.cast("binary")))


def hand_back() -> None:
    """Give freed memory of a worker back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession) -> None:
    """Texts travel to the workers 8 MB at a time and are read 512 at a time, unless the session names its own bounds.

    Both ends hold a batch, and hold it twice while it is copied; by default it has up to 64 MB. The reader
    keeps the texts of its rows, 4,096 by default, in one array that doubles as it grows.
    """
    for name, most in ((BATCH, "8MB"), (ROWS, "512")):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
