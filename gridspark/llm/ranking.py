"""Ranked lexical search, term at a time with a limited set of accumulators.

The index is cut by documents: a block of some megabytes of text holds, per term, the places of its
documents and how often each has the term. A block is one packed row, so an item's postings meet
without a shuffle and no term, however common, is ever gathered. Corpus figures (documents, length,
documents per term) are sums over the blocks.

In a block an item's terms are taken rarest first. A term adds to the accumulators of its documents;
new ones are made only while a document outside could still reach the best: as soon as the bounds of
the remaining terms together stay below the k-th best partial score, no more are made and those that
exist are brought up to their exact scores. What a block keeps are its own k best of each item, so the
merge reads k rows a block and item at most.

Scores are whole numbers: weight * ((1e9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import MARKS, U, blocks, words
from gridspark.session import cut

INDEX = "doc_ids binary, nulls binary, n_terms binary, terms binary, starts binary, docs binary, counts binary, n_docs long, length long"


@dataclass(frozen=True)
class Settings:
    k: int = 10
    #: Bits of the filter that keeps words of no item out of the index.
    filter_bits: int = 22
    #: Bytes of text of one index block; a longer document is a block of its own.
    block_bytes: int = 4 << 20
    #: Items searched by one pass over the index: so many of their distinct terms at most, or one item.
    terms_per_pass: int = 200_000


def _terms() -> callable:
    """Rows (item, text) -> item, code, qtf: hashed terms of an item's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                w = words(b, MARKS)
                if not len(w.hash):
                    continue
                order = np.lexsort((w.hash, w.doc))
                doc, code = w.doc[order], w.hash[order]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(b.first + doc[head])), pa.array(code[head].view(np.int64)), pa.array(np.diff(np.append(head, len(doc))))],
                    ["item_id", "code", "qtf"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, code, qtf; equal rows count once, different texts of one id are one item."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return texts.mapInArrow(_terms(), "item_id long, code long, qtf long").groupBy("item_id", "code").agg(F.sum("qtf").alias("qtf"))


def _sieve(terms: DataFrame, bits: int) -> np.ndarray:
    """Which low bits some item's term has: 2 ** bits / 8 bytes, whatever the number of items."""
    low = F.col("code").bitwiseAND((1 << bits) - 1)
    filled = terms.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << (bits - 6), U)
    sieve[filled["w"].to_numpy()] = filled["bits"].to_numpy().view(U)
    return sieve


class _Writer:
    """Collects postings of documents and packs them, sorted by term, into one row."""

    def __init__(self):
        self.bytes, self.ids, self.n, self.code, self.doc, self.tf = 0, [], [], [], [], []

    def row(self) -> list | None:
        """None where no document has a term."""
        ids = pa.concat_arrays(self.ids)
        n, code, doc, tf = (np.concatenate(x) for x in (self.n, self.code, self.doc, self.tf))
        self.__init__()
        order = np.lexsort((doc, code))
        code, doc, tf = code[order], doc[order], tf[order]
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        missing = np.array(ids.is_null())
        return [np.array(ids.fill_null(0)).astype(np.int64).tobytes(), np.packbits(missing).tobytes(), n.astype(np.int64).tobytes(), code[heads].tobytes(),
                np.append(heads, len(code)).astype(np.int64).tobytes(), doc.astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes(), int(np.sum(n > 0)), int(n.sum())]


def _index(s: Settings, sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer()

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out.row()], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for b in blocks(batch.column(1)):
                w = words(b, MARKS)
                low = (w.hash & U((1 << s.filter_bits) - 1)).astype(np.int64)
                hit = np.flatnonzero((sieve[low >> 6] >> (low & 63).astype(U)) & U(1))
                order = hit[np.lexsort((w.hash[hit], w.doc[hit]))]
                doc, code = w.doc[order], w.hash[order]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(order) else np.zeros(0, np.int64)
                base = sum(map(len, out.n))
                out.ids.append(batch.column(0).slice(b.first, len(b)))
                out.n.append(np.diff(w.bounds))
                out.code.append(code[head])
                out.doc.append(doc[head] + base)
                out.tf.append(np.diff(np.append(head, len(order))))
                out.bytes += len(b.data)
                if out.bytes >= s.block_bytes:
                    yield packed()
        if out.n:
            yield packed()

    return run


def build_index(documents: DataFrame, terms: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The blocks of ``documents`` (doc_id, text), with the postings of words that items have."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_index(settings, _sieve(terms, settings.filter_bits)), INDEX)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, starts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            df = np.diff(np.frombuffer(starts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, np.int64)), pa.array(df)], ["code", "df"])


def term_at_a_time(postings: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (place, score) above 0 of one item, highest first, ties by id; and how many accumulators there were.

    ``postings``: (bound, places, added) per term, the rarest first; ``bound`` is the largest value of
    ``added``. ``ids``: rank of each document's id, for ties.
    """
    score = np.zeros(n_docs, np.int64)
    alive = np.zeros(n_docs, bool)
    left = int(sum(p[0] for p in postings))
    open_, n_alive = True, 0
    for bound, places, added in postings:
        if open_ and n_alive >= k:
            partial = score[alive]
            # A document without an accumulator ends at ``left`` at most; an equal score could win by its id.
            open_ = left >= np.partition(partial, len(partial) - k)[len(partial) - k]
        if open_:
            alive[places] = True
            n_alive = int(np.count_nonzero(alive))
            score[places] += added
        else:
            mine = alive[places]
            score[places[mine]] += added[mine]
        left -= bound
    at = np.flatnonzero(alive & (score > 0))
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    at = at[np.lexsort((ids[at], -score[at]))][:k]
    return at, score[at], n_alive


def _search(s: Settings, items: list[tuple[int | None, np.ndarray, np.ndarray]], codes: np.ndarray, weights: np.ndarray, total: int, length: int):
    """Items (id, positions in ``codes`` rarest first, repeats) against every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, nulls, n, terms, starts, docs, counts = (np.frombuffer(x, t) for x, t in zip(
                    row, (np.int64, np.uint8, np.int64, U, np.int64, np.uint32, np.uint32), strict=True))
                missing = np.unpackbits(nulls, count=len(doc_ids)).astype(bool)
                ids = np.empty(len(doc_ids), np.int64)
                ids[np.lexsort((doc_ids, missing))] = np.arange(len(doc_ids))
                kinds, where = np.unique(n, return_inverse=True)
                # Products beyond 64 bits are taken in Python's whole numbers, once per length.
                m8 = np.array([8 * (25 + 75 * int(x) * total // length) if length else 0 for x in kinds], np.int64)[where]
                at = np.searchsorted(terms, codes)
                at[at == len(terms)] = 0
                here = terms[at] == codes if len(terms) else np.zeros(len(codes), bool)
                lists: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
                for j in np.flatnonzero(here):
                    a, z = starts[at[j]], starts[at[j] + 1]
                    places, tf = docs[a:z].astype(np.int64), counts[a:z].astype(np.int64)
                    added = weights[j] * ((1_000_000_000 * tf) // (1000 * tf + m8[places]))
                    lists[int(j)] = (int(added.max()), places, added)
                out: list[list] = [[], [], []]
                for item, js, qtf in items:
                    mine = [(int(q) * lists[j][0], lists[j][1], q * lists[j][2]) for j, q in zip(js.tolist(), qtf, strict=True) if j in lists]
                    if not mine:
                        continue
                    best, score, _ = term_at_a_time(mine, len(doc_ids), ids, s.k)
                    out[0] += [item] * len(best)
                    out[1] += [None if missing[d] else int(doc_ids[d]) for d in best]
                    out[2] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    return run


def search(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best rows of ``documents``, all with a score above 0 if fewer.

    Terms are runs of digits, letters and non-ASCII characters of the whole text after lower-casing
    A-Z, told apart by 64-bit hashes. Null and empty texts have no terms: such documents are found by
    no item and such items have no rows. Every row of ``documents`` is ranked by itself, repeated rows
    as well; equal scores are ordered by doc_id, null last. Equal rows of ``items`` count once, several
    texts of one item_id are one item; a null item_id is an item like others. Empty tables give an empty
    result. Very long texts are read whole and form a block of their own. Other columns are not read.
    """
    s = settings
    terms = cut(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")))
    index = cut(build_index(documents, terms, s))
    # A word that only shares bits with a term of an item is dropped by the join.
    df = index.select("terms", "starts").mapInArrow(_frequencies, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    total, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((F.lit(2.0) * total + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    known = terms.join(df, "code").select("item_id", "code", "qtf", "df", weight.alias("weight"))
    passes = max(1, -(-known.count() // s.terms_per_pass))
    known = cut(known.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int")))
    found = []
    for i in range(passes):
        mine = known.filter(F.col("pass") == i).select("item_id", "code", "qtf", "df", "weight").toArrow()  # bounded by terms_per_pass and one item
        item, code, qtf, docs, weight = (np.array(c.combine_chunks().fill_null(0)) for c in mine.columns)
        none = np.array(mine["item_id"].is_null())
        order = np.lexsort((code, docs, item, none))  # an item's terms, the rarest first
        codes, first, back = np.unique(code.view(U), return_index=True, return_inverse=True)
        heads = np.flatnonzero(np.diff(item[order], prepend=0) | np.diff(none[order].astype(int), prepend=-1))
        groups = [(None if none[g[0]] else int(item[g[0]]), back[g], qtf[g]) for g in np.split(order, heads[1:])] if len(order) else []
        hits = index.select(*[c.split()[0] for c in INDEX.split(", ")[:7]]).mapInArrow(
            _search(s, groups, codes, weight[first], int(total), int(length)), "item_id long, doc_id long, score long")
        found.append(cut(hits) if passes > 1 else hits)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= s.k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
