"""Substring dedup on sliding sentence spans.

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, or at a line break. Every
run of ``span`` consecutive sentences with at least ``min_words`` words is hashed (words
after lower-casing A-Z, white space and line breaks aside). A span's first place is the
one with the least (doc_id, sentence); the sentences of all its other places go, with the
white space up to the next sentence.

A document looks up each span once, by its first place there. Later places of the same span
in the same document are never a first place, so they travel along as a list and go in any case;
a line that a document repeats a thousand times is one row of the shuffle and the join.

With ``passages`` the runs are, instead, from each sentence on and up to each sentence the
shortest one with at least ``min_words`` words. A repeated passage of whole sentences and that
many words is made up of such runs, so all of it is found, be it one long sentence or many
short ones; what ``span`` finds is found too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACES, U, Block, blocks, bound_batches, hand_back, mix, powers, words


@dataclass(frozen=True)
class Settings:
    span: int = 2  # consecutive sentences
    min_words: int = 8  # a span of fewer words says little
    passages: bool = False  # every passage of min_words or more, not only runs of span sentences

    @property
    def stride(self) -> int:
        """More than the sentences of any run."""
        return max(self.span, self.min_words) + 1


#: What the query and the pipeline look up. Runs of eight words are also common sentences, which three of ten
#: documents without a copied passage hold; the whole sentences of a passage of fifty words have sixteen and more.
PASSAGES = Settings(min_words=16, passages=True)

LAST_ID = (1 << 63) - 1

_STOP = np.zeros(256, bool)
_STOP[[*map(ord, ".!?")]] = True


@dataclass
class Sentences:
    start: np.ndarray  # byte of the first word
    doc: np.ndarray
    index: np.ndarray  # within the document
    hash: np.ndarray
    words: np.ndarray


def sentences(block: Block) -> Sentences:
    w = words(block, SPACES)
    n = len(w.start)
    if not n:
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z, np.zeros(0, U), z)
    lines = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int64)])
    opens = np.ones(n, bool)
    opens[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[block.data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    with np.errstate(over="ignore"):
        code = w.hash * powers(int(size.max()))[np.arange(n) - np.repeat(first, size)]
        code = mix(np.add.reduceat(code, first) + size.astype(U))
    doc = w.doc[first]
    head = np.searchsorted(doc, doc)
    return Sentences(w.start[first], doc, np.arange(len(first)) - head, code, size)


def _runs(x: Sentences, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First sentences and sentence counts of the runs that are looked up."""
    n = len(x.doc)
    total = np.concatenate([[0], np.cumsum(x.words)])
    if not s.passages:
        at = np.arange(max(n - s.span + 1, 0))
        at = at[(x.doc[at] == x.doc[at + s.span - 1]) & (total[at + s.span] - total[at] >= s.min_words)]
        return at, np.full(len(at), s.span)
    least = max(s.min_words, 1)
    until = np.searchsorted(total, total[:-1] + least)  # end of the shortest run from each sentence on
    since = np.searchsorted(total, total[1:] - least, side="right") - 1  # start of the shortest run up to each sentence
    on = np.flatnonzero(until <= np.searchsorted(x.doc, x.doc, side="right"))
    up = np.flatnonzero((since >= np.searchsorted(x.doc, x.doc)) & (since >= 0))
    up = up[until[since[up]] != up + 1]
    return np.concatenate([on, since[up]]), np.concatenate([until[on] - on, up + 1 - since[up]])


def _codes(x: Sentences, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of any length, from running sums."""
    n = len(x.hash)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(x.hash * powers(n), dtype=U)])
        return mix((run[at + size] - run[at]) * powers(n, inverse=True)[at] + mix(size.astype(U)))


def _once(code: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """First place of each span in each document, and its other places there (none: null)."""
    order = np.lexsort((place, code, doc))
    opens = np.ones(len(order), bool)
    opens[1:] = (doc[order[1:]] != doc[order[:-1]]) | (code[order[1:]] != code[order[:-1]])
    starts = np.flatnonzero(opens)
    others = np.diff(np.append(starts, len(order))) - 1
    ends = pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32))
    return order[starts], pa.ListArray.from_arrays(ends, pa.array(place[order[~opens]]), mask=pa.array(others == 0))


def _spans(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                x = sentences(b)
                at, size = _runs(x, s)
                if not len(at):
                    continue
                code, doc, place = _codes(x, at, size), x.doc[at], x.index[at].astype(np.int64) * s.stride + size
                head, more = _once(code, doc, place)
                rows = pa.array(doc[head] + b.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[head].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[head]), more],
                    ["span", "id", "tk", "at", "more"])
            hand_back()

    return run


def _cut(s: Settings):
    @F.arrow_udf("text string, n_removed long, spans array<struct<start: long, end: long>>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        n = len(texts)
        changed, lost, found = [], np.zeros(n, np.int64), [[]] * n
        todo = np.flatnonzero(pc.greater(pc.list_value_length(places), 0).fill_null(False).to_numpy(zero_copy_only=False))
        for i in todo.tolist():  # all other texts stay in their buffer
            b = next(blocks(texts.slice(i, 1), 0))
            start = sentences(b).start
            gone = np.zeros(len(start) + 1, bool)
            at, size = np.divmod(places[i].values.to_numpy(), s.stride)
            for j in range(int(size.max())):
                gone[at[size > j] + j] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
            ends = np.append(start, len(b.data))[edge].tolist()
            ranges = list(zip(ends[::2], ends[1::2], strict=True))
            kept, here = [], 0
            for x, y in ranges:
                kept.append(b.data[here:x].tobytes())
                here = y
            kept.append(b.data[here:].tobytes())
            changed.append(b"".join(kept).decode())
            lost[i] = sum(y - x for x, y in ranges)
            found[i] = [{"start": x, "end": y} for x, y in ranges]
        mask = np.zeros(n, bool)
        mask[todo] = True
        left = pc.replace_with_mask(texts, pa.array(mask), pa.array(changed, texts.type)) if changed else texts
        del changed
        hand_back()
        return pa.StructArray.from_arrays(
            [left, pa.array(lost), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["text", "n_removed", "spans"])

    return cut.asNondeterministic()  # else a filter on what was cut would cut each text a second time


def dedup(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``documents`` with its text cut, and a struct column ``cut_`` (n_removed, spans in bytes of the old text).

    Null texts stay null, empty ones empty. Null ids come after all others and, like rows that
    share an id, make up one document as to which place is first: at equal (id, sentence) both
    stay. Repeated rows are cut alike. Columns of any name pass through, but for ``cut_``,
    which is replaced.
    """
    s = settings
    bound_batches(documents.sparkSession)
    keyed = documents.drop("cut_").withColumn("cut_", F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("tk")))
    slim = keyed.select("cut_.id", "cut_.tk", F.coalesce("text", F.lit("")).alias("text"))
    spans = slim.mapInArrow(_spans(s), "span long, id long, tk long, at long, more array<long>")
    # One number for (id, sentence) keeps the aggregate a hash aggregate; places of a span are all of one length.
    spans = spans.withColumn("place", F.col("id").cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("at"))
    first = spans.groupBy("span").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.bool_or(F.col("more").isNotNull()).alias("again"))
    first = first.filter("lo < hi or again").select("span", "lo")
    gone = spans.join(first.hint("merge"), "span").filter("place > lo or more is not null")
    more = F.coalesce("more", F.array().cast("array<long>"))
    gone = gone.select("id", "tk", F.when(F.col("place") > F.col("lo"), F.concat(F.array("at"), more)).otherwise(more).alias("at")).distinct()
    gone = gone.groupBy("id", "tk").agg(F.flatten(F.collect_list("at")).alias("places"))
    both = keyed.join(gone, (F.col("cut_.id") == gone["id"]) & (F.col("cut_.tk") == gone["tk"]), "left")
    names = keyed.columns[:-1]
    both = both.select(*[keyed[c] for c in names], gone["places"].alias("cut_"))
    return both.withColumn("cut_", _cut(s)("text", "cut_")).select(
        *[F.col("cut_.text").alias("text") if c == "text" else F.col(c) for c in names],
        F.struct(F.col("cut_.n_removed").alias("n_removed"), F.col("cut_.spans").alias("spans")).alias("cut_"))
