"""License scans: phrases, and an exact set-similarity join of text lines with license notices.

A line contains a notice if it holds at least ``containment`` of the notice's distinct words.
Words are ordered by how many documents hold them, rarest first. A line that misses at most
|T| - c of a notice's words holds one of its first |T| - c + 1 (prefix filter), has at least c
distinct words (length filter), and from the first word that both share on, it holds at
least c of the notices' words (positional filter). What is left is counted exactly.

With ``wrapped`` a notice may also run over line breaks: every window of as many consecutive
words as the notice has, wherever its lines end, counts like a line. One pass cuts every text into
words and stores what it finds; only the texts that hold enough of a notice's words at all are
stored too and cut into lines and windows. Spark expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices as they are commonly printed, one line each.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


@dataclass(frozen=True)
class Settings:
    containment: float = 0.8
    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES
    wrapped: bool = False  # notices over line breaks too


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _split(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def read(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, tk, n_words, bases, have, t: all that one pass over the texts finds; stored.

    ``bases``: array<struct<at, label>> of every place of a phrase; ``have``: the notices' words that the text
    holds; ``t``: the text in lower case where these suffice for some notice, else null.
    """
    known = sorted({w for _, text in s.notices for w in _split(text)})
    d = documents.select("doc_id", F.xxhash64("text").alias("tk"), lower_ascii(F.col("text")).alias("t"))
    # Places are sought only in texts that hold a phrase as a string.
    rough = reduce(lambda a, b: a | b, [
        F.contains("t", F.lit(p.split()[-1])) & F.contains("t", F.lit(p.split()[0])) & F.rlike("t", F.lit(GAP.join(p.split()))) for p, _ in s.phrases])

    def found(phrase: str, label: str) -> Column:
        w = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: reduce(lambda a, b: a & b, [
            F.coalesce(F.get("w", i + k) == x, F.lit(False)) for k, x in enumerate(w)]))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    every = F.concat(*[found(p, label) for p, label in s.phrases])
    # The words are used several times below, so Spark keeps this projection apart and cuts them once.
    d = d.select("doc_id", "tk", "t", _words(F.col("t")).alias("w"))
    d = d.select("doc_id", "tk", "t", F.size("w").cast("long").alias("n_words"), F.when(rough & (F.size("w") > 0), every).otherwise(none).alias("bases"),
                 F.array_intersect("w", _lits(known)).alias("have"))
    likely = F.exists(_needs(s), lambda n: F.size(F.array_intersect("have", n["words"])) >= n["need"])
    return cut(d.select("doc_id", "tk", "n_words", "bases", "have", F.when(likely, F.col("t")).alias("t")))


def _needs(s: Settings) -> Column:
    """The notices as a constant: label, distinct words, how many of them are needed, words in all."""
    rows = [(label, sorted(set(_split(text))), len(_split(text))) for label, text in s.notices]
    return F.array(*[F.struct(F.lit(label).alias("label"), _lits(w).alias("words"), F.lit(ceil(s.containment * len(w) - 1e-9)).alias("need"), F.lit(n).alias("n"))
                     for label, w, n in rows])


def wrapped(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, tk, label, containment of the best window for each notice that some window of ``read``'s texts contains."""
    d = texts.filter("t is not null").select("doc_id", "tk", _words(F.col("t")).alias("w"))
    likely = F.filter(_needs(s), lambda n: F.size(F.array_intersect("w", n["words"])) >= n["need"])

    def best(n: Column) -> Column:
        # A window that does not begin with a word of the notice holds no more than the one from the next such word on.
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(n["words"], F.get("w", i)))
        return F.array_max(F.transform(at, lambda i: F.size(F.array_intersect(F.slice("w", i + 1, n["n"]), n["words"]))))

    found = d.select("doc_id", "tk", F.explode(F.transform(likely, lambda n: F.struct(
        n["label"].alias("label"), best(n).alias("k"), n["need"].alias("need"), F.size(n["words"]).alias("of")))).alias("x"))
    return found.filter("x.k >= x.need").select("doc_id", "tk", "x.label", (F.col("x.k") / F.col("x.of")).alias("containment"))


def notices(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, tk, line, notice (its number), label, containment of every line of ``read``'s texts that contains a notice."""
    sets = [sorted(set(_split(text))) for _, text in s.notices]
    known = sorted({w for x in sets for w in x})
    counts = texts.select(F.explode("have").alias("w")).groupBy("w").count()
    often = {r["w"]: r["count"] for r in counts.toArrow().to_pylist()}  # at most one row for each word of the notices
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}
    spark = texts.sparkSession
    rows, prefix = [], set()
    for k, ((label, _), words) in enumerate(zip(s.notices, sets, strict=True)):
        order = sorted(rank[w] for w in words)
        need = ceil(s.containment * len(order) - 1e-9)
        for i in range(len(order) - need + 1):
            rows.append((order[i], k, label, need, order))
            prefix.add(order[i])
    table = F.broadcast(spark.createDataFrame(rows, "first int, notice int, label string, need int, ranks array<int>"))  # one row a word of a prefix
    by_rank = sorted(rank, key=rank.get)
    early = _lits([by_rank[i] for i in sorted(prefix)])
    lines = texts.filter("t is not null").select("doc_id", "tk", F.posexplode(F.split("t", "\n")).alias("line", "block"))
    lines = lines.select("doc_id", "tk", "line", F.array_distinct(_words(F.col("block"))).alias("w"))
    lines = lines.filter(F.arrays_overlap("w", early))
    lookup = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    lines = lines.select("doc_id", "tk", "line", F.size("w").alias("n"), F.array_sort(F.transform(F.array_intersect("w", _lits(known)), lambda w: F.element_at(lookup, w))).alias("have"))
    met = lines.withColumn("first", F.explode("have")).join(table, "first").filter("n >= need")
    met = met.filter(F.size(F.filter("have", lambda r: r >= F.col("first"))) >= F.when(F.col("first") == F.array_min(F.array_intersect("have", "ranks")), F.col("need")).otherwise(F.size("have") + 1))
    both = F.size(F.array_intersect("have", "ranks"))
    return met.filter(both >= F.col("need")).select("doc_id", "tk", "line", "notice", "label", (both / F.size("ranks")).alias("containment"))


def scan(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``documents``: doc_id, tk, n_words, bases, labels, score.

    ``bases``: places of the phrases; ``labels``: sorted labels of phrases and notices; ``score``: 1 with
    a phrase, else the best containment of a line (or window), else 0. Null and empty texts have none. Rows that
    share an id but not the text are told apart; repeated rows get the same result. Further
    columns are ignored.
    """
    base = read(documents, settings)
    found = notices(base, settings).select("doc_id", "tk", "label", "containment")
    if settings.wrapped:
        found = found.union(wrapped(base, settings))
    more = cut(found.groupBy("doc_id", "tk").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))
    more = more.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")
    own = F.array_distinct(F.transform("bases", lambda b: b["label"]))
    return both.select("doc_id", "tk", "n_words", "bases", F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
                       F.when(F.size("bases") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
