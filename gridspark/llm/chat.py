"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, and adjacent turns of one role
become one block by array functions. Blocks read

    <s>[INST]role[/INST]text[TURN]text</s>

``[TURN]`` keeps the texts of merged turns apart. Within roles and texts ``&`` is written
``&amp;``, and the first character of anything that reads like a mark ``&lt;`` or ``&lsqb;``, so
the format can be read back exactly. The loss mask covers the assistant's texts, without marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[TURN]", "</s>"


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    t = F.regexp_replace(t, r"<(?=/?s>)", "&lt;")
    return F.regexp_replace(t, r"\[(?=(?:/?INST|TURN)\])", "&lsqb;")


def unescape(text: Column) -> Column:
    t = F.replace(text, F.lit("&lt;"), F.lit("<"))
    t = F.replace(t, F.lit("&lsqb;"), F.lit("["))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, pieces: array<struct<text, loss>> whose texts joined are ``formatted``.

    Rows are ordered by (turn, role, text), nulls first; a null role or text is empty; repeated rows
    count each; a null conv_id is a conversation of its own. Further columns are ignored.
    """
    # collect_list combines rows before the shuffle and drops nothing; sorting makes the order certain.
    rows = turns.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Where runs of one role begin; each run is one slice of the turns.
    n = F.size("ts")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.col("ts")[i - 1]["role"] != F.col("ts")[F.greatest(i - 2, F.lit(0))]["role"]))
    merged = sorted_.withColumn("starts", starts).select("conv_id", F.transform("starts", lambda a, k: F.slice(
        "ts", a, F.coalesce(F.get("starts", k + 1), n + 1) - a)).alias("runs"))
    block = lambda run: F.concat(
        F.array(F.struct(F.concat(F.lit(OPEN), escape(run[0]["role"]), F.lit(ROLE)).alias("text"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(run, lambda t, i: F.concat(
            F.when(i > 0, F.array(F.struct(F.lit(NEXT).alias("text"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
            F.array(F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))))),
        F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))))
    out = merged.select("conv_id", F.flatten(F.transform("runs", block)).alias("pieces"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns in order, from the formatted text alone."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        parts = F.split(F.substr(b, F.lit(len(OPEN) + 1)), r"\[/INST\]", 2)
        return F.transform(F.split(parts[1], r"\[TURN\]"), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
