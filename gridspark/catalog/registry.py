"""Registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Query] = {}

# Results are compared as values, so doubles are cut to six digits on both
# sides. The small shift keeps exact decimal ties off the rounding edge.
SHIFT = "0.0000000137"


def register(name: str, ids: str, sql: str | None = None, doubles: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), fn, sql, tuple(doubles.split()))
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double") + F.lit(float(SHIFT)), 6) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(q.run(spark, sf_dir))


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.doubles:
        return q.sql
    rep = ", ".join(f"round({c}::DOUBLE + {SHIFT}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({q.sql}) AS q_"
