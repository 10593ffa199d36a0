"""Normal estimators by name: transforms that add ``nx, ny, nz, n_ok`` to a pixel table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.geometry import normals_cross, normals_facing


def constant(px: DataFrame, z: str, cam=None) -> DataFrame:
    ok = F.col(z) > 0
    return px.withColumn("nx", F.lit(0.0)).withColumn("ny", F.lit(0.0)).withColumn("nz", F.when(ok, -1.0).otherwise(0.0)).withColumn("n_ok", ok)


NORMALS: dict[str, Callable[..., DataFrame]] = {
    "constant": constant,
    "cross_product": normals_cross,
    "facing": lambda px, z, cam, **k: normals_facing(px, z, cam, F.col(z) > 0, **k),
}
