"""The packed floors agree with the pixel forms on frames of several sizes."""

import numpy as np
from pyspark.sql import functions as F

from gridspark.layouts import frames_to_pixels, pixels_to_frames
from gridspark.operators import raster as R
from gridspark.plans import quality as Q


def test_packed_equals_pixels(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f, (h, w) in enumerate([(7, 9), (7, 9), (30, 4), (1, 12), (5, 5)]):
        z = np.where(rng.random((h, w)) < 0.2, rng.random((h, w)) + 0.6, 0.0) * (f != 4)
        rows += [(f, y, x, float(v), h, w) for (y, x), v in np.ndenumerate(z)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, z double, h int, w int")
    fr = pixels_to_frames(px, ["z"])
    got = lambda d, c: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in d.select("frame", "y", "x", c).collect())
    a = frames_to_pixels(Q.floor_nearest_packed(fr, "z", 0.5, 3.0), ["pred"])
    assert got(a, "pred") == got(Q.floor_nearest(px, "z", 0.5, 3.0), "pred")
    b = frames_to_pixels(Q.floor_bicubic_packed(fr, "z", F.col("h") * 2, F.lit(6), 0.5, 3.0), ["pred"])
    c = Q.floor_bicubic(px, "z", F.col("h") * 2, F.lit(6), 0.5, 3.0)
    assert got(b, "pred") == got(c, "pred")


def test_search_radius_is_exact(spark):
    z = np.zeros((3, 40))
    z[2, 0], z[0, 39] = 1.0, 2.0
    px = spark.createDataFrame([(0, y, x, float(v), 3, 40) for (y, x), v in np.ndenumerate(z)], "frame int, y int, x int, z double, h int, w int")
    out = {(r.y, r.x): r.z for r in R.fill_nearest(px, "z").collect()}
    for (y, x), v in out.items():
        d1, d2 = (y - 2) ** 2 + x ** 2, y ** 2 + (x - 39) ** 2
        assert v == (2.0 if d2 <= d1 else 1.0)
