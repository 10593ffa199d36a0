"""Connected regions, class masks and their boundaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.layouts import spread
from gridspark.operators import raster as R
from gridspark.operators.joins import points_to_segments
from gridspark.session import cut

ROW = 2147483648  # a label is y * ROW + x of the region's first pixel


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of ``n`` nodes' sets after joining all pairs ``(a, b)``."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]


def regions_of_tile(y: np.ndarray, x: np.ndarray, connect: int) -> np.ndarray:
    """Position of the first pixel of each pixel's region; pixels are distinct and sorted by ``(y, x)``."""
    opens = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(y)) - 1
    run = np.cumsum(opens) - 1
    # Runs of the row above that touch: those between the first that ends late enough and the last that starts early enough.
    wide = int(x.max()) + 4
    at, reach = y[first] * wide, 1 if connect == 8 else 0
    lo = np.searchsorted(at + x[last], at - wide + x[first] - reach, side="left")
    hi = np.searchsorted(at + x[first], at - wide + x[last] + reach, side="right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(first)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return first[_linked(above, below, len(first))[run]]


def _tile_nodes(connect: int):
    @F.arrow_udf("array<bigint>")
    def nodes(ys: pa.Array, xs: pa.Array) -> pa.Array:
        y, x, offsets = ys.flatten().to_numpy(), xs.flatten().to_numpy(), np.diff(ys.offsets.to_numpy(), prepend=0).cumsum()
        offsets -= offsets[0]
        out = np.empty(len(y), np.int64)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yy, xx = y[a:b].astype(np.int64), x[a:b].astype(np.int64)
            head = regions_of_tile(yy - yy[0], xx - xx.min() + 1, connect)
            out[a:b] = yy[head] * ROW + xx[head]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    return nodes


def label_regions(px: DataFrame, mask: Column, by: Sequence[str] = ("frame",), connect: int = 4, tile: int = 256) -> DataFrame:
    """Masked pixels with the label of their region (its smallest ``(y, x)``).

    Frames are cut into tiles of ``tile`` by ``tile`` pixels. A tile's runs of pixels are joined by
    union-find in one pass, so what is left is a graph of regions that touch across tile borders.
    Its labels spread by "take the smallest neighbour, jump to the label's label" until nothing
    changes: rounds follow the tiles that a region crosses, and frames within one tile need none.
    Every round is stored in the shared folder.
    """
    if connect not in (4, 8):
        raise ValueError("connect is 4 or 8")
    by = list(by)
    rest = [c for c in px.columns if c not in (*by, "y", "x")]
    at = [F.floor(F.col(c) / tile).alias(f"_t{c}") for c in ("y", "x")]
    tiles = px.where(mask).groupBy(*by, *at).agg(F.sort_array(F.collect_list(F.struct("y", "x", *rest))).alias("_r"))
    tiles = tiles.withColumn("_n", _tile_nodes(connect)(F.col("_r.y"), F.col("_r.x")))
    seen = Observation()
    pixels = tiles.select(*by, F.explode(F.arrays_zip("_r", "_n")).alias("_p")).select(
        *by, "_p._r.y", "_p._r.x", *[F.col("_p._r")[c].alias(c) for c in rest], F.col("_p._n").alias("node"))
    m = cut(pixels.observe(seen, F.max(F.greatest("y", "x")).alias("far"), F.min(F.least("y", "x")).alias("near")))
    spread = seen.get
    if spread["far"] is None or spread["near"] >= 0 and spread["far"] < tile:
        return m.select(*px.columns, F.col("node").alias("label"))
    on = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = m.where(on("y") | on("x")).select(*by, "y", "x", "node")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connect == 8 else [])
    moved = border.select(*by, F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("_s"), F.col("node").alias("other"))
    e = border.join(moved.select(*by, "_s.y", "_s.x", "other"), [*by, "y", "x"]).where("node <> other").select(*by, "node", "other").distinct()
    e = cut(e.unionByName(e.select(*by, F.col("other").alias("node"), F.col("node").alias("other"))))
    lab = e.select(*by, "node").distinct().withColumn("label", F.col("node"))
    while True:
        near = e.join(lab.select(*by, F.col("node").alias("other"), "label"), [*by, "other"]).groupBy(*by, "node").agg(F.min("label").alias("_n"))
        new = lab.join(near, [*by, "node"], "left").select(*by, "node", F.col("label").alias("_old"), F.least("label", "_n").alias("_m"))
        hop = lab.select(*by, F.col("node").alias("_m"), F.col("label").alias("_j"))
        new = new.join(hop, [*by, "_m"]).select(*by, "node", F.col("_j").alias("label"), (F.col("_j") != F.col("_old")).alias("moved"))
        # the write itself counts the changes, so no second pass is needed
        seen = Observation()
        lab = cut(new.observe(seen, F.count_if("moved").alias("n"))).drop("moved")
        if not seen.get["n"]:
            break
    return m.join(lab, [*by, "node"], "left").withColumn("label", F.coalesce("label", "node")).select(*px.columns, "label")


def region_sizes(labelled: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    return labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"))


def largest(sizes: DataFrame, k: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col("size").desc(), "label")
    return sizes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def keep_regions(px: DataFrame, mask: str, min_area: int, connect: int = 4, top_k: int = 0, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Rewrite the mask so that only large regions (or the k largest) stay."""
    lab = label_regions(px.select(*by, "y", "x", mask), F.col(mask), by, connect)
    keep = region_sizes(lab, by).where(F.col("size") >= min_area)
    if top_k:
        keep = largest(keep, top_k, by)
    good = lab.join(spread(keep), [*by, "label"], "left_semi").select(*by, "y", "x", F.lit(True).alias("_keep"))
    return px.join(spread(good), [*by, "y", "x"], "left").withColumn(mask, F.coalesce("_keep", F.lit(False))).drop("_keep")


def clean_masks(px: DataFrame, min_area: int = 1500, open_px: int = 3, min_stair_frac: float = 0.05, top_k: int = 0) -> DataFrame:
    """Per class: opening and removal of small regions; too little stair clears the frame. Rewrites ``cls``."""
    two = px.select("frame", "y", "x", "cls", F.explode(F.array(F.lit(1), F.lit(2))).alias("c")).withColumn("m", F.col("cls") == F.col("c"))
    by = ["frame", "c"]
    if open_px > 1:
        two = R.dilate(R.erode(two, "m", open_px, by=by), "m", open_px, by=by)
    lab = label_regions(two.select(*by, "y", "x", "m"), F.col("m"), by, 4)
    keep = region_sizes(lab, by).where(F.col("size") >= min_area)
    if top_k:
        keep = largest(keep, top_k, by)
    good = lab.join(spread(keep), [*by, "label"], "left_semi").groupBy("frame", "y", "x").agg(F.max("c").alias("_c"))
    out = px.join(spread(good), ["frame", "y", "x"], "left").withColumn("cls", F.coalesce("_c", F.lit(0))).drop("_c")
    share = out.groupBy("frame").agg(F.avg((F.col("cls") > 0).cast("double")).alias("_f"))
    return out.join(share, "frame").withColumn("cls", F.when(F.col("_f") >= min_stair_frac, F.col("cls")).otherwise(0)).drop("_f")


def boundary(px: DataFrame, stair_bg: bool = True, name: str = "edge") -> DataFrame:
    """Both pixels of every tread/riser (and stair/background) transition."""
    c = F.col("cls")

    def pair(o: Column) -> Column:
        hit = ((c == 1) & (o == 2)) | ((c == 2) & (o == 1))
        if stair_bg:
            hit = hit | ((c == 0) & (o > 0)) | ((o == 0) & (c > 0))
        return F.coalesce(hit, F.lit(False))

    a = px.withColumn("_x", pair(R.shift(c, "x", -1)) | pair(R.shift(c, "x", 1)))
    return a.withColumn(name, F.col("_x") | pair(R.shift(c, "y", -1)) | pair(R.shift(c, "y", 1))).drop("_x")


def depth_edges(px: DataFrame, z: str, threshold: float = 0.05, name: str = "edge") -> DataFrame:
    """Both pixels of every relative jump to a 4-neighbour."""
    v = F.col(z)

    def jump(o: Column) -> Column:
        return F.coalesce((v > 0) & (o > 0) & (F.abs(v - o) > threshold * F.greatest(F.greatest(v, o), F.lit(1e-6))), F.lit(False))

    a = px.withColumn("_x", jump(R.shift(v, "x", -1)) | jump(R.shift(v, "x", 1)))
    return a.withColumn(name, F.col("_x") | jump(R.shift(v, "y", -1)) | jump(R.shift(v, "y", 1))).drop("_x")


def clean_edges(px: DataFrame, edge: str, min_patch_size: int = 40, closing_size: int = 3) -> DataFrame:
    """Close small gaps on measured pixels, then drop small 8-connected patches."""
    out = px
    if closing_size > 1:
        c = R.closed(px.select("frame", "y", "x", "h", "w", F.col(edge).alias("_e"), F.col("gt").alias("_g")), "_e", closing_size)
        out = px.drop(edge).join(spread(c.select("frame", "y", "x", (F.col("_e") & (F.col("_g") > 0)).alias(edge))), ["frame", "y", "x"])
    return keep_regions(out, edge, min_patch_size, 8)


def edge_band(px: DataFrame, segments: DataFrame, band_px: float = 6.0, mode: str = "gaussian", tile: int = 16) -> DataFrame:
    """``E``: the largest segment weight within the band, 0 elsewhere."""
    near = points_to_segments(px.select("frame", "y", "x"), segments, band_px / 2.0, tile)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    l2 = F.greatest(dx * dx + dy * dy, F.lit(1e-6))
    t = F.least(F.greatest(((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / l2, F.lit(0.0)), F.lit(1.0))
    length = F.sqrt(l2)
    end = F.least(t, 1.0 - t) * length
    wgt = F.lit(1.0) if mode == "binary" else F.exp(-(end * end) / (2.0 * (length / 2.0) * (length / 2.0)))
    e = near.groupBy("frame", "y", "x").agg(F.max(wgt).alias("E"))
    return px.join(spread(e), ["frame", "y", "x"], "left").withColumn("E", F.coalesce("E", F.lit(0.0)))


def confidence_gate(px: DataFrame, band_px: float = 6.0, conf_thr: float = 0.7) -> DataFrame:
    """Keep the band where the network is sure somewhere near; mark unsure pixels."""
    k = (int(band_px) | 1) + 4
    out = R.extreme_filter(px, F.col("conf"), k, "_c", "max")
    sure = F.col("_c") >= conf_thr
    return (out.withColumn("band", (F.col("E") > 0) & sure).withColumn("E", F.when(sure, F.col("E")).otherwise(0.0))
            .withColumn("ignore", F.col("conf") < conf_thr).drop("_c"))


def segments_of(labelled: DataFrame, by: Sequence[str] = ("frame",), min_len: float = 0.0) -> DataFrame:
    """One segment per region: the extent along its major axis."""
    by = list(by)
    s = labelled.groupBy(*by, "label").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("vxy"), F.count(F.lit(1)).alias("n"))
    ang = 0.5 * F.atan2(2.0 * F.round("vxy", 9), F.round(F.col("vx") - F.col("vy"), 9))
    s = s.withColumn("ux", F.cos(ang)).withColumn("uy", F.sin(ang))
    p = (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")
    g = labelled.join(s, [*by, "label"]).groupBy(*by, "label").agg(
        F.min(p).alias("lo"), F.max(p).alias("hi"), *[F.first(c).alias(c) for c in ("mx", "my", "ux", "uy", "n")])
    out = g.select(*by, "label", "n", (F.col("mx") + F.col("lo") * F.col("ux")).alias("x1"), (F.col("my") + F.col("lo") * F.col("uy")).alias("y1"),
                   (F.col("mx") + F.col("hi") * F.col("ux")).alias("x2"), (F.col("my") + F.col("hi") * F.col("uy")).alias("y2"))
    return out.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_len)
