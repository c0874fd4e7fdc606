"""Overlapping square tiles, random rotated crops, occupancy grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TileGrid:
    """Tiles of width wx x wy, stepped by ``stride`` of a width, columns from x0 to the right, rows from y1 downwards."""

    x0: float
    y1: float
    wx: float
    wy: float
    cols: int
    rows: int
    stride: float


def half_even(x: float) -> int:
    return int(round(x))


def tile_grid(bounds: tuple[float, float, float, float], inner: float = 8.0, outer: float = 13.5, stride: float = 0.5) -> TileGrid:
    """Fits whole tiles into the data range widened by 1.5 times the outer edge."""
    xmin, xmax, ymin, ymax = bounds
    xmin, ymin = round(xmin - 1.5 * outer, 2), round(ymin - 1.5 * outer, 2)
    xmax, ymax = round(xmax + 1.5 * outer, 2), round(ymax + 1.5 * outer, 2)
    cols, rows = half_even((xmax - xmin - 2 * outer) / inner), half_even((ymax - ymin - 2 * outer) / inner)
    wx, wy = round((xmax - xmin - 2 * outer) / cols, 5), round((ymax - ymin - 2 * outer) / rows, 5)
    return TileGrid(xmin + outer, ymax - outer, wx, wy, int((cols - 1) / stride + 1), int((rows - 1) / stride + 1), stride)


def bounds_of(points: DataFrame) -> tuple[float, float, float, float]:
    return tuple(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())


def tile_bounds(spark, g: TileGrid) -> DataFrame:
    """(col, row, xlo, xhi, ylo, yhi, mx, my) of every tile."""
    grid = spark.range(g.cols * g.rows).select((F.col("id") % g.cols).alias("col"), F.floor(F.col("id") / g.cols).alias("row"))
    return grid.select("col", "row", *tile_edges(g))


def tile_edges(g: TileGrid) -> list[Column]:
    def r5(c: Column) -> Column:
        return F.rint(c * 1e5) / 1e5

    xlo, xhi = r5(F.lit(g.x0) + g.stride * F.col("col") * g.wx), r5(F.lit(g.x0) + (g.stride * F.col("col") + 1.0) * g.wx)
    yhi, ylo = r5(F.lit(g.y1) - g.stride * F.col("row") * g.wy), r5(F.lit(g.y1) - (g.stride * F.col("row") + 1.0) * g.wy)
    return [xlo.alias("xlo"), xhi.alias("xhi"), ylo.alias("ylo"), yhi.alias("yhi"), ((xlo + xhi) / 2.0).alias("mx"), ((ylo + yhi) / 2.0).alias("my")]


def assign_tiles(points: DataFrame, g: TileGrid, outer: float = 0.0) -> DataFrame:
    """Points with every tile that holds them: an arithmetic fan-out and a filter, no join.

    Without ``outer`` the inner squares (x in [lo, hi), y in (lo, hi]) count, with it the closed squares widened by it.
    """

    def span(u: Column, margin: float, last: int) -> Column:
        low = F.greatest(F.lit(0), F.floor((u - 1.0 - margin) / g.stride) - 1)
        high = F.least(F.lit(last - 1), F.ceil((u + margin) / g.stride) + 1)
        return F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    cols = span((F.col("x") - g.x0) / g.wx, outer / g.wx, g.cols)
    rows = span((F.lit(g.y1) - F.col("y")) / g.wy, outer / g.wy, g.rows)
    placed = points.withColumn("col", F.explode(cols)).withColumn("row", F.explode(rows)).select(*points.columns, "col", "row", *tile_edges(g))
    x, y = F.col("x"), F.col("y")
    if outer:
        return placed.where((x >= F.col("xlo") - outer) & (x <= F.col("xhi") + outer) & (y >= F.col("ylo") - outer) & (y <= F.col("yhi") + outer))
    return placed.where((x >= F.col("xlo")) & (x < F.col("xhi")) & (y > F.col("ylo")) & (y <= F.col("yhi")))


def assign_some_tiles(points: DataFrame, some: DataFrame, g: TileGrid, outer: float) -> DataFrame:
    """``assign_tiles`` for the tiles (col, row) of ``some`` alone, with ``outer``.

    Each point meets the list of those tiles that its piece of ground, one step of the tiles wide, has near it: points are joined before
    they fan out, so only they and the lists pass through a shuffle, not the points of all tiles.
    """
    tile, point = some, points
    for way, place, at, width in (("col", F.col("x") - g.x0, "_ci", g.wx), ("row", F.lit(g.y1) - F.col("y"), "_cj", g.wy)):
        step = g.stride * width
        # a little wider, since the edges of tiles are rounded
        more = (outer + 1e-4) / step + 1e-6
        tile = tile.withColumn(at, F.explode(F.sequence(F.floor(F.col(way) - more), F.floor(F.col(way) + 1 / g.stride + more))))
        point = point.withColumn(at, F.floor(place / step))
    near = tile.groupBy("_ci", "_cj").agg(F.collect_list(F.col("row") * g.cols + F.col("col")).alias("_tiles"))
    met = point.join(near, ["_ci", "_cj"]).withColumn("_tile", F.explode("_tiles"))
    met = met.select(*points.columns, F.pmod("_tile", F.lit(g.cols)).alias("col"), F.expr(f"_tile div {g.cols}").alias("row"))
    placed, x, y = met.select("*", *tile_edges(g)), F.col("x"), F.col("y")
    return placed.where((x >= F.col("xlo") - outer) & (x <= F.col("xhi") + outer) & (y >= F.col("ylo") - outer) & (y <= F.col("yhi") + outer))


def inner_mask(edge: float) -> Column:
    """Whether a point centred on its tile lies in the inner square of this edge."""
    return F.greatest(F.abs(F.col("x") - F.col("mx")), F.abs(F.col("y") - F.col("my"))) <= edge / 2


def candidates(spark, bounds: tuple[float, float, float, float], n: int, size: float) -> DataFrame:
    """n x n lattice of crop centres with an angle (degrees of a portable integer mix) and the bounding box of the turned square."""
    xmin, xmax, ymin, ymax = bounds
    sx, sy = (xmax - xmin) / max(1, n - 1), (ymax - ymin) / max(1, n - 1)
    base = spark.range(n * n).select(F.col("id").alias("crop"), (F.rint((F.lit(xmin) + (F.col("id") % n) * sx) * 100.0) / 100.0).alias("cx"), (F.rint((F.lit(ymin) + F.floor(F.col("id") / n) * sy) * 100.0) / 100.0).alias("cy"), ((F.col("id") * 7919 + 13) % 360).alias("angle"))
    a = F.radians(F.col("angle").cast("double"))
    reach = (F.abs(F.cos(a)) + F.abs(F.sin(a))) * (size / 2)
    return base.withColumn("reach", F.rint(reach * 1e6) / 1e6)


def turned(size: float) -> tuple[Column, Column]:
    """Coordinates of a point in the frame of a crop."""
    a, dx, dy = F.radians(F.col("angle").cast("double")), F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return F.cos(a) * dx + F.sin(a) * dy, F.cos(a) * dy - F.sin(a) * dx


def crop_points(points: DataFrame, crops: DataFrame, size: float, bin_size: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Points of every crop, in its frame (u, v): crops are sent to the ground bins their box touches, an equi-join on bins and the columns ``by``."""
    reach = (F.floor((F.col(c) + s * F.col("reach")) / bin_size).cast("bigint") for c, s in (("cx", -1), ("cx", 1), ("cy", -1), ("cy", 1)))
    x1, x2, y1, y2 = reach
    placed = crops.withColumn("bx", F.explode(F.sequence(x1, x2))).withColumn("by", F.explode(F.sequence(y1, y2)))
    binned = points.withColumn("bx", F.floor(F.col("x") / bin_size).cast("bigint")).withColumn("by", F.floor(F.col("y") / bin_size).cast("bigint"))
    u, v = turned(size)
    return binned.join(placed, [*by, "bx", "by"]).withColumn("u", u).withColumn("v", v).where(F.greatest(F.abs("u"), F.abs("v")) <= size / 2).drop("bx", "by")


def occupancy(points: DataFrame, bounds: tuple[float, float, float, float], res: float = 1.0, label: str = "gt") -> DataFrame:
    """(i, j, cx, cy, occ) of all cells: occupied if a labelled point lies in (low, high] of the cell."""
    xmin, xmax, ymin, ymax = bounds
    nx, ny = math.floor((xmax - xmin) / res), math.floor((ymax - ymin) / res)
    rx, ry = (xmax - xmin) / nx, (ymax - ymin) / ny
    hit = points.where(F.col(label) != -1).select((F.ceil((F.col("x") - xmin) / rx) - 1).cast("bigint").alias("i"), (F.ceil((F.col("y") - ymin) / ry) - 1).cast("bigint").alias("j")).distinct().withColumn("occ", F.lit(1))
    grid = points.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).cast("bigint").alias("j"))
    return grid.join(hit, ["i", "j"], "left").select("i", "j", (F.lit(xmin) + (F.col("i") + 0.5) * rx).alias("cx"), (F.lit(ymin) + (F.col("j") + 0.5) * ry).alias("cy"), F.coalesce("occ", F.lit(0)).alias("occ"))


def fill_holes(grid: DataFrame, reach: int, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Occupies empty cells whose neighbourhood (clamped at the border) is occupied to at least this share, within the columns ``by``."""
    frame = W.partitionBy(*by, "i").orderBy("j").rowsBetween(-reach, reach)
    down = grid.withColumn("s", F.sum("occ").over(frame)).withColumn("c", F.count("*").over(frame))
    across = W.partitionBy(*by, "j").orderBy("i").rowsBetween(-reach, reach)
    share = F.sum("s").over(across) / F.sum("c").over(across)
    return down.withColumn("share", share).select(*by, "i", "j", "cx", "cy", F.when((F.col("occ") == 0) & (F.col("share") >= least), 1).otherwise(F.col("occ")).alias("occ"))


def quotas(occupied: DataFrame, total: int) -> DataFrame:
    """(plot, quota): samples in proportion to occupied area; what rounding leaves goes to the last plot by name."""
    shares = occupied.select("plot", "occ", F.rint(F.col("occ") / F.sum("occ").over(W.partitionBy(F.lit(1))) * total).cast("bigint").alias("q"))
    every = W.partitionBy(F.lit(1))  # one row a plot
    return shares.select("plot", (F.col("q") + F.when(F.col("plot") == F.max("plot").over(every), F.lit(total) - F.sum("q").over(every)).otherwise(0)).alias("quota"))
