"""Random crops for training as one plan over all plots: where a plot is occupied, turned squares are laid on a lattice, those that
are covered well enough are candidates, each plot gives its share of the wanted number, and outliers are taken out of each crop.

    crops = training_crops(points, Crops())       # points: plot, point_id, x, y, z, label and anything else
    crops.write.partitionBy("plot", "crop").parquet(folder)

Every step is keyed by the plot, so plots of any number and size run in the same jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..operators import sampling, tiles, voxels
from ..operators.neighbours import knn, radius_outliers


@dataclass(frozen=True)
class Crops:
    """Number and edge of the crops, lattice steps a side, cells for occupancy and how they are filled and counted, outlier filters."""

    total: int = 25_000
    size: float = 35.0
    lattice: int = 100
    resolution: float = 1.0
    reach: int = 2
    least_filled: float = 0.3
    least_covered: float = 0.2
    draws: int | None = None
    sor_neighbours: int | None = None
    sor_multiplier: float = 2.0
    radius: float | None = None
    radius_neighbours: int = 12
    ignored: int = -1


def plot_grids(points: DataFrame, resolution: float) -> DataFrame:
    """(plot, xmin, ymin, xmax, ymax, nx, ny, rx, ry): the grid of whole cells over each plot."""
    ends = points.groupBy("plot").agg(*(f(c).alias(c + k) for c in "xy" for k, f in (("min", F.min), ("max", F.max))))
    for c in "xy":
        width = F.col(f"{c}max") - F.col(f"{c}min")
        ends = ends.withColumn(f"n{c}", F.greatest(F.lit(1), F.floor(width / resolution)).cast("bigint")).withColumn(f"r{c}", F.greatest(width, F.lit(1e-9)) / F.col(f"n{c}"))
    return ends


def occupancy(points: DataFrame, grids: DataFrame, p: Crops) -> DataFrame:
    """(plot, i, j, cx, cy, occ) of all cells, holes filled: occupied if a point of any label but the ignored one lies in (low, high] of the cell.

    With ``draws`` only so many points of each plot, drawn with replacement, are looked at.
    """
    seen = points.where(F.col("label") != p.ignored)
    if p.draws:
        seen = seen.join(sampling.draws(seen, "plot", "point_id", F.lit(1), F.lit(p.draws)).select("plot", "point_id").distinct(), ["plot", "point_id"], "left_semi")
    at = [(F.ceil((F.col(c) - F.col(f"{c}min")) / F.col(f"r{c}")) - 1).cast("bigint").alias(k) for c, k in (("x", "i"), ("y", "j"))]
    hit = seen.join(grids, "plot").select("plot", *at).distinct().withColumn("hit", F.lit(1))
    cells = grids.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1)))
    grid = cells.join(hit, ["plot", "i", "j"], "left").select("plot", "i", "j", (F.col("xmin") + (F.col("i") + 0.5) * F.col("rx")).alias("cx"), (F.col("ymin") + (F.col("j") + 0.5) * F.col("ry")).alias("cy"), F.coalesce("hit", F.lit(0)).alias("occ"))
    return tiles.fill_holes(grid, p.reach, p.least_filled, ("plot",))


def candidates(grids: DataFrame, p: Crops) -> DataFrame:
    """(plot, crop, cx, cy, angle, reach): the lattice of each plot."""
    n = p.lattice
    at = grids.withColumn("crop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n * n - 1).cast("bigint"))))
    for c, step in (("x", F.col("crop") % n), ("y", F.floor(F.col("crop") / n))):
        at = at.withColumn(f"c{c}", F.rint((F.col(f"{c}min") + step * ((F.col(f"{c}max") - F.col(f"{c}min")) / max(1, n - 1))) * 100.0) / 100.0)
    at = at.withColumn("angle", (F.col("crop") * 7919 + 13) % 360)
    a = F.radians(F.col("angle").cast("double"))
    return at.select("plot", "crop", "cx", "cy", "angle", (F.rint((F.abs(F.cos(a)) + F.abs(F.sin(a))) * (p.size / 2) * 1e6) / 1e6).alias("reach"))


def chosen_crops(points: DataFrame, p: Crops) -> DataFrame:
    """(plot, crop, cx, cy, angle, reach) of the crops taken: the quotas of the plots follow their occupied cells; a plot gives all it has if that is less."""
    grids = stored(plot_grids(points, p.resolution))
    cells = stored(occupancy(points, grids, p))
    quotas = tiles.quotas(cells.groupBy("plot").agg(F.sum("occ").alias("occ")), p.total)
    lattice = candidates(grids, p)
    covered = tiles.crop_points(cells.select("plot", F.col("cx").alias("x"), F.col("cy").alias("y"), "occ"), lattice, p.size, by=("plot",)).groupBy("plot", "crop").agg(F.sum("occ").alias("occ"))
    enough = covered.where(F.col("occ") * p.resolution**2 / p.size**2 > p.least_covered).select("plot", "crop")
    return sampling.chosen(lattice.join(enough, ["plot", "crop"]), "plot", F.lit(1.0), quotas, "plot", "crop")


def training_crops(points: DataFrame, p: Crops = Crops()) -> DataFrame:
    """The points of the chosen crops with plot, crop, cx, cy, angle and their place u, v in the crop, outliers of each crop left out."""
    found = tiles.crop_points(points, stored(chosen_crops(points, p)), p.size, by=("plot",)).drop("reach")
    if p.sor_neighbours:
        found = crop_inliers(stored(found), p.sor_neighbours, p.sor_multiplier)
    if p.radius:
        found = crowded(stored(found), p.radius, p.radius_neighbours)
    return found


#: Metres between crops that are laid out beside each other to find neighbours in all of them at once.
APART = 1e5


def apart(found: DataFrame) -> DataFrame:
    """(point_id, x, y, z, plot, crop, own): the points of all crops on one plane, crops far from each other, under 64-bit hashes as ids."""
    name = F.concat_ws(":", "plot", "crop")
    numbers = voxels.dense_labels(found.select(name.alias("name")), "name").withColumnRenamed("old", "name")
    placed = found.withColumn("name", name).join(numbers, "name")
    return stored(placed.select(F.xxhash64("plot", "crop", "point_id").alias("point_id"), (F.col("u") + F.col("new") * APART).alias("x"), F.col("v").alias("y"), "z", "plot", "crop", F.col("point_id").alias("own")))


def crop_inliers(found: DataFrame, neighbours: int, multiplier: float) -> DataFrame:
    """Points whose mean distance to their nearest ones in the crop is at most the crop's mean plus ``multiplier`` deviations."""
    moved = apart(found)
    near = knn(moved, moved, neighbours + 1, 1.0).where((F.col("id") != F.col("other")) & (F.col("d2") < APART * APART / 4))
    mean = stored(near.groupBy(F.col("id").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("m")).join(moved.select("point_id", "plot", "crop", "own"), "point_id"))
    limits = mean.groupBy("plot", "crop").agg((F.avg("m") + multiplier * F.stddev_pop("m")).alias("most"))
    kept = mean.join(limits, ["plot", "crop"]).where(F.col("m") <= F.col("most")).select("plot", "crop", F.col("own").alias("point_id"))
    return found.join(kept, ["plot", "crop", "point_id"], "left_semi")


def crowded(found: DataFrame, radius: float, least: int) -> DataFrame:
    """Points with more than ``least`` others of the crop within the radius."""
    kept = radius_outliers(apart(found), radius, least).select("plot", "crop", F.col("own").alias("point_id"))
    return found.join(kept, ["plot", "crop", "point_id"], "left_semi")
