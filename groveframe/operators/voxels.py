"""Voxel grids, neighbour cells, tree positions: operators that group points by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import centimetres
from ..functions.lineage import cut

ORIGIN = 200.0


def cell(value: Column, size: float, origin: float = ORIGIN) -> Column:
    return F.floor((value + F.lit(origin)) / F.lit(size)).cast("bigint")


def voxelize(points: DataFrame, size: float, label: str = "gt") -> DataFrame:
    """One row per occupied voxel: centroid, label of the first point, number of points. One shuffle, partial sums map-side."""
    keys = [cell(F.col(c), size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in "xyz"), F.min_by(label, "point_id").alias("label"), F.min("point_id").alias("point_id"), F.count("*").alias("n"))


def mean_centimetres(total: Column, n: Column) -> Column:
    """The mean of whole centimetres, in metres, rounded half to even on whole numbers: no order of partial sums changes it."""
    rest = F.pmod(total, n)
    below = F.call_function("div", total - rest, n)
    up = (2 * rest > n) | ((2 * rest == n) & (F.pmod(below, F.lit(2)) == 1))
    return (below + F.when(up, 1).otherwise(0)) / 100.0


def voxelize_exactly(points: DataFrame, size: float, label: str = "gt") -> DataFrame:
    """``voxelize`` with centroids to the centimetre, of points whose coordinates count to the centimetre."""
    keys = [cell(F.col(c), size).alias(f"v{c}") for c in "xyz"]
    sums = points.groupBy(*keys).agg(*(F.sum(centimetres(F.col(c))).alias(c) for c in "xyz"), F.min_by(label, "point_id").alias("label"), F.min("point_id").alias("point_id"), F.count("*").alias("n"))
    return sums.withColumns({c: mean_centimetres(F.col(c), F.col("n")) for c in "xyz"})


def voxel_members(points: DataFrame, size: float) -> DataFrame:
    """(vx, vy, vz, point_id): which points a voxel stands for."""
    return points.select(*(cell(F.col(c), size).alias(f"v{c}") for c in "xyz"), "point_id")


def first_per_cell(points: DataFrame, size: float) -> DataFrame:
    """The first point (by point_id) of each ground cell."""
    rows = points.groupBy(F.floor(F.col("x") / size).cast("bigint").alias("i"), F.floor(F.col("y") / size).cast("bigint").alias("j"))
    return rows.agg(F.min_by(F.struct("point_id", "x", "y"), "point_id").alias("p")).select("i", "j", "p.*")


def center(points: DataFrame) -> DataFrame:
    """Adds cx, cy, cz: coordinates less their global mean."""
    mean = points.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return points.crossJoin(F.broadcast(mean)).select(*points.columns, *((F.col(c) - F.col(f"m{c}")).alias(f"c{c}") for c in "xyz"))  # one row


def fill_missing_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Replaces NaN and null by the mean of the other values."""
    clean = df.withColumn(column, F.nanvl(F.col(column), F.lit(None)))
    return clean.crossJoin(F.broadcast(clean.agg(F.avg(column).alias("_mean")))).withColumn(column, F.coalesce(column, "_mean")).drop("_mean")


def dense_labels(df: DataFrame, label: str, start: int = 1) -> DataFrame:
    """(old, new): labels renumbered without gaps in ascending order; a null label gets none.

    The distinct labels are dealt into ranges and numbered within each, after the sizes of the ranges below it: no task takes all.
    """
    ranged = df.select(F.col(label).alias("old")).where("old is not null").distinct().repartitionByRange("old").withColumn("range", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    below = sizes.select("range", (F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start).alias("below"))  # one row a range
    place = F.row_number().over(W.partitionBy("range").orderBy("old")) - 1
    return ranged.withColumn("place", place).join(below, "range").select("old", (F.col("below") + F.col("place")).cast("bigint").alias("new"))


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``number``: the place of each row in its group by ``order``, from 1.

    Rows are dealt into ranges of (group, order) and numbered within each, after the rows of the group in lower ranges: a group
    may hold any part of the rows.
    """
    ranged = cut(df.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    below = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    named = sizes.withColumnsRenamed({group: "_g", "_range": "_r"})
    joined = ranged.join(named, ranged[group].eqNullSafe(named["_g"]) & (ranged["_range"] == named["_r"]))
    place = F.row_number().over(W.partitionBy(group, "_range").orderBy(order))
    return joined.withColumn("number", (place + F.col("_below")).cast("bigint")).drop("_g", "_r", "_range", "_below")


def relabel(df: DataFrame, label: str, start: int = 1) -> DataFrame:
    names = dense_labels(df, label, start).withColumnsRenamed({"old": label, "new": "_new"})
    return df.join(names, label).withColumn(label, F.col("_new")).drop("_new")


def kth_height(points: DataFrame, k: int, tree: str = "gt", largest: bool = False) -> DataFrame:
    """(tree, n, kth): the k-th smallest or largest z of each tree, null if it has fewer points.

    Each task keeps k values a tree before the shuffle: points are cut down within hashed shares of a tree first, so no task
    sorts a whole tree that holds a large part of the points.
    """
    order = F.col("z").desc() if largest else F.col("z").asc()
    shares = points.select(tree, "z", F.pmod(F.xxhash64("point_id"), F.lit(16)).alias("share"))
    few = shares.withColumn("rank", F.row_number().over(W.partitionBy(tree, "share").orderBy(order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy(tree).orderBy(order))).where(F.col("rank") == k)
    return points.groupBy(tree).agg(F.count("*").alias("n")).join(ranked.select(tree, F.col("z").alias("kth")), tree, "left")


def base_positions(points: DataFrame, tree: str = "gt") -> DataFrame:
    """Training position of each tree: mean of the points up to half a metre above the fourth lowest (the lowest for up to 11 points)."""
    low = points.groupBy(tree).agg(F.min("z").alias("zmin"))
    z0 = kth_height(points, 4, tree).join(low, tree).select(tree, F.when(F.col("n") > 11, F.col("kth")).otherwise(F.col("zmin")).alias("z0"))
    return points.join(z0, tree).where(F.col("z") <= F.col("z0") + 0.5).groupBy(tree).agg(*(F.avg(c).alias(f"b{c}") for c in "xyz"), F.first("z0").alias("z0"))


def evaluation_positions(points: DataFrame, tree: str = "gt") -> DataFrame:
    """Evaluation position of each tree: mean x and y of the lowest 30 cm."""
    low = points.groupBy(tree).agg(F.min("z").alias("zmin"))
    return points.join(low, tree).where(F.col("z") < F.col("zmin") + 0.3).groupBy(tree).agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.first("zmin").alias("zmin"))
