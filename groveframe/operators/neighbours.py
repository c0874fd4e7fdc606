"""Neighbourhoods by grid cells: radius join, k nearest neighbours, majority votes, outlier filters."""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import with_verticality
from ..functions.lineage import cut
from .voxels import cell


def around(axes: str, reach: int = 1):
    """Array of cell offsets up to ``reach`` along each axis."""
    steps = itertools.product(range(-reach, reach + 1), repeat=len(axes))
    return F.array(*(F.struct(*(F.lit(s).cast("bigint").alias(f"d{a}") for a, s in zip(axes, step, strict=True))) for step in steps))


def placed(df: DataFrame, axes: str) -> DataFrame:
    """The rows with a finite place: null, NaN and infinite coordinates have no cell, so such rows are near nothing."""
    return df.where(reduce(and_, (F.abs(a) < float("inf") for a in axes)))


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, other, d2, and the places and ``more`` columns of both, after l and r): all pairs within ``radius``; both sides have point_id and the axes.

    Cells are two radii wide. A left row is sent to the cells its ball meets, two along an axis at most, so it is an equi-join on
    cells; put the smaller side left. No pair is formed outside neighbouring cells. Rows without a finite place have no pairs.
    """
    size = 2 * radius
    near = placed(left, axes).select(F.col("point_id").alias("id"), *(F.col(a).alias(f"l{a}") for a in (*axes, *more)))
    for a in axes:
        # a little wider, so that no pair at exactly the radius is lost to rounding
        near = near.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(f"l{a}") - radius * 1.000001, size), cell(F.col(f"l{a}") + radius * 1.000001, size))))
    there = placed(right, axes).select(F.col("point_id").alias("other"), *(F.col(a).alias(f"r{a}") for a in (*axes, *more)), *(cell(F.col(a), size).alias(f"c{a}") for a in axes))
    return near.join(there, [f"c{a}" for a in axes]).select("id", "other", squared(axes).alias("d2"), *(F.col(f"{k}{a}") for k in "lr" for a in (*axes, *more))).where(F.col("d2") <= radius * radius)


def squared(axes: str):
    return reduce(add, ((F.col(f"l{a}") - F.col(f"r{a}")) * (F.col(f"l{a}") - F.col(f"r{a}")) for a in axes))


def neighbour_verticality(points: DataFrame, radius: float) -> DataFrame:
    """(point_id, n, verticality): shape of the neighbourhood of each point; sums are taken around the point to stay exact."""
    pairs = radius_join(points, points, radius).select("id", *("r" + a for a in "xyz"))
    cov = {f"c{a}{b}": F.covar_pop(f"r{a}", f"r{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    got = pairs.groupBy("id").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in cov.items()))
    return with_verticality(got).select(F.col("id").alias("point_id"), "n", F.when(F.col("n") > 2, F.col("verticality")).alias("verticality"))


def radius_outliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Keeps points with more than ``least`` neighbours within the radius (itself not counted)."""
    counts = radius_join(points, points, radius).groupBy("id").agg((F.count("*") - 1).alias("n")).where(F.col("n") > least)
    return points.join(counts.select(F.col("id").alias("point_id")), "point_id", "left_semi")


def knn(queries: DataFrame, sources: DataFrame, k: int, size: float, axes: str = "xyz") -> DataFrame:
    """(id, other, d2, rank): the k nearest sources of each query, ties by source id; all of them if there are fewer than k.

    Most queries have k sources within ``size``, which makes their answer final. The others go down a pyramid of cells, from one
    that holds everything to cells of this size: at each level a query keeps only the cells that may hold one of its k nearest.
    So every query ends after one step a level, and none meets more than a few cells of sources at a time.

    Where cells of this size hold many sources, each query starts from the smallest cell around it that holds k of them.
    Queries and sources without a finite place (a null coordinate) have no neighbours and are nobody's.
    """
    queries, sources = placed(queries, axes).select("point_id", *axes), placed(sources, axes).select("point_id", *axes)
    total = min(k, sources.limit(k).count())
    if total == 0:
        ids = queries.select(F.col("point_id").alias("id")).crossJoin(sources.select(F.col("point_id").alias("other")))
        return ids.select("id", "other", F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    order = W.partitionBy("id").orderBy("d2", "other")
    parts = [radius_join(part, sources, reach, axes).select("id", "other", "d2") for part, reach in by_density(queries, sources, total, size, axes)]
    found = cut(reduce(DataFrame.unionByName, parts).select("id", "other", "d2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    # all pairs within the radius were seen: a query with enough of them is final
    final = found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= total).select("id")
    left = cut(queries.join(final.withColumnRenamed("id", "point_id"), "point_id", "left_anti"))
    if left.isEmpty():
        return found
    return found.join(final, "id", "left_semi").unionByName(by_pyramid(left, sources, total, k, size, axes))


#: Sources of a cell from which queries look into smaller cells, and how often cells are halved.
DENSE, HALVINGS = 256, 12


def by_density(queries: DataFrame, sources: DataFrame, total: int, size: float, axes: str) -> list[tuple[DataFrame, float]]:
    """The queries in parts, each with the radius to look within: ``size``, or less where a smaller cell holds enough sources."""

    def at(df: DataFrame, step: float) -> list:
        return [cell(F.col(a), step).alias(f"c{a}") for a in axes]

    keys = [f"c{a}" for a in axes]
    most = sources.groupBy(*at(sources, size)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most <= DENSE:
        return [(queries, size)]
    counts = cut(sources.groupBy(*at(sources, size / 2**HALVINGS)).agg(F.count("*").alias("n")))
    halved = counts.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))).groupBy("h", *(F.expr(f"shiftright({c}, {HALVINGS} - h)").alias(c) for c in keys)).agg(F.sum("n").alias("n"))
    own = queries.select("point_id", *at(queries, size / 2**HALVINGS), F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("h"))
    own = own.select("point_id", "h", *(F.expr(f"shiftright({c}, {HALVINGS} - h)").alias(c) for c in keys))
    deepest = own.join(halved.where(F.col("n") >= total), ["h", *keys]).groupBy("point_id").agg(F.max("h").alias("h"))
    levelled = cut(queries.join(deepest, "point_id", "left").withColumn("h", F.coalesce("h", F.lit(0))))
    steps = sorted(r["h"] for r in levelled.select("h").distinct().collect())
    return [(levelled.where(F.col("h") == h).drop("h"), size if h == 0 else size / 2**h * len(axes) ** 0.5 * 1.000001) for h in steps]


def by_pyramid(queries: DataFrame, sources: DataFrame, total: int, k: int, size: float, axes: str) -> DataFrame:
    """knn for any queries, however far they lie from the sources; ``total`` is the number of neighbours that each has."""
    ends = sources.agg(*(f(a).alias(f"{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))).first()
    levels = max(1, math.ceil(math.log2(max(max(ends[f"high{a}"] - ends[f"low{a}"] for a in axes) / size, 1.0))))
    keys = [f"c{a}" for a in axes]
    numbered = sources.select(F.col("point_id").alias("other"), *(F.col(a).alias(f"r{a}") for a in axes), *(F.floor((F.col(a) - ends[f"low{a}"]) / size).cast("bigint").alias(f"c{a}") for a in axes))
    counts = cut(numbered.groupBy(*keys).agg(F.count("*").alias("n")))

    def level(j: int) -> DataFrame:
        return counts.groupBy(*(F.shiftright(c, j).alias(c) for c in keys)).agg(F.sum("n").alias("n"))

    def kept(cells: DataFrame, j: int) -> DataFrame:
        """The cells of a query that are no farther than the farthest corner of those that hold enough sources."""
        step, near, far = size * 2**j, [], []
        for a in axes:
            low = F.col(f"c{a}") * step + ends[f"low{a}"]
            gap = F.greatest(low - F.col(f"l{a}"), F.col(f"l{a}") - low - step, F.lit(0.0))
            reach = F.greatest(F.abs(F.col(f"l{a}") - low), F.abs(F.col(f"l{a}") - low - step))
            near.append(gap * gap)
            far.append(reach * reach)
        sums = W.partitionBy("id").orderBy("far").rangeBetween(W.unboundedPreceding, 0)
        seen = cells.withColumn("near", reduce(add, near)).withColumn("far", reduce(add, far)).withColumn("sum", F.sum("n").over(sums))
        limit = F.min(F.when(F.col("sum") >= total, F.col("far"))).over(W.partitionBy("id"))
        # the sides of cells are rounded: a little more than the bound
        return seen.withColumn("limit", limit).where(F.col("near") <= F.col("limit") * 1.000001 + 1e-12).select("id", *(f"l{a}" for a in axes), *keys)

    top = F.array(*(F.struct(*(F.lit(v).cast("bigint").alias(c) for c, v in zip(keys, cell, strict=True))) for cell in itertools.product((0, 1), repeat=len(axes))))
    at = queries.select(F.col("point_id").alias("id"), *(F.col(a).alias(f"l{a}") for a in axes), F.explode(top).alias("t")).select("id", *(f"l{a}" for a in axes), *(f"t.{c}" for c in keys))
    at = kept(at.join(level(levels), keys), levels)
    for j in range(levels - 1, -1, -1):
        children = level(j).select(*(F.col(c).alias(f"own_{c}") for c in keys), "n", *(F.shiftright(c, 1).alias(c) for c in keys))
        at = at.join(children, keys).select("id", *(f"l{a}" for a in axes), *(F.col(f"own_{c}").alias(c) for c in keys), "n")
        at = kept(at, j)
    order = W.partitionBy("id").orderBy("d2", "other")
    pairs = at.join(numbered, keys).select("id", "other", squared(axes).alias("d2"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def majority(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): most frequent label of the found sources (source_id, label), the lowest on ties."""
    return found.join(labels.withColumnRenamed("source_id", "other"), "other").groupBy("id").agg(F.mode("label", True).alias("label"))


def statistical_outliers(points: DataFrame, k: int, multiplier: float, size: float) -> DataFrame:
    """Keeps points whose mean distance to k neighbours is at most the global mean plus ``multiplier`` deviations."""
    found = knn(points, points, k + 1, size).where("id != other").where(F.col("rank") <= k + 1)
    mean = found.groupBy("id").agg(F.avg(F.sqrt("d2")).alias("m"))
    limit = mean.agg((F.avg("m") + multiplier * F.stddev_pop("m")).alias("top"))
    kept = mean.crossJoin(F.broadcast(limit)).where(F.col("m") <= F.col("top")).select(F.col("id").alias("point_id"))
    return points.join(kept, "point_id", "left_semi")
