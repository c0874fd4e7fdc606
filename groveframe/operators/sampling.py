"""Random choices that are the same on every attempt and partitioning: draws with replacement, weighted choices without, augmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import stored

def hashed(digits: int, *keys: Column) -> Column:
    """The first hexadecimal digits (15 at most) of the MD5 of the keys as a whole number; other engines give the same."""
    text = F.concat_ws(":", *(key.cast("string") for key in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) for keys and counters."""
    return (hashed(13, *keys) + 0.5) / float(1 << 52)


def normal(*keys: Column) -> Column:
    """A standard normal number for keys and a counter (the last, even)."""
    *first, counter = keys
    return F.sqrt(-2.0 * F.ln(uniform(*first, counter))) * F.cos(2 * math.pi * uniform(*first, counter + 1))


def draws(rows: DataFrame, group: str, order: str, weight: Column, n: Column) -> DataFrame:
    """(group, draw, order): ``n`` draws with replacement of each group, a row with the chance of its whole-number weight.

    Rows are dealt into ranges of (group, order); sums of weights run within ranges after those of the ranges below. A draw is a
    place among the weights of its group: the range is found in the list of the group's ranges, the row in the range as of the place.
    No task takes a group. Rows with a weight of 0 or null are never drawn; a group without weight has no draws.
    """
    weighed = rows.select(group, order, weight.cast("bigint").alias("_w"), n.cast("bigint").alias("_n")).where("_w > 0")
    ranged = stored(weighed.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(group, "_range").agg(F.sum("_w").alias("_sum"), F.max("_n").alias("_n"))
    below = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = stored(sums.withColumn("_below", F.coalesce(F.sum("_sum").over(below), F.lit(0))))
    groups = sums.groupBy(group).agg(F.sum("_sum").alias("_total"), F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_below", "_range"))).alias("_ranges"))
    asked = groups.where("_n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    asked = asked.withColumn("_at", F.pmod(hashed(15, F.col(group), F.col("draw")), F.col("_total")))
    asked = asked.select(group, F.element_at(F.filter("_ranges", lambda r: r["_below"] <= F.col("_at")), -1)["_range"].alias("_range"), "draw", "_at")
    inner = W.partitionBy(group, "_range").orderBy(order)
    placed = ranged.join(sums.select(group, "_range", "_below"), [group, "_range"])
    placed = placed.withColumn("_at", F.col("_below") + F.sum("_w").over(inner) - F.col("_w"))
    both = placed.select(group, "_range", "_at", F.lit(None).cast("bigint").alias("draw"), F.col(order).alias("_row")).unionByName(asked.select(group, "_range", "_at", "draw", F.lit(None).cast(rows.schema[order].dataType).alias("_row")))
    as_of = W.partitionBy(group, "_range").orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_row", F.last("_row", True).over(as_of)).where("draw is not null").select(group, "draw", F.col("_row").alias(order))


def chosen(rows: DataFrame, group: str, weight: Column, quotas: DataFrame, *keys: str) -> DataFrame:
    """At most ``quota`` (group, quota) rows of each group without replacement, in proportion to their weights: those of the smallest -ln(u) / weight."""
    key = -F.ln(uniform(*(F.col(k) for k in keys))) / weight
    ranked = rows.withColumn("_key", key).join(quotas.select(group, "quota"), group)
    order = W.partitionBy(group).orderBy("_key", *keys)
    return ranked.where("_key is not null").withColumn("_k", F.row_number().over(order)).where("_k <= quota").drop("_k", "_key", "quota")


def augmented(points: DataFrame, tile: str = "tile", jitter_prob: float = 0.25, prob: float = 0.5, sigma: float = 0.1, clip: float = 0.2) -> DataFrame:
    """Points (tile, point_id, x, y, z) of tiles shaken, scaled, sheared, mirrored and turned at random, the same for each (tile, point_id).

    Whether a tile is treated, and its matrix, follow from the tile alone; so it is one expression without a join.
    """
    t, p = F.col(tile), F.col("point_id")

    def coin(counter: int, chance: float) -> Column:
        return uniform(t, F.lit(counter)) < chance

    shaken = {c: F.col(c) + F.when(coin(1, jitter_prob), F.greatest(F.lit(-clip), F.least(F.lit(clip), sigma * normal(t, p, F.lit(2 * k))))).otherwise(0.0) for k, c in enumerate("xyz")}
    scale = [F.when(coin(2, prob), low + (high - low) * uniform(t, F.lit(10 + k))).otherwise(1.0) for k, (low, high) in enumerate(((0.8, 1.2), (0.8, 1.2), (0.95, 1.05)))]
    shear = F.when(coin(3, prob), 0.1).otherwise(0.0)
    m = [[(scale[i] if i == j else F.lit(0.0)) + shear * normal(t, F.lit(20 + 2 * (3 * i + j))) for j in range(3)] for i in range(3)]
    m[0][0] = m[0][0] * F.when(coin(4, prob) & (uniform(t, F.lit(50)) < 0.5), -1.0).otherwise(1.0)
    angle = F.when(coin(5, prob), 2 * math.pi * uniform(t, F.lit(51))).otherwise(0.0)
    cos, sin = F.cos(angle), F.sin(angle)
    # columns of the matrix after the turn about z
    turned = {"x": [r[0] * cos - r[1] * sin for r in m], "y": [r[0] * sin + r[1] * cos for r in m], "z": [r[2] for r in m]}
    rows = points.withColumns(shaken).withColumns({f"_{c}{i}": v for c, col in turned.items() for i, v in enumerate(col)})
    moved = {c: sum((F.col(a) * F.col(f"_{c}{i}") for i, a in enumerate("xyz")), F.lit(0.0)) for c in "xyz"}
    return rows.withColumns(moved).select(*points.columns)
