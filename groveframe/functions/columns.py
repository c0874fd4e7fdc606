"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label values: not labelled, not part of a tree. Trees are positive.
UNLABELLED, NON_TREE = -1, 0


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounds a double half to even at the given decimals."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def centimetres(value: Column) -> Column:
    """Integer key of a coordinate in centimetres."""
    return F.rint(value * F.lit(100.0)).cast("bigint")


def las_label(tree_id: Column, classification: Column) -> Column:
    """Ground and unclassified points are no trees even if they carry a tree id."""
    return F.when(classification.isin(1, 2), NON_TREE).when(tree_id != 0, tree_id).otherwise(UNLABELLED).cast("bigint")


def las_class(label: Column) -> Column:
    return F.when(label == NON_TREE, 2).otherwise(4)


def label_colour(label: Column) -> list[Column]:
    """Red, green and blue of a label by integer mixing; black for what is no tree."""
    return [F.when(label == NON_TREE, 0).otherwise(F.pmod(label * F.lit(k), F.lit(m)).cast("int")).alias(c) for c, k, m in (("red", 7919, 251), ("green", 104729, 241), ("blue", 1299709, 239))]


def tree_probability(sem0: Column, sem1: Column) -> Column:
    """Softmax of two logits, without overflow."""
    gap = sem1 - sem0
    return F.when(gap > 0, F.exp(-gap) / (F.exp(-gap) + 1.0)).otherwise(1.0 / (1.0 + F.exp(gap)))


def semantic_class(label: Column) -> Column:
    """1 for no tree, 0 for trees and unlabelled points."""
    return F.when(label == NON_TREE, 1).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for an empty denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal, half to even."""
    return F.rint(share * 1000.0) / 10.0


def edges_of(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]


def edge_array(edges: list[tuple[float, float, float, float]], nested: bool = False) -> Column:
    """Edges as one array value (or an array of arrays): a plan with a ring of any size stays a small one."""
    kind = "array<struct<ax:double,ay:double,bx:double,by:double>>"

    def text(part):
        return "[" + ",".join('{"ax":%r,"ay":%r,"bx":%r,"by":%r}' % tuple(map(float, e)) for e in part) + "]"

    return F.from_json(F.lit("[" + ",".join(map(text, edges)) + "]" if nested else text(edges)), f"array<{kind}>" if nested else kind)


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies within a polygon, its boundary excluded: crossing number over the edges of its band of the plane."""
    edges = edges_of(ring)
    low, high = min(e[1] for e in edges), max(e[1] for e in edges)
    n = max(1, len(edges) // 4)
    step = (high - low) / n or 1.0
    # a little overlap, so that an edge is in its band whatever the rounding
    bands = [[e for e in edges if min(e[1], e[3]) <= low + (k + 1) * step + 1e-9 * step and max(e[1], e[3]) >= low + k * step - 1e-9 * step] for k in range(n)]
    band = F.least(F.lit(n), F.greatest(F.lit(1), F.floor((y - low) / step).cast("int") + 1))

    def seen(s: Column, e: Column) -> Column:
        at = e.ax + (y - e.ay) * ((e.bx - e.ax) / (e.by - e.ay))
        crossed = (e.ay != e.by) & ((e.ay > y) != (e.by > y)) & (x < at)
        cross = (x - e.ax) * (e.by - e.ay) - (y - e.ay) * (e.bx - e.ax)
        border = (F.abs(cross) <= 1e-12) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))
        return F.struct((s.odd != F.coalesce(crossed, F.lit(False))).alias("odd"), (s.border | border).alias("border"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("border"))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(F.element_at(edge_array(bands, nested=True), band), start, seen, lambda s: s.odd & ~s.border))


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """Squared distance of a point from an edge (ax, ay, bx, by)."""
    dx, dy = e.bx - e.ax, e.by - e.ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.ax) * dx + (y - e.ay) * dy) / size))).otherwise(0.0)
    return F.pow(x - (e.ax + t * dx), 2.0) + F.pow(y - (e.ay + t * dy), 2.0)


def with_verticality(df: DataFrame) -> DataFrame:
    """Adds 1 - |n_z| for the eigenvector n of the smallest eigenvalue of a covariance (cxx, cyy, czz, cxy, cxz, cyz); null if undefined.

    Closed form: the trigonometric eigenvalue of a symmetric 3 x 3 matrix, then the longest cross product of two rows. It goes
    step by step, so no expression is repeated within another.
    """
    k = {n: F.col(n) for n in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")}
    out = df.withColumn("_q", (k["cxx"] + k["cyy"] + k["czz"]) / 3.0)
    q = F.col("_q")
    spread = sum(((k[d] - q) * (k[d] - q) for d in ("cxx", "cyy", "czz")), F.lit(0.0)) + 2.0 * sum((k[d] * k[d] for d in ("cxy", "cxz", "cyz")), F.lit(0.0))
    out = out.withColumn("_p", F.sqrt(spread / 6.0)).withColumns({f"_{d}": F.try_divide(k[d] - q if d in ("cxx", "cyy", "czz") else k[d], F.col("_p")) for d in k})
    xx, yy, zz, xy, xz, yz = (F.col(f"_{d}") for d in k)
    out = out.withColumn("_half", (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / 2.0)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_half")))) / 3.0
    out = out.withColumn("_low", q + 2.0 * F.col("_p") * F.cos(angle + 2.0943951023931953))
    low = F.col("_low")
    rows = [(k["cxx"] - low, k["cxy"], k["cxz"]), (k["cxy"], k["cyy"] - low, k["cyz"]), (k["cxz"], k["cyz"], k["czz"] - low)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (a, b, c), (d, e, f) = rows[i], rows[j]
        out = out.withColumns({f"_x{i}{j}": b * f - c * e, f"_y{i}{j}": c * d - a * f, f"_z{i}{j}": a * e - b * d})
    sides = [F.struct((F.col(f"_x{n}") * F.col(f"_x{n}") + F.col(f"_y{n}") * F.col(f"_y{n}") + F.col(f"_z{n}") * F.col(f"_z{n}")).alias("n"), (F.col(f"_z{n}") * F.col(f"_z{n}")).alias("z")) for n in ("01", "02", "12")]
    out = out.withColumn("_best", F.greatest(*sides))
    value = F.when((F.col("_p") > 1e-12) & (F.col("_best.n") > 1e-18), 1.0 - F.sqrt(F.col("_best.z") / F.col("_best.n")))
    return out.withColumn("verticality", value).select(*df.columns, "verticality")
