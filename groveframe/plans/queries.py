"""Queries over the derived forest, one per operator, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Grouping, Sampling
from ..functions import columns as c
from ..functions.lineage import folder
from ..operators import clustering, evaluation, hulls, neighbours, predictions, sampling, tiles, voxels
from ..sources.tile_store import read_tiles, write_tiles
from . import crops, segmentation
from .forest import oracle, points, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **parts: str):
    """Registers a function of the points under the id of its operator."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(points(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, **parts)
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Rounds floats for comparison; the small shift keeps exact ties, which sums in another order may miss, off the boundary."""
    return df.withColumns({n: c.half_even(F.col(n) + 3.1e-3 * 10.0**-digits, digits) for n in names})


def id_type(p: DataFrame) -> str:
    return p.schema["point_id"].dataType.simpleString()


def las_like(p: DataFrame) -> DataFrame:
    return p.select("point_id", "x", "y", "z", F.greatest("gt", F.lit(0)).alias("tree_id"), F.when(F.col("gt") == -1, 3).when(F.col("gt") == 0, 2).otherwise(4).alias("classification"))


def with_offsets(p: DataFrame) -> DataFrame:
    """Simulated model outputs: offsets to the tree with a small error, logits that are wrong for some points."""
    error = ((F.col("point_id") % 21) - 10) / 1000.0
    sign = F.when(F.col("point_id") % 97 == 0, -1.0).otherwise(1.0) * F.when(F.col("gt") == 0, -2.0).otherwise(2.0)
    return p.withColumns({"dx": F.col("x0") - F.col("x") + error, "dy": F.col("y0") - F.col("y") + error, "dz": -F.col("z") + error, "sem0": sign, "sem1": -sign})


OFFSETS = """SELECT *, x0 - x + e AS dx, y0 - y + e AS dy, -z + e AS dz, s AS sem0, -s AS sem1 FROM
  (SELECT *, ((point_id % 21) - 10) / 1000e0 AS e, CASE WHEN point_id % 97 = 0 THEN -1e0 ELSE 1e0 END * CASE WHEN gt = 0 THEN -2e0 ELSE 2e0 END AS s FROM points)"""

# --- sources, projections ---------------------------------------------------------------------------------------------


@query("SC5", "SELECT point_id, gt AS label FROM points")
def sc5(p):
    return las_like(p).select("point_id", c.las_label(F.col("tree_id"), F.col("classification")).alias("label"))


@query("SC7", "SELECT CAST(-1 AS BIGINT) AS label, count(*) AS n FROM points GROUP BY 1")
def sc7(p):
    return p.select(F.coalesce(F.lit(None).cast("bigint"), F.lit(-1).cast("bigint")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("PJ1", f"SELECT point_id, {r('x - mx')} AS cx, {r('y - my')} AS cy, {r('z - mz')} AS cz FROM points, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points)")
def pj1(p):
    return rounded(voxels.center(p).select("point_id", "cx", "cy", "cz"), "cx", "cy", "cz")


@query("PJ2", "SELECT point_id, CAST(round_even(x * 123e0, 0) AS BIGINT) AS xi, CAST(round_even(y * 123e0, 0) AS BIGINT) AS yi, round_even(z * 37e0, 0) / 1e2 AS zr FROM points")
def pj2(p):
    return p.select("point_id", F.rint(F.col("x") * 123.0).cast("bigint").alias("xi"), F.rint(F.col("y") * 123.0).cast("bigint").alias("yi"), (F.rint(F.col("z") * 37.0) / 100.0).alias("zr"))


@query("PJ3", "SELECT point_id, round_even(CAST(CAST(x * 1.7e0 AS FLOAT) AS DOUBLE) * 100e0, 0) / 100e0 AS x32 FROM points")
def pj3(p):
    return p.select("point_id", c.half_even((F.col("x") * 1.7).cast("float").cast("double")).alias("x32"))


@query("PJ4", "SELECT plot, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points GROUP BY plot")
def pj4(p):
    return p.groupBy("plot").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


@query("PJ8", "SELECT CASE WHEN gt = 0 THEN 1 ELSE 0 END AS class, count(*) AS n FROM points GROUP BY 1")
def pj8(p):
    return p.groupBy(c.semantic_class(F.col("gt")).alias("class")).agg(F.count("*").alias("n"))


@query("PJ10", f"SELECT point_id, {r('1e0 / (1e0 + exp(sem1 - sem0))', 6)} AS p_tree FROM o", o=OFFSETS)
def pj10(p):
    return rounded(with_offsets(p).select("point_id", c.tree_probability(F.col("sem0"), F.col("sem1")).alias("p_tree")), "p_tree", digits=6)


@query("PJ11", f"SELECT point_id, {r('x + dx')} AS sx, {r('y + dy')} AS sy FROM o", o=OFFSETS)
def pj11(p):
    return rounded(with_offsets(p).select("point_id", (F.col("x") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("sy")), "sx", "sy")


@query("PJ16", "SELECT gt, CASE WHEN gt = 0 THEN 2 ELSE 4 END AS class, CASE WHEN gt = 0 THEN 0 ELSE CAST(((gt * 7919) % 251 + 251) % 251 AS INTEGER) END AS red, count(*) AS n FROM points GROUP BY ALL")
def pj16(p):
    return p.groupBy("gt", c.las_class(F.col("gt")).alias("class"), c.label_colour(F.col("gt"))[0]).agg(F.count("*").alias("n"))


QUOTED = '"by"'
BASE = """SELECT l.gt, avg(x) AS bx, avg(y) AS "by", avg(z) AS bz FROM points p JOIN
  (SELECT gt, CASE WHEN count(*) > 11 THEN max(CASE WHEN k = 4 THEN z END) ELSE min(z) END AS z0 FROM (SELECT gt, z, row_number() OVER (PARTITION BY gt ORDER BY z) AS k FROM points WHERE gt > 0) GROUP BY gt) l
  ON p.gt = l.gt AND p.z <= l.z0 + 5e-1 GROUP BY l.gt"""


@query("PJ15", f"SELECT point_id, {r('bx - x')} AS ox, {r(QUOTED + ' - y')} AS oy, {r('bz - z')} AS oz FROM points LEFT JOIN b USING (gt)", b=BASE)
def pj15(p):
    placed = p.join(voxels.base_positions(p.where("gt > 0")), "gt", "left")
    return rounded(placed.select("point_id", *((F.col(f"b{a}") - F.col(a)).alias(f"o{a}") for a in "xyz")), "ox", "oy", "oz")


# --- filters ----------------------------------------------------------------------------------------------------------


@query("FP4", "SELECT count(*) AS n, count(DISTINCT gt) AS trees FROM o WHERE 1e0 / (1e0 + exp(sem1 - sem0)) >= 5e-1 AND z / 2.6e1 > 1e-1 AND abs(dz) < 1.2e1", o=OFFSETS)
def fp4(p):
    o = with_offsets(p).withColumn("p_tree", c.tree_probability(F.col("sem0"), F.col("sem1")))
    return o.where((F.col("p_tree") >= 0.5) & (F.col("z") / 26.0 > 0.1) & (F.abs("dz") < 12.0)).agg(F.count("*").alias("n"), F.countDistinct("gt").alias("trees"))


@query("FP5", "SELECT gt <> -1 AS kept, count(*) AS n FROM points GROUP BY 1")
def fp5(p):
    return p.groupBy((F.col("gt") != -1).alias("kept")).agg(F.count("*").alias("n"))


@query("FP16", "SELECT pred, count(*) AS n FROM points WHERE pred > 0 GROUP BY pred HAVING count(*) >= 580")
def fp16(p):
    return p.where("pred > 0").groupBy("pred").agg(F.count("*").alias("n")).where(F.col("n") >= 580)


@query("FP19", f"SELECT point_id, {r('coalesce(f, m)', 6)} AS f FROM (SELECT point_id, CASE WHEN point_id % 7 = 0 THEN NULL ELSE z END AS f FROM points), (SELECT avg(z) AS m FROM points WHERE point_id % 7 <> 0)")
def fp19(p):
    broken = p.select("point_id", F.when(F.col("point_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("z")).alias("f"))
    return rounded(voxels.fill_missing_with_mean(broken, "f"), "f", digits=6)


# --- tiles and crops --------------------------------------------------------------------------------------------------

GRID = """SELECT x0 + 0e0 AS gx, y1 AS gy, wx, wy, CAST(trunc((c - 1) / 5e-1 + 1) AS BIGINT) AS cols, CAST(trunc((w - 1) / 5e-1 + 1) AS BIGINT) AS rows FROM (
  SELECT xmin + 135e-1 AS x0, ymax - 135e-1 AS y1, c, w, round_even((xmax - xmin - 27e0) / c, 5) AS wx, round_even((ymax - ymin - 27e0) / w, 5) AS wy FROM (
  SELECT *, round_even((xmax - xmin - 27e0) / 8e0, 0) AS c, round_even((ymax - ymin - 27e0) / 8e0, 0) AS w FROM (
  SELECT round(min(x) - 2025e-2, 2) AS xmin, round(max(x) + 2025e-2, 2) AS xmax, round(min(y) - 2025e-2, 2) AS ymin, round(max(y) + 2025e-2, 2) AS ymax FROM points)))"""
TILES = """SELECT col, row, round_even((gx + 5e-1 * col * wx) * 1e5, 0) / 1e5 AS xlo, round_even((gx + (5e-1 * col + 1e0) * wx) * 1e5, 0) / 1e5 AS xhi,
  round_even((gy - 5e-1 * row * wy) * 1e5, 0) / 1e5 AS yhi, round_even((gy - (5e-1 * row + 1e0) * wy) * 1e5, 0) / 1e5 AS ylo
  FROM g, (SELECT unnest(range(2000)) AS col) c, (SELECT unnest(range(2000)) AS row) w WHERE col < cols AND row < rows"""


def grid_of(p: DataFrame) -> tiles.TileGrid:
    return tiles.tile_grid(tiles.bounds_of(p))


@query("TL1", f"SELECT col, row, {r('xlo')} AS xlo, {r('xhi')} AS xhi, {r('ylo')} AS ylo, {r('yhi')} AS yhi FROM t", g=GRID, t=TILES)
def tl1(p):
    return rounded(tiles.tile_bounds(p.sparkSession, grid_of(p)).select("col", "row", "xlo", "xhi", "ylo", "yhi"), "xlo", "xhi", "ylo", "yhi")


@query("JN1", "SELECT col, row, count(*) AS n, sum(point_id % 1000) AS ids FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi GROUP BY col, row", g=GRID, t=TILES)
def jn1(p):
    return tiles.assign_tiles(p, grid_of(p)).groupBy("col", "row").agg(F.count("*").alias("n"), F.sum(F.col("point_id") % 1000).alias("ids"))


@query("FP1", "SELECT col, row, count(*) AS n FROM points JOIN t ON x >= xlo - 135e-1 AND x <= xhi + 135e-1 AND y >= ylo - 135e-1 AND y <= yhi + 135e-1 GROUP BY col, row", g=GRID, t=TILES)
def fp1(p):
    return tiles.assign_tiles(p.select("point_id", "x", "y"), grid_of(p), 13.5).groupBy("col", "row").agg(F.count("*").alias("n"))


@query("FP2", "SELECT count(*) AS tiles FROM (SELECT DISTINCT col, row FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi)", g=GRID, t=TILES)
def fp2(p):
    return tiles.assign_tiles(p, grid_of(p)).select("col", "row").distinct().agg(F.count("*").alias("tiles"))


@query("FP3", "SELECT count(*) AS n FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi WHERE greatest(abs(x - (xlo + xhi) / 2e0), abs(y - (ylo + yhi) / 2e0)) <= 3e0", g=GRID, t=TILES)
def fp3(p):
    return tiles.assign_tiles(p, grid_of(p)).where(tiles.inner_mask(6.0)).agg(F.count("*").alias("n"))


@query("PJ12", f"SELECT point_id, col, row, {r('x - (xlo + xhi) / 2e0')} AS tx, {r('y - (ylo + yhi) / 2e0')} AS ty FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi", g=GRID, t=TILES)
def pj12(p):
    placed = tiles.assign_tiles(p.select("point_id", "x", "y"), grid_of(p))
    return rounded(placed.select("point_id", "col", "row", (F.col("x") - F.col("mx")).alias("tx"), (F.col("y") - F.col("my")).alias("ty")), "tx", "ty")


CROPS = """SELECT id AS crop, round_even((xmin + (id % 12) * ((xmax - xmin) / 11e0)) * 100e0, 0) / 100e0 AS cx, round_even((ymin + (id // 12) * ((ymax - ymin) / 11e0)) * 100e0, 0) / 100e0 AS cy, (id * 7919 + 13) % 360 AS angle
  FROM (SELECT unnest(range(144)) AS id), (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points)"""
TURNED = "SELECT *, cos(radians(angle)) * (x - cx) + sin(radians(angle)) * (y - cy) AS u, cos(radians(angle)) * (y - cy) - sin(radians(angle)) * (x - cx) AS v FROM points JOIN crops ON abs(x - cx) <= 6e0 AND abs(y - cy) <= 6e0"


def lattice(p: DataFrame, size: float) -> DataFrame:
    return tiles.candidates(p.sparkSession, tiles.bounds_of(p), 12, size)


@query("SO7", "SELECT crop, cx, cy, angle FROM crops", crops=CROPS)
def so7(p):
    return lattice(p, 8.0).select("crop", "cx", "cy", "angle")


@query("PJ5", f"SELECT crop, k, {r('cx + 4e0 * (cos(radians(angle)) * sx - sin(radians(angle)) * sy)', 3)} AS vx, {r('cy + 4e0 * (sin(radians(angle)) * sx + cos(radians(angle)) * sy)', 3)} AS vy FROM crops, (VALUES (0, -1e0, -1e0), (1, 1e0, -1e0), (2, 1e0, 1e0), (3, -1e0, 1e0)) s(k, sx, sy)", crops=CROPS)
def pj5(p):
    corners = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for k, (x, y) in enumerate(((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)))))
    a = F.radians(F.col("angle").cast("double"))
    out = lattice(p, 8.0).withColumn("s", F.explode(corners)).select("crop", "s.k", (F.col("cx") + 4.0 * (F.cos(a) * F.col("s.sx") - F.sin(a) * F.col("s.sy"))).alias("vx"), (F.col("cy") + 4.0 * (F.sin(a) * F.col("s.sx") + F.cos(a) * F.col("s.sy"))).alias("vy"))
    return rounded(out, "vx", "vy", digits=3)


@query("JN2", "SELECT crop, count(*) AS n, sum(point_id % 1000) AS ids FROM u WHERE greatest(abs(u), abs(v)) <= 4e0 GROUP BY crop", crops=CROPS, u=TURNED)
def jn2(p):
    return tiles.crop_points(p.select("point_id", "x", "y"), lattice(p, 8.0), 8.0).groupBy("crop").agg(F.count("*").alias("n"), F.sum(F.col("point_id") % 1000).alias("ids"))


@query("PJ6", f"SELECT crop, point_id, {r('u', 3)} AS u, {r('v', 3)} AS v FROM u WHERE greatest(abs(u), abs(v)) <= 4e0", crops=CROPS, u=TURNED)
def pj6(p):
    return rounded(tiles.crop_points(p.select("point_id", "x", "y"), lattice(p, 8.0), 8.0).select("crop", "point_id", "u", "v"), "u", "v", digits=3)


OCC = """SELECT i, j, xmin + (i + 5e-1) * rx AS cx, ymin + (j + 5e-1) * ry AS cy, CASE WHEN h THEN 1 ELSE 0 END AS occ FROM
  (SELECT *, (xmax - xmin) / nx AS rx, (ymax - ymin) / ny AS ry FROM (SELECT *, floor(xmax - xmin) AS nx, floor(ymax - ymin) AS ny FROM (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points))) b
  JOIN (SELECT unnest(range(3000)) AS i) a ON i < nx JOIN (SELECT unnest(range(3000)) AS j) c ON j < ny
  LEFT JOIN (SELECT DISTINCT true AS h, CAST(ceil((x - xmin) / ((xmax - xmin) / floor(xmax - xmin))) - 1 AS BIGINT) AS hi, CAST(ceil((y - ymin) / ((ymax - ymin) / floor(ymax - ymin))) - 1 AS BIGINT) AS hj
     FROM points, (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points) WHERE gt <> -1) q ON hi = i AND hj = j"""
FILLED = """SELECT a.i, a.j, a.cx, a.cy, CASE WHEN a.occ = 0 AND sum(b.occ) / count(*) >= 3e-1 THEN 1 ELSE a.occ END AS occ FROM occ a JOIN occ b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j, a.cx, a.cy, a.occ"""


@query("AG18", "SELECT i, j, occ FROM occ", occ=OCC)
def ag18(p):
    return tiles.occupancy(p, tiles.bounds_of(p)).select("i", "j", "occ")


@query("AG19", "SELECT i, j, occ FROM filled", occ=OCC, filled=FILLED)
def ag19(p):
    return tiles.fill_holes(tiles.occupancy(p, tiles.bounds_of(p)), 2, 0.3).select("i", "j", "occ")


@query("JN3", "SELECT crop, count(*) AS cells, sum(occ) AS occupied FROM (SELECT *, cos(radians(angle)) * (f.cx - c.cx) + sin(radians(angle)) * (f.cy - c.cy) AS u, cos(radians(angle)) * (f.cy - c.cy) - sin(radians(angle)) * (f.cx - c.cx) AS v FROM filled f JOIN crops c ON abs(f.cx - c.cx) <= 8e0 AND abs(f.cy - c.cy) <= 8e0) WHERE greatest(abs(u), abs(v)) <= 5e0 GROUP BY crop", occ=OCC, filled=FILLED, crops=CROPS)
def jn3(p):
    return cells_of_crops(p).groupBy("crop").agg(F.count("*").alias("cells"), F.sum("occ").alias("occupied"))


def cells_of_crops(p):
    cells = tiles.fill_holes(tiles.occupancy(p, tiles.bounds_of(p)), 2, 0.3).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("occ").cast("bigint").alias("occ"))
    return tiles.crop_points(cells, lattice(p, 10.0), 10.0)


@query("FP9", "SELECT crop FROM (SELECT *, cos(radians(angle)) * (f.cx - c.cx) + sin(radians(angle)) * (f.cy - c.cy) AS u, cos(radians(angle)) * (f.cy - c.cy) - sin(radians(angle)) * (f.cx - c.cx) AS v FROM filled f JOIN crops c ON abs(f.cx - c.cx) <= 8e0 AND abs(f.cy - c.cy) <= 8e0) WHERE greatest(abs(u), abs(v)) <= 5e0 GROUP BY crop HAVING sum(occ) / 100e0 > 2e-1", occ=OCC, filled=FILLED, crops=CROPS)
def fp9(p):
    return cells_of_crops(p).groupBy("crop").agg(F.sum("occ").alias("s")).where(F.col("s") / 100.0 > 0.2).select("crop")


@query("AG20", "SELECT plot, CAST(q + CASE WHEN plot = max(plot) OVER () THEN 1000 - sum(q) OVER () ELSE 0 END AS BIGINT) AS quota FROM (SELECT plot, CAST(round_even(n / (sum(n) OVER ()) * 1000, 0) AS BIGINT) AS q FROM (SELECT plot, count(*) AS n FROM points GROUP BY plot))")
def ag20(p):
    return tiles.quotas(p.groupBy("plot").agg(F.count("*").alias("occ")), 1000)


@query("SO4", "SELECT crop FROM crops ORDER BY (crop * 7919 + 104729) % 1009, crop LIMIT 20", crops=CROPS)
def so4(p):
    return lattice(p, 8.0).orderBy((F.col("crop") * 7919 + 104729) % 1009, "crop").limit(20).select("crop")


# --- voxels, neighbourhoods -------------------------------------------------------------------------------------------


@query("AG1", f"SELECT CAST(floor((x + 200e0) / 5e-1) AS BIGINT) AS vx, CAST(floor((y + 200e0) / 5e-1) AS BIGINT) AS vy, CAST(floor((z + 200e0) / 5e-1) AS BIGINT) AS vz, {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z, arg_min(gt, point_id) AS label, count(*) AS n FROM points GROUP BY 1, 2, 3")
def ag1(p):
    return rounded(voxels.voxelize(p, 0.5).select("vx", "vy", "vz", "x", "y", "z", "label", "n"), "x", "y", "z")


@query("WN4", "SELECT CAST(floor(x / 25e-2) AS BIGINT) AS i, CAST(floor(y / 25e-2) AS BIGINT) AS j, min(point_id) AS point_id FROM points GROUP BY 1, 2")
def wn4(p):
    return voxels.first_per_cell(p, 0.25).select("i", "j", "point_id")


NEAR = """SELECT a.point_id AS id, b.point_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.x, b.y, b.z FROM
  (SELECT *, floor(x / 6e-1) + dx AS i, floor(y / 6e-1) + dy AS j, floor(z / 6e-1) + dz AS k FROM points, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy), (VALUES (-1), (0), (1)) s(dz)) a
  JOIN (SELECT *, floor(x / 6e-1) AS i, floor(y / 6e-1) AS j, floor(z / 6e-1) AS k FROM points) b USING (i, j, k)
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 36e-2"""


@query("JN4", "SELECT id AS point_id, count(*) AS n FROM near GROUP BY id", near=NEAR)
def jn4(p):
    return neighbours.radius_join(p, p, 0.6).where("d2 <= 0.36e0").groupBy(F.col("id").alias("point_id")).agg(F.count("*").alias("n"))


@query("FP11", "SELECT id AS point_id FROM near GROUP BY id HAVING count(*) - 1 > 12", near=NEAR)
def fp11(p):
    return neighbours.radius_outliers(p, 0.6, 12).select("point_id")


@query("AG2")
def ag2(p):
    return rounded(neighbours.neighbour_verticality(p, 0.6), "verticality")


def knn_sql(asked: str, given: str, k: int) -> dict[str, str]:
    """Parts of SQL that end in ``knn`` (id, other, d2, rank) for two SELECTs of points: most have k of them within 1.2 m, the others are compared with all."""
    d2 = "(q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z)"
    cells = "floor(x / 12e-1){dx} AS i, floor(y / 12e-1){dy} AS j, floor(z / 12e-1){dz} AS k"
    near = cells.format(dx=" + dx", dy=" + dy", dz=" + dz")
    return {
        "asked": asked,
        "given": given,
        "nearest": f"SELECT q.point_id AS id, s.point_id AS other, {d2} AS d2 FROM (SELECT *, {near} FROM asked, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) t(dy), (VALUES (-1), (0), (1)) u(dz)) q JOIN (SELECT *, {cells.format(dx='', dy='', dz='')} FROM given) s USING (i, j, k) WHERE {d2} <= 144e-2",
        "settled": f"SELECT id FROM nearest GROUP BY id HAVING count(*) >= {k}",
        "knn": f"SELECT id, other, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM (SELECT * FROM nearest WHERE id IN (SELECT id FROM settled) UNION ALL SELECT q.point_id, s.point_id, {d2} FROM (SELECT * FROM asked WHERE point_id NOT IN (SELECT id FROM settled)) q, given s)) WHERE rank <= {k}",
    }


#: The stated query set: every point whose id is divisible by 20, against all labelled points.
NEAREST_PARTS = knn_sql("SELECT * FROM points WHERE point_id % 20 = 0", "SELECT * FROM points WHERE gt <> -1", 5)


@query("JN5", "SELECT id, other, rank FROM knn", **NEAREST_PARTS)
def jn5(p):
    return neighbours.knn(p.where("point_id % 20 = 0"), p.where("gt != -1"), 5, 0.6).select("id", "other", F.col("rank").cast("bigint").alias("rank"))


def vote_sql(label: str) -> str:
    """(id, label): the majority of the neighbours, the lowest on ties; labels come from ``given``."""
    return f"SELECT id, label FROM (SELECT id, {label} AS label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, {label}) AS k FROM knn JOIN given ON point_id = other GROUP BY id, {label}) WHERE k = 1"


@query("AG9", "SELECT id, label FROM vote", **NEAREST_PARTS, vote=vote_sql("gt"))
def ag9(p):
    return predictions.propagate_nearest(p.where("gt != -1"), p.where("point_id % 20 = 0"), 5, 0.6, "gt")


@query("JN6", "SELECT point_id, CASE WHEN gt = -1 THEN label ELSE gt END AS gt FROM points LEFT JOIN vote ON id = point_id", **knn_sql("SELECT * FROM points WHERE gt = -1", "SELECT * FROM points WHERE gt <> -1", 5), vote=vote_sql("gt"))
def jn6(p):
    return predictions.assign_remaining(p.select("point_id", "x", "y", "z", "gt"), "gt", 5, 0.6).select("point_id", "gt")


@query("FP10", "SELECT id AS point_id FROM m WHERE m <= (SELECT avg(m) + 2 * stddev_pop(m) FROM m)", **knn_sql("SELECT * FROM points", "SELECT * FROM points", 6), m="SELECT id, avg(sqrt(d2)) AS m FROM knn WHERE id <> other GROUP BY id")
def fp10(p):
    return neighbours.statistical_outliers(p, 5, 2.0, 0.6).select("point_id")


# --- predictions, ensembles, propagation --------------------------------------------------------------------------------

TILED = "SELECT o.*, col, row, dx + (col % 3) / 1e2 AS tdx, dy + (row % 3) / 1e2 AS tdy FROM o JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi"


@query("AG3", f"SELECT point_id, {r('avg(tdx)')} AS tdx, {r('avg(tdy)')} AS tdy, {r('avg(sem0)')} AS sem0, CAST(trunc(avg(gt)) AS BIGINT) AS gt, count(*) AS n FROM tp GROUP BY point_id", o=OFFSETS, g=GRID, t=TILES, tp=TILED)
def ag3(p):
    placed = tiles.assign_tiles(with_offsets(p).select("point_id", "x", "y", "dx", "dy", "sem0", "gt"), grid_of(p))
    placed = placed.withColumn("tdx", F.col("dx") + (F.col("col") % 3) / 100.0).withColumn("tdy", F.col("dy") + (F.col("row") % 3) / 100.0)
    return rounded(predictions.ensemble(placed, ["point_id"], ["tdx", "tdy", "sem0"], ["gt"]), "tdx", "tdy", "sem0")


@query("MD1")
def md1(p):
    placed = tiles.assign_tiles(p.select("point_id", "x", "y", "z", "x0", "y0", "gt"), grid_of(p))
    schema = f"point_id {id_type(p)}, col bigint, row bigint, sem0 double, sem1 double, dx double, dy double, dz double"
    return rounded(predictions.ensemble(predictions.predict_tiles(placed, predictions.oracle_predictor, schema), ["point_id"], ["sem0", "dx", "dy", "dz"], []), "dx", "dy", "dz")


@query("AG24", f"SELECT col, row, vx, vy, vz, least(count(*), 3) AS n, {r('avg(x) FILTER (k <= 3)')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY col, row, vx, vy, vz ORDER BY point_id) AS k FROM (SELECT col, row, point_id, x, CAST(floor(x / 1e0) AS BIGINT) AS vx, CAST(floor(y / 1e0) AS BIGINT) AS vy, CAST(floor(z / 1e0) AS BIGINT) AS vz FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi)) GROUP BY col, row, vx, vy, vz", g=GRID, t=TILES)
def ag24(p):
    return rounded(predictions.occupied_voxels(tiles.assign_tiles(p, grid_of(p)), 1.0).select("col", "row", "vx", "vy", "vz", "n", "x"), "x")


LOSS = "SELECT *, greatest(gap, 0e0) + ln(1 + exp(-abs(gap))) AS ce, sqrt((dx - (x0 - x)) * (dx - (x0 - x)) + (dy - (y0 - y)) * (dy - (y0 - y)) + (dz + z) * (dz + z)) AS od FROM (SELECT *, CASE WHEN gt = 0 THEN sem0 - sem1 ELSE sem1 - sem0 END AS gap FROM o)"


def loss_rows(p):
    o = with_offsets(p)
    return o.withColumns({"target": c.semantic_class(F.col("gt")), "tx": F.col("x0") - F.col("x"), "ty": F.col("y0") - F.col("y"), "tz": -F.col("z"), "mask_sem": F.col("gt") != -1, "mask_off": F.col("gt") > 0})


@query("AG21", f"SELECT {r('s', 6)} AS semantic, {r('f', 6)} AS offset_loss, {r('50 * s + f', 6)} AS total FROM (SELECT avg(ce) FILTER (gt <> -1) AS s, avg(od) FILTER (gt > 0) AS f FROM l)", o=OFFSETS, l=LOSS)
def ag21(p):
    return rounded(predictions.pointwise_loss(loss_rows(p)).withColumnRenamed("offset", "offset_loss"), "semantic", "offset_loss", "total", digits=6)


@query("AG22", f"SELECT {r('avg(CASE WHEN (sem0 >= sem1) = (gt <> 0) THEN 1e0 ELSE 0e0 END)', 6)} AS accuracy, count(*) AS n FROM o WHERE gt <> -1", o=OFFSETS)
def ag22(p):
    rows = with_offsets(p).where("gt != -1")
    return rounded(rows.agg(F.avg(F.when((F.col("sem0") >= F.col("sem1")) == (F.col("gt") != 0), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n")), "accuracy", digits=6)


VOX = "SELECT CAST(floor((x + 200e0) / 5e-1) AS BIGINT) AS vx, CAST(floor((y + 200e0) / 5e-1) AS BIGINT) AS vy, CAST(floor((z + 200e0) / 5e-1) AS BIGINT) AS vz, arg_min(pred, point_id) AS pred, min(point_id) AS first FROM points GROUP BY 1, 2, 3"
KEYED = "SELECT point_id, CAST(floor((x + 200e0) / 5e-1) AS BIGINT) AS vx, CAST(floor((y + 200e0) / 5e-1) AS BIGINT) AS vy, CAST(floor((z + 200e0) / 5e-1) AS BIGINT) AS vz FROM points"


def voxel_predictions(p):
    return voxels.voxelize(p, 0.5, "pred").select("vx", "vy", "vz", F.col("label").alias("pred"), "point_id")


@query("JN7", "SELECT point_id, pred FROM k LEFT JOIN v USING (vx, vy, vz)", v=VOX, k=KEYED)
def jn7(p):
    return predictions.propagate_by_key(voxels.voxel_members(p, 0.5), voxel_predictions(p).drop("point_id"), ["vx", "vy", "vz"]).select("point_id", "pred")


@query("JN8", "SELECT point_id, coalesce(pred, -1) AS pred FROM k LEFT JOIN (SELECT * FROM v WHERE first % 5 <> 0) USING (vx, vy, vz)", v=VOX, k=KEYED)
def jn8(p):
    some = voxel_predictions(p).where("point_id % 5 != 0").drop("point_id")
    return predictions.propagate_by_key(voxels.voxel_members(p, 0.5), some, ["vx", "vy", "vz"], F.lit(-1).cast("bigint")).select("point_id", "pred")


FILLED_IN = "SELECT k.point_id, k.x, k.y, k.z, coalesce(v.pred, -1) AS pred FROM (SELECT k.*, p.x, p.y, p.z FROM k JOIN points p USING (point_id)) k LEFT JOIN (SELECT * FROM v WHERE first % 5 <> 0) v USING (vx, vy, vz)"


@query("JN9", "SELECT point_id, CASE WHEN pred = -1 THEN label ELSE pred END AS pred FROM filled_in LEFT JOIN vote ON id = point_id", v=VOX, k=KEYED, filled_in=FILLED_IN, **knn_sql("SELECT * FROM filled_in WHERE pred = -1", "SELECT * FROM filled_in WHERE pred <> -1", 5), vote=vote_sql("pred"))
def jn9(p):
    some = voxel_predictions(p).where("point_id % 5 != 0").drop("point_id")
    members = voxels.voxel_members(p, 0.5).join(p.select("point_id", "x", "y", "z"), "point_id")
    return predictions.propagate_with_fallback(members, some, ["vx", "vy", "vz"], 5, 0.6).select("point_id", "pred")


@query("WN1", "SELECT point_id, dense_rank() OVER (ORDER BY gt) AS label FROM points WHERE gt > 0")
def wn1(p):
    return voxels.relabel(p.where("gt > 0").select("point_id", F.col("gt").alias("label")), "label")


@query("JN12", "SELECT label AS new, gt AS old FROM (SELECT DISTINCT gt, dense_rank() OVER (ORDER BY gt) AS label FROM points WHERE gt > 0)")
def jn12(p):
    return voxels.dense_labels(p.where("gt > 0"), "gt").select("new", "old")


# --- tree measures ------------------------------------------------------------------------------------------------------


@query("AG4", f"SELECT pred, {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z, count(*) AS n FROM points WHERE pred > 0 GROUP BY pred")
def ag4(p):
    return rounded(p.where("pred > 0").groupBy("pred").agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n")), "x", "y", "z")


@query("AG5", f'SELECT gt, {r("bx")} AS bx, {r(QUOTED)} AS "by", {r("bz")} AS bz FROM b', b=BASE)
def ag5(p):
    return rounded(voxels.base_positions(p.where("gt > 0")).select("gt", "bx", "by", "bz"), "bx", "by", "bz")


POS = "SELECT p.gt, avg(x) AS px, avg(y) AS py, any_value(zmin) AS zmin FROM points p JOIN (SELECT gt, min(z) AS zmin FROM points WHERE gt > 0 GROUP BY gt) m ON p.gt = m.gt AND p.z < zmin + 3e-1 GROUP BY p.gt"


@query("AG6", f"SELECT gt, {r('px')} AS px, {r('py')} AS py FROM pos", pos=POS)
def ag6(p):
    return rounded(voxels.evaluation_positions(p.where("gt > 0")).select("gt", "px", "py"), "px", "py")


@query("AG7", "SELECT gt, count(*) AS n, max(CASE WHEN k = 5 THEN z END) AS kth FROM (SELECT gt, z, row_number() OVER (PARTITION BY gt ORDER BY z DESC) AS k FROM points WHERE gt > 0) GROUP BY gt")
def ag7(p):
    return voxels.kth_height(p.where("gt > 0"), 5, largest=True)


@query("AG8", "SELECT pred, count(*) AS n FROM points GROUP BY pred")
def ag8(p):
    return p.groupBy("pred").agg(F.count("*").alias("n"))


@query("AG25", f"SELECT {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z FROM points")
def ag25(p):
    return rounded(p.agg(*(F.avg(a).alias(a) for a in "xyz")), "x", "y", "z")


# --- evaluation ---------------------------------------------------------------------------------------------------------

PAIRS = """SELECT pred, gt, tp, n_pred, n_gt, tp / (n_pred + n_gt - tp) AS iou, tp / n_pred AS prec, tp / n_gt AS rec FROM (SELECT pred, gt, count(*) AS tp FROM points GROUP BY ALL)
  JOIN (SELECT pred, count(*) AS n_pred FROM points GROUP BY pred) USING (pred) JOIN (SELECT gt, count(*) AS n_gt FROM points GROUP BY gt) USING (gt) WHERE pred > 0 AND gt > 0"""
GTS = "SELECT gt, count(*) AS n_gt FROM points WHERE gt > 0 GROUP BY gt"
BEST = "SELECT gt, coalesce(pred, 0) AS pred, coalesce(iou, 0) AS iou FROM gts LEFT JOIN (SELECT gt, pred, iou FROM pairs QUALIFY row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) = 1) USING (gt)"
#: With a threshold of a half, a pair above it is the best of both its trees, so the assignment holds it unless two lesser pairs outweigh it.
MATCHED = "SELECT pred, gt, iou FROM pairs WHERE iou > 5e-1"


def gts_of(p):
    return p.where("gt > 0").groupBy("gt").agg(F.count("*").alias("n_gt"))


def preds_of(p):
    return p.where("pred > 0").select("pred").distinct()


@query("JN10", f"SELECT pred, gt, tp, n_pred, n_gt, {r('iou', 6)} AS iou, {r('prec', 6)} AS prec, {r('rec', 6)} AS rec FROM pairs", pairs=PAIRS)
def jn10(p):
    return rounded(evaluation.contingency(p), "iou", "prec", "rec", digits=6)


@query("AG10", "SELECT t.gt, count(*) FILTER (p.gt = t.gt AND p.pred = t.gt) AS tp, count(*) FILTER (p.gt <> t.gt AND p.pred = t.gt) AS fp, count(*) FILTER (p.gt = t.gt AND p.pred <> t.gt) AS fn FROM gts t JOIN points p ON p.gt = t.gt OR p.pred = t.gt GROUP BY t.gt", gts=GTS)
def ag10(p):
    seen = p.select(F.explode(F.array_distinct(F.array("gt", "pred"))).alias("t"), "gt", "pred").where("t > 0")
    hit, got = F.col("gt") == F.col("t"), F.col("pred") == F.col("t")
    return seen.join(gts_of(p).select(F.col("gt").alias("t")), "t", "left_semi").groupBy(F.col("t").alias("gt")).agg(F.count_if(hit & got).alias("tp"), F.count_if(~hit & got).alias("fp"), F.count_if(hit & ~got).alias("fn"))


@query("JN13", f"SELECT gt, pred, {r('iou', 6)} AS iou FROM best", pairs=PAIRS, gts=GTS, best=BEST)
def jn13(p):
    return rounded(evaluation.best_prediction(evaluation.contingency(p), gts_of(p)), "iou", digits=6)


METRICS = f"SELECT gt, pred, {r('coalesce(tp, 0) / n_pred', 6)} AS prec, {r('coalesce(tp, 0) / g.n_gt', 6)} AS rec, {r('coalesce(tp, 0) / (coalesce(n_pred, 0) + g.n_gt - coalesce(tp, 0))', 6)} AS iou FROM best JOIN gts g USING (gt) LEFT JOIN (SELECT gt, pred, tp, n_pred FROM pairs) USING (gt, pred)"


@query("AG16", METRICS, pairs=PAIRS, gts=GTS, best=BEST)
def ag16(p):
    pairs, sizes = evaluation.contingency(p), gts_of(p)
    return rounded(evaluation.tree_metrics(pairs, evaluation.best_prediction(pairs, sizes), sizes), "prec", "rec", "iou", digits=6)


@query("AG11", METRICS.replace("SELECT gt, pred,", "SELECT gt,", 1), pairs=PAIRS, gts=GTS, best=BEST)
def ag11(p):
    return ag16(p).select("gt", "prec", "rec", "iou")


@query("AG13", f"SELECT {r('avg(prec)', 6)} AS prec, {r('avg(rec)', 6)} AS rec, {r('avg(iou)', 6)} AS iou FROM m", pairs=PAIRS, gts=GTS, best=BEST, m=METRICS)
def ag13(p):
    return rounded(ag16(p).agg(*(F.avg(a).alias(a) for a in ("prec", "rec", "iou"))), "prec", "rec", "iou", digits=6)


@query("JN11", f"SELECT pred, gt, {r('iou', 6)} AS iou FROM matched", pairs=PAIRS, matched=MATCHED)
def jn11(p):
    return rounded(evaluation.match_trees(evaluation.contingency(p)), "iou", digits=6)


@query("FP17", "SELECT count(*) AS n FROM pairs WHERE iou > 5e-1", pairs=PAIRS)
def fp17(p):
    return evaluation.contingency(p).where("iou > 0.5e0").agg(F.count("*").alias("n"))


SUMMARY = """SELECT m / g AS completeness, (g - m) / g AS omission, f / (m + f) AS commission FROM (SELECT count(*) AS m FROM matched), (SELECT count(*) AS g FROM gts),
  (SELECT count(*) AS f FROM (SELECT pred FROM pairs WHERE pred NOT IN (SELECT pred FROM matched) GROUP BY pred HAVING sum(prec) >= 5e-1))"""


@query("AG12", f"SELECT {r('completeness', 6)} AS completeness, {r('omission', 6)} AS omission, {r('commission', 6)} AS commission, {r('2 * (1 - commission) * (1 - omission) / (2 - (commission + omission))', 6)} AS f1 FROM s", pairs=PAIRS, matched=MATCHED, gts=GTS, s=SUMMARY)
def ag12(p):
    pairs = evaluation.contingency(p)
    return rounded(evaluation.detection_summary(evaluation.match_trees(pairs), pairs, preds_of(p), gts_of(p)), "completeness", "omission", "commission", "f1", digits=6)


@query("PJ17", f"SELECT round_even(completeness * 1e3, 0) / 1e1 AS completeness_pct, round_even(omission * 1e3, 0) / 1e1 AS omission_pct FROM s", pairs=PAIRS, matched=MATCHED, gts=GTS, s=SUMMARY)
def pj17(p):
    return ag12(p).select(c.percent(F.col("completeness")).alias("completeness_pct"), c.percent(F.col("omission")).alias("omission_pct"))


def shifted_labels(p):
    """Predictions that split some trees and merge others, so that both kinds of error occur."""
    return p.withColumn("pred", F.when((F.col("pred") > 0) & (F.col("pred") % 4 == 0) & (F.col("z") > 13.0), F.col("pred") + 100000).when((F.col("pred") > 0) & (F.col("pred") % 5 == 0), F.col("pred") + 1).otherwise(F.col("pred")))


SHIFTED = "SELECT * REPLACE (CASE WHEN pred > 0 AND pred % 4 = 0 AND z > 13e0 THEN pred + 100000 WHEN pred > 0 AND pred % 5 = 0 THEN pred + 1 ELSE pred END AS pred) FROM points"
SPAIRS, SGTS = PAIRS.replace("FROM points", "FROM sp"), GTS.replace("FROM points", "FROM sp")


@query("AG17", """SELECT 'commission' AS kind, pred AS id, CAST(CASE WHEN prec >= 5e-1 THEN gt END AS BIGINT) AS gt, CAST(NULL AS BIGINT) AS other FROM (SELECT *, sum(prec) OVER (PARTITION BY pred) AS s, row_number() OVER (PARTITION BY pred ORDER BY prec DESC, gt) AS k FROM pairs) WHERE k = 1 AND s >= 5e-1 AND pred NOT IN (SELECT pred FROM matched)
UNION ALL SELECT 'omission', u.gt, t.pred, o.gt FROM (SELECT gt FROM gts WHERE gt NOT IN (SELECT gt FROM matched)) u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY rec DESC, pred) AS k FROM pairs) WHERE k = 1 AND rec >= 5e-1) t ON t.gt = u.gt
LEFT JOIN (SELECT * FROM (SELECT a.gt AS own, b.gt, b.rec, row_number() OVER (PARTITION BY a.gt ORDER BY b.rec DESC, b.gt) AS k FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY rec DESC, pred) AS kk FROM pairs) WHERE kk = 1 AND rec >= 5e-1) a JOIN pairs b ON a.pred = b.pred AND a.gt <> b.gt) WHERE k = 1 AND rec >= 5e-1) o ON o.own = u.gt""", sp=SHIFTED, pairs=SPAIRS, gts=SGTS, matched=MATCHED)
def ag17(p):
    s = shifted_labels(p)
    pairs = evaluation.contingency(s)
    false, missed = evaluation.failures(evaluation.match_trees(pairs), pairs, preds_of(s), gts_of(s))
    one = false.select(F.lit("commission").alias("kind"), F.col("pred").alias("id"), "gt", F.lit(None).cast("bigint").alias("other"))
    return one.unionByName(missed.select(F.lit("omission").alias("kind"), F.col("gt").alias("id"), F.col("pred").alias("gt"), "other"))


@query("FP18", "SELECT pred FROM pairs WHERE pred NOT IN (SELECT pred FROM matched) GROUP BY pred HAVING sum(prec) >= 5e-1", sp=SHIFTED, pairs=SPAIRS, matched=MATCHED)
def fp18(p):
    return ag17(p).where("kind = 'commission'").select(F.col("id").alias("pred"))


@query("ST2", "SELECT gt FROM gts WHERE gt NOT IN (SELECT gt FROM matched)", sp=SHIFTED, pairs=SPAIRS, gts=SGTS, matched=MATCHED)
def st2(p):
    s = shifted_labels(p)
    return gts_of(s).select("gt").exceptAll(evaluation.match_trees(evaluation.contingency(s)).select("gt"))


SEEN = "SELECT b.gt, p.x, p.y, p.z, p.point_id, p.gt = b.gt AS in_gt, p.pred = b.pred AS in_pred FROM best b JOIN points p ON p.gt = b.gt OR (p.pred = b.pred AND b.pred > 0)"
BINNED = "SELECT gt, CAST(floor(share * 10) AS BIGINT) AS bin, count(*) FILTER (in_gt AND in_pred) AS tp, count(*) FILTER (NOT in_gt) AS fp, count(*) FILTER (NOT in_pred) AS fn FROM s WHERE share >= 0 AND share < 1 GROUP BY ALL"
BINS = f"SELECT gt, bin, {r('tp / nullif(tp + fp, 0)', 6)} AS prec, {r('tp / nullif(tp + fn, 0)', 6)} AS rec, {r('tp / nullif(tp + fp + fn, 0)', 6)} AS iou FROM b"
DIST = "sqrt((x - px) * (x - px) + (y - py) * (y - py))"


@query("AG14", BINS, pairs=PAIRS, gts=GTS, best=BEST, pos=POS, seen=SEEN, far=f"SELECT gt, d AS far FROM (SELECT gt, {DIST} AS d, row_number() OVER (PARTITION BY gt ORDER BY {DIST} DESC) AS k FROM points JOIN pos USING (gt)) WHERE k = 5", s=f"SELECT gt, in_gt, in_pred, {DIST} / far AS share FROM seen JOIN pos USING (gt) JOIN far USING (gt)", b=BINNED)
def ag14(p):
    best = evaluation.best_prediction(evaluation.contingency(p), gts_of(p))
    return rounded(evaluation.partition_metrics(p, best, "xy"), "prec", "rec", "iou", digits=6)


FAR_Z = "SELECT gt, z AS far FROM (SELECT gt, z, row_number() OVER (PARTITION BY gt ORDER BY z DESC) AS k FROM points WHERE gt > 0) WHERE k = 5"
LOW_Z = "SELECT gt, min(z) AS zmin FROM points WHERE gt > 0 GROUP BY gt"
SHARE_Z = "SELECT gt, in_gt, in_pred, (z - zmin) / (far - zmin) AS share FROM seen JOIN low USING (gt) JOIN far USING (gt)"


@query("AG15", BINS, pairs=PAIRS, gts=GTS, best=BEST, seen=SEEN, far=FAR_Z, low=LOW_Z, s=SHARE_Z, b=BINNED)
def ag15(p):
    best = evaluation.best_prediction(evaluation.contingency(p), gts_of(p))
    return rounded(evaluation.partition_metrics(p, best, "z"), "prec", "rec", "iou", digits=6)


BINNED_METRICS = ", ".join(f"max({m}) FILTER (bin = {b}) AS \"{m}_intvl{b / 10:g}_{(b + 1) / 10:g}\"" for b in range(10) for m in ("prec", "rec", "iou"))


@query("AG16b", f"SELECT gt, {BINNED_METRICS} FROM bins GROUP BY gt", pairs=PAIRS, gts=GTS, best=BEST, seen=SEEN, far=FAR_Z, low=LOW_Z, s=SHARE_Z, b=BINNED, bins=BINS)
def ag16b(p):
    best = evaluation.best_prediction(evaluation.contingency(p), gts_of(p))
    return evaluation.wide(rounded(evaluation.partition_metrics(p, best, "z"), "prec", "rec", "iou", digits=6))


# --- geometry -------------------------------------------------------------------------------------------------------------

RING = [(-70.0, -82.0), (40.0, -82.0), (62.5, -70.0), (20.0, -55.0), (-75.0, -60.0)]


@query("FP12")
def fp12(p):
    return hulls.in_hull(p, RING).groupBy("in_hull").agg(F.count("*").alias("n"))


SEGMENTS = "SELECT * FROM (VALUES " + ", ".join(f"({a[0]:e}, {a[1]:e}, {b[0]:e}, {b[1]:e})" for a, b in zip(RING, RING[1:] + RING[:1], strict=True)) + ") s(ax, ay, ex, ey)"
BUFFER = "SELECT point_id, min(pow(x - (ax + t * (ex - ax)), 2) + pow(y - (ay + t * (ey - ay)), 2)) AS d2 FROM (SELECT *, greatest(0e0, least(1e0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t FROM points, seg) GROUP BY point_id"
INSIDE = "SELECT point_id, sum(CASE WHEN (ay > y) <> (ey > y) AND x < ax + (y - ay) * ((ex - ax) / (ey - ay)) THEN 1 ELSE 0 END) % 2 = 1 AS in_hull FROM points, (SELECT * FROM seg WHERE ay <> ey) GROUP BY point_id"
ORACLE_SQL["FP12"] = oracle("SELECT in_hull AND NOT coalesce(d2 <= 1e-24, false) AS in_hull, count(*) AS n FROM i JOIN b USING (point_id) GROUP BY 1", seg=SEGMENTS, b=BUFFER, i=INSIDE)


@query("FP13", "SELECT point_id FROM b WHERE sqrt(d2) < 2e0", seg=SEGMENTS, b=BUFFER)
def fp13(p):
    return hulls.in_buffer(p, RING, 2.0).where("in_buffer").select("point_id")


@query("FP14", "SELECT gt, dense_rank() OVER (ORDER BY gt) AS label, count(*) AS n FROM points JOIN b USING (point_id) WHERE NOT (sqrt(d2) < 2e0) AND gt > 0 GROUP BY gt", seg=SEGMENTS, b=BUFFER)
def fp14(p):
    kept = hulls.in_buffer(p.where("gt > 0"), RING, 2.0).where("not in_buffer")
    return voxels.relabel(kept.select("gt", F.col("gt").alias("label")), "label").groupBy("gt", "label").agg(F.count("*").alias("n"))


@query("FP15", "SELECT DISTINCT pred FROM points JOIN b USING (point_id) WHERE sqrt(d2) < 1e0 AND pred <> 0", seg=SEGMENTS, b=BUFFER)
def fp15(p):
    return hulls.in_buffer(p, RING, 1.0).where("in_buffer and pred != 0").select("pred").distinct()


CELLS = "SELECT min(point_id) AS id, arg_min(x, point_id) AS x, arg_min(y, point_id) AS y FROM points GROUP BY floor(x / 25e-2), floor(y / 25e-2)"
NEAR_CELLS = """SELECT a.id, b.id AS other, a.x AS ax, a.y AS ay, b.x, b.y, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM
  (SELECT *, floor(x / 34e-1) + dx AS i, floor(y / 34e-1) + dy AS j FROM cells, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy)) a
  JOIN (SELECT *, floor(x / 34e-1) AS i, floor(y / 34e-1) AS j FROM cells) b USING (i, j) WHERE a.id <> b.id"""
ARCS = """SELECT id, other, s + t AS s, e + t AS e FROM (SELECT id, other, s, s + 2 * h AS e FROM (SELECT id, other, h, p - 2 * pi() * floor(p / (2 * pi())) AS s FROM (SELECT id, other, h, atan2(y - ay, x - ax) - h AS p FROM
  (SELECT *, acos(sqrt(d2) * 6e-1 / 2) AS h FROM nc WHERE d2 > 0 AND d2 < 4 / 36e-2)))), (VALUES (0e0), (2 * pi())) u(t)"""
GAPS = "SELECT id, other, last FROM (SELECT *, arg_max(other, e) OVER w AS last, max(e) OVER w AS top FROM arcs WINDOW w AS (PARTITION BY id ORDER BY s, e, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE s >= 2 * pi() AND s > top + 1e-12"


@query("CL4", "SELECT a, b FROM (SELECT id AS a, other AS b FROM gaps UNION ALL SELECT id, last FROM gaps) WHERE a < b GROUP BY a, b HAVING count(*) = 1", cells=CELLS, nc=NEAR_CELLS, arcs=ARCS, gaps=GAPS)
def cl4(p):
    return hulls.alpha_edges(voxels.first_per_cell(p, 0.25), 0.6)


@query("PJ9")
def pj9(p):
    return hulls.tree_categories(p, hulls.plot_hull(p, 0.6), 0.3)


# --- clusters ---------------------------------------------------------------------------------------------------------------


def shifted(p):
    o = with_offsets(p).where("gt != 0")
    return o.select("point_id", (F.col("x") + 0.9 * F.col("dx")).alias("x"), (F.col("y") + 0.9 * F.col("dy")).alias("y"))


@query("CL2")
def cl2(p):
    return clustering.dbscan(shifted(p), 0.15, 20)


@query("CL3")
def cl3(p):
    return clustering.hdbscan(shifted(p), 50)


@query("CL1")
def cl1(p):
    o = with_offsets(p).withColumn("p_tree", c.tree_probability(F.col("sem0"), F.col("sem1")))
    o = o.join(voxels.fill_missing_with_mean(neighbours.neighbour_verticality(p, 0.6).select("point_id", "verticality"), "verticality"), "point_id")
    return clustering.instances(o, 0.15, 20)


@query("SO3", "SELECT count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY gt ORDER BY point_id) AS k FROM points) WHERE k % 10 = 1")
def so3(p):
    return voxels.numbered(p.select("gt", "point_id"), "gt", "point_id").where("number % 10 = 1").agg(F.count("*").alias("n"))


@query("ST3", "SELECT count(*) AS n FROM points WHERE pred IN (SELECT gt FROM points WHERE gt > 0)")
def st3(p):
    return p.join(gts_of(p).select(F.col("gt").alias("pred")), "pred", "left_semi").agg(F.count("*").alias("n"))


@query("PJ13", f"SELECT plot, {r('dx / floor(dx / 3e0)')} AS res FROM (SELECT plot, max(x) - min(x) AS dx FROM points GROUP BY plot)")
def pj13(p):
    width = p.groupBy("plot").agg((F.max("x") - F.min("x")).alias("dx"))
    return rounded(width.select("plot", c.ratio(F.col("dx"), F.floor(F.col("dx") / 3.0)).alias("res")), "res")


# --- the plans ------------------------------------------------------------------------------------------------------------------

PLAN = Config(Sampling(voxel_size=0.5, search_radius=0.6), Grouping(tau_vert=0.1077, tau_off=12.3, use_hdbscan=False))


def tile_predictions(p: DataFrame) -> DataFrame:
    """A table of predictions: two rows for each voxel that lead to the stem, a little apart, without a part of the voxels."""
    v = voxels.voxelize_exactly(p, PLAN.sampling.voxel_size, "gt").select("vx", "vy", "vz", "point_id", *"xyz", F.col("label").alias("gt"))
    v = v.join(p.select("point_id", "x0", "y0"), "point_id").where("point_id % 11 != 3")
    return with_offsets(v).withColumn("verticality", F.col("z") / 26.0).withColumn("tile", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("dx", F.col("dx") + F.col("tile") / 1000.0)


def centre_sql(axis: str, n: str = "count(*)") -> str:
    """The mean of whole centimetres, half to even on whole numbers, in DuckDB."""
    total = f"sum(CAST(round_even({axis} * 1e2, 0) AS BIGINT))"
    rest = f"((({total}) % {n}) + {n}) % {n}"
    below = f"(({total}) - {rest}) // {n}"
    return f"({below} + CASE WHEN 2 * ({rest}) > {n} OR (2 * ({rest}) = {n} AND abs({below}) % 2 = 1) THEN 1 ELSE 0 END) / 1e2"


VOXELS = "SELECT CAST(floor((x + 200e0) / 5e-1) AS BIGINT) AS vx, CAST(floor((y + 200e0) / 5e-1) AS BIGINT) AS vy, CAST(floor((z + 200e0) / 5e-1) AS BIGINT) AS vz, min(point_id) AS point_id, arg_min(gt, point_id) AS gt, arg_min(tree_key, point_id) AS tree_key, " + centre_sql("z") + " AS z FROM points GROUP BY 1, 2, 3"
#: The offsets lead to the stems, five metres apart, so the clusters are the trees.
STATES = "SELECT *, tree, CASE WHEN NOT tree THEN 0 WHEN z / 26e0 > 1077e-4 AND abs(-z + ((point_id % 21) - 10) / 1000e0) < 123e-1 THEN 1 ELSE -1 END AS state FROM (SELECT *, (gt <> 0) <> (point_id % 97 = 0) AS tree FROM vox WHERE point_id % 11 <> 3)"
CLUSTERS = "SELECT tree_key, dense_rank() OVER (ORDER BY first) AS cluster FROM (SELECT tree_key, min(point_id) AS first FROM states WHERE state = 1 GROUP BY tree_key HAVING count(*) >= 50)"
PARTS = {"vox": VOXELS, "states": STATES, "clusters": CLUSTERS}


@query("SK5", "SELECT point_id, CASE state WHEN 1 THEN coalesce(cluster, -1) ELSE state END AS initial, CASE WHEN tree THEN cluster ELSE 0 END AS instance FROM states LEFT JOIN clusters USING (tree_key)", **PARTS)
def sk5(p):
    return segmentation.pointwise(tile_predictions(p), PLAN).select("point_id", F.col("initial").cast("bigint").alias("initial"), "instance")


@query("PLAN_SEGMENT", "SELECT p.point_id, CASE WHEN tree THEN cluster ELSE 0 END AS instance FROM points p JOIN states s ON CAST(floor((p.x + 200e0) / 5e-1) AS BIGINT) = vx AND CAST(floor((p.y + 200e0) / 5e-1) AS BIGINT) = vy AND CAST(floor((p.z + 200e0) / 5e-1) AS BIGINT) = vz LEFT JOIN clusters c ON s.tree_key = c.tree_key", **PARTS)
def plan_segment(p):
    """The points whose voxel has a prediction; the others, which take the majority of their neighbours, are held against brute force in a test."""
    covered = tile_predictions(p).select("vx", "vy", "vz").distinct()
    members = voxels.voxel_members(p, PLAN.sampling.voxel_size).join(covered, ["vx", "vy", "vz"]).select("point_id")
    return segmentation.segment(p, tile_predictions(p), PLAN)[0].join(members, "point_id", "left_semi").select("point_id", "instance")


TILE_VOXELS = "SELECT CAST(floor((x + 200e0) / 5e-1) AS BIGINT) AS vx, CAST(floor((y + 200e0) / 5e-1) AS BIGINT) AS vy, CAST(floor((z + 200e0) / 5e-1) AS BIGINT) AS vz, " + centre_sql("x") + " AS x, " + centre_sql("y") + " AS y FROM points GROUP BY 1, 2, 3"


@query("TL3", "SELECT t.col, t.row, count(*) AS n FROM v JOIN t ON x >= xlo - 135e-1 AND x <= xhi + 135e-1 AND y >= ylo - 135e-1 AND y <= yhi + 135e-1 SEMI JOIN (SELECT DISTINCT col, row FROM v JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi) l ON t.col = l.col AND t.row = l.row GROUP BY t.col, t.row", v=TILE_VOXELS, g=GRID.replace("FROM points", "FROM v"), t=TILES)
def tl3(p):
    return segmentation.generate_tiles(p, PLAN, "gt").groupBy("col", "row").agg(F.count("*").alias("n"))


# --- set operations, masks, windows that other operators build on -------------------------------------------------------------


@query("FP6", "SELECT gt <> -1 AS mask_sem, gt > 0 AS mask_off, count(*) AS n FROM points GROUP BY ALL")
def fp6(p):
    rows = loss_rows(p)
    return rows.groupBy("mask_sem", "mask_off").agg(F.count("*").alias("n"))


@query("FP7", "SELECT crop, count(*) AS n FROM points JOIN crops ON x > cx - 7e0 AND x < cx + 7e0 AND y > cy - 7e0 AND y < cy + 7e0 GROUP BY crop", crops=CROPS)
def fp7(p):
    """The strict box of a crop, 3 m wider than its half edge."""
    box = lattice(p, 8.0).withColumn("reach", F.lit(7.0)).withColumn("angle", F.lit(0))
    return tiles.crop_points(p.select("point_id", "x", "y"), box, 14.0).where((F.abs("u") < 7.0) & (F.abs("v") < 7.0)).groupBy("crop").agg(F.count("*").alias("n"))


@query("FP8", "SELECT DISTINCT crop, tree_key FROM u WHERE greatest(abs(u), abs(v)) <= 4e0", crops=CROPS, u=TURNED)
def fp8(p):
    return tiles.crop_points(p.select("point_id", "tree_key", "x", "y"), lattice(p, 8.0), 8.0).select("crop", "tree_key").distinct()


@query("ST1", "SELECT source, count(*) AS n FROM (SELECT 'plot0' AS source FROM points WHERE plot = 0 UNION ALL SELECT 'rest' FROM points WHERE plot <> 0) GROUP BY source")
def st1(p):
    one, two = p.where("plot = 0").withColumn("source", F.lit("plot0")), p.where("plot != 0").withColumn("source", F.lit("rest"))
    return one.unionByName(two).groupBy("source").agg(F.count("*").alias("n"))


@query("ST4", "SELECT DISTINCT pred FROM points WHERE pred <> 0")
def st4(p):
    return p.select("pred").distinct().where("pred != 0")


@query("WN2", "SELECT gt, max(CASE WHEN k = 4 THEN z END) AS low4 FROM (SELECT gt, z, row_number() OVER (PARTITION BY gt ORDER BY z) AS k FROM points WHERE gt > 0) GROUP BY gt")
def wn2(p):
    return voxels.kth_height(p.where("gt > 0"), 4).select("gt", F.col("kth").alias("low4"))


@query("WN3", "SELECT pred, gt FROM (SELECT pred, gt, row_number() OVER (PARTITION BY pred ORDER BY prec DESC, gt) AS k FROM pairs) WHERE k = 1", pairs=PAIRS)
def wn3(p):
    pairs = evaluation.contingency(p)
    return pairs.groupBy("pred").agg(F.max_by("gt", F.struct("prec", -F.col("gt"))).alias("gt"))


@query("WN6", "SELECT id, rank, round_even((d2 + 3.1e-9) * 1e6, 0) / 1e6 AS d2 FROM knn", **NEAREST_PARTS)
def wn6(p):
    return rounded(neighbours.knn(p.where("point_id % 20 = 0"), p.where("gt != -1"), 5, 0.6).select("id", F.col("rank").cast("bigint").alias("rank"), "d2"), "d2", digits=6)


# --- random choices, crops, the tile store, inference over tiles ------------------------------------------------------------------


def hashed_sql(digits: int, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, {digits}) AS BIGINT)"


def uniform_sql(*keys: str) -> str:
    return f"(({hashed_sql(13, *keys)} + 5e-1) / {1 << 52}e0)"


def normal_sql(*keys: str) -> str:
    *first, counter = keys
    return f"(sqrt(-2e0 * ln({uniform_sql(*first, counter)})) * cos(2 * pi() * {uniform_sql(*first, str(int(counter) + 1))}))"


DRAWN = f"SELECT plot, draw, {hashed_sql(15, 'plot', 'draw')} % total AS pos FROM (SELECT unnest(range(5000)) AS draw), (SELECT plot, sum(1 + point_id % 3) AS total FROM points GROUP BY plot)"


@query("SO5", "SELECT d.plot, draw, point_id FROM d JOIN s ON d.plot = s.plot AND pos >= above - w AND pos < above", d=DRAWN, s="SELECT plot, point_id, 1 + point_id % 3 AS w, sum(1 + point_id % 3) OVER (PARTITION BY plot ORDER BY point_id) AS above FROM points")
def so5(p):
    return sampling.draws(p, "plot", "point_id", 1 + F.col("point_id") % 3, F.lit(5000)).select("plot", "draw", "point_id")


def augmented_sql() -> str:
    t = "tree_key"

    def coin(k: int, chance: str) -> str:
        return f"{uniform_sql(t, str(k))} < {chance}"

    moved = ", ".join(f"{c} + CASE WHEN {coin(1, '25e-2')} THEN greatest(-2e-1, least(2e-1, 1e-1 * {normal_sql(t, 'point_id', str(2 * k))})) ELSE 0e0 END AS {c}" for k, c in enumerate("xyz"))
    scale = [f"CASE WHEN {coin(2, '5e-1')} THEN {low} + ({high} - {low}) * {uniform_sql(t, str(10 + k))} ELSE 1e0 END" for k, (low, high) in enumerate((("8e-1", "12e-1"), ("8e-1", "12e-1"), ("95e-2", "105e-2")))]
    cells = ", ".join(f"({scale[i] if i == j else '0e0'}) + CASE WHEN {coin(3, '5e-1')} THEN 1e-1 ELSE 0e0 END * {normal_sql(t, str(20 + 2 * (3 * i + j)))} AS m{i}{j}" for i in range(3) for j in range(3))
    flip = f"CASE WHEN {coin(4, '5e-1')} AND {uniform_sql(t, '50')} < 5e-1 THEN -1e0 ELSE 1e0 END AS flip, CASE WHEN {coin(5, '5e-1')} THEN 2 * pi() * {uniform_sql(t, '51')} ELSE 0e0 END AS a"
    a, b, z = (f"(x * m0{j}{' * flip' if j == 0 else ''} + y * m1{j} + z * m2{j})" for j in range(3))
    return f"SELECT tree_key, point_id, {r(f'{a} * cos(a) - {b} * sin(a)')} AS x, {r(f'{a} * sin(a) + {b} * cos(a)')} AS y, {r(z)} AS z FROM (SELECT tree_key, point_id, {moved} FROM points) JOIN (SELECT tree_key, {cells}, {flip} FROM (SELECT DISTINCT tree_key FROM points)) USING (tree_key)"


@query("PJ14", augmented_sql())
def pj14(p):
    return rounded(sampling.augmented(p.select("tree_key", "point_id", "x", "y", "z"), "tree_key"), "x", "y", "z")


CROP_PLAN = crops.Crops(total=60, size=10.0, lattice=12)
PLOT_GRIDS = "SELECT *, (xmax - xmin) / nx AS rx, (ymax - ymin) / ny AS ry FROM (SELECT plot, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, greatest(1, floor(max(x) - min(x))) AS nx, greatest(1, floor(max(y) - min(y))) AS ny FROM points GROUP BY plot)"
PLOT_CELLS = """SELECT b.plot, i, j, xmin + (i + 5e-1) * rx AS cx, ymin + (j + 5e-1) * ry AS cy, CASE WHEN h THEN 1 ELSE 0 END AS occ FROM pg b JOIN (SELECT unnest(range(3000)) AS i) a ON i < nx JOIN (SELECT unnest(range(3000)) AS j) c ON j < ny
  LEFT JOIN (SELECT DISTINCT true AS h, plot AS hp, CAST(ceil((x - xmin) / rx) - 1 AS BIGINT) AS hi, CAST(ceil((y - ymin) / ry) - 1 AS BIGINT) AS hj FROM points JOIN pg USING (plot) WHERE gt <> -1) q ON hp = b.plot AND hi = i AND hj = j"""
PLOT_FILLED = "SELECT a.plot, a.i, a.j, a.cx, a.cy, CASE WHEN a.occ = 0 AND sum(b.occ) / count(*) >= 3e-1 THEN 1 ELSE a.occ END AS occ FROM pcells a JOIN pcells b ON a.plot = b.plot AND b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.plot, a.i, a.j, a.cx, a.cy, a.occ"
PLOT_CROPS = "SELECT plot, id AS crop, round_even((xmin + (id % 12) * ((xmax - xmin) / 11e0)) * 100e0, 0) / 100e0 AS cx, round_even((ymin + (id // 12) * ((ymax - ymin) / 11e0)) * 100e0, 0) / 100e0 AS cy, (id * 7919 + 13) % 360 AS angle FROM (SELECT unnest(range(144)) AS id), pg"


def in_crops(rows: str, x: str, y: str, crops: str) -> str:
    return f"SELECT * FROM (SELECT *, cos(radians(angle)) * ({x} - c.cx) + sin(radians(angle)) * ({y} - c.cy) AS u, cos(radians(angle)) * ({y} - c.cy) - sin(radians(angle)) * ({x} - c.cx) AS v FROM {rows} f JOIN {crops} c ON f.plot = c.plot AND abs({x} - c.cx) <= 8e0 AND abs({y} - c.cy) <= 8e0) WHERE greatest(abs(u), abs(v)) <= 5e0"


CROP_PARTS = {
    "pg": PLOT_GRIDS, "pcells": PLOT_CELLS, "pfilled": PLOT_FILLED, "pcrops": PLOT_CROPS, "covered": f"SELECT plot, crop FROM ({in_crops('pfilled', 'f.cx', 'f.cy', 'pcrops')}) GROUP BY plot, crop HAVING sum(occ) / 1e2 > 2e-1",
    "quotas": "SELECT plot, CAST(q + CASE WHEN plot = max(plot) OVER () THEN 60 - sum(q) OVER () ELSE 0 END AS BIGINT) AS quota FROM (SELECT plot, CAST(round_even(n / (sum(n) OVER ()) * 60, 0) AS BIGINT) AS q FROM (SELECT plot, sum(occ) AS n FROM pfilled GROUP BY plot))",
    "taken": f"SELECT plot, crop, cx, cy, angle FROM (SELECT *, row_number() OVER (PARTITION BY plot ORDER BY -ln({uniform_sql('plot', 'crop')}), crop) AS k FROM pcrops SEMI JOIN covered USING (plot, crop) JOIN quotas USING (plot)) WHERE k <= quota",
}


@query("TL2", "SELECT plot, crop, cx, cy, angle FROM taken", **CROP_PARTS)
def tl2(p):
    return crops.chosen_crops(p.withColumn("label", F.col("gt")), CROP_PLAN).select("plot", "crop", "cx", "cy", "angle")


@query("TL4", f"SELECT plot, crop, point_id, {r('u', 3)} AS u, {r('v', 3)} AS v FROM ({in_crops('points', 'f.x', 'f.y', 'taken')})", **CROP_PARTS)
def tl4(p):
    return rounded(crops.training_crops(p.withColumn("label", F.col("gt")), CROP_PLAN).select("plot", "crop", "point_id", "u", "v"), "u", "v", digits=3)


def store_of(p: DataFrame) -> DataFrame:
    """The tiles of the plot, written as files and read back; files hold ids of 64 bits, so points of wider ones are numbered in the same order."""
    path = f"{folder(p.sparkSession)}/tiles-{uuid.uuid4().hex}"
    if id_type(p) != "bigint":
        p = voxels.relabel(p, "point_id")
    write_tiles(segmentation.generate_tiles(p, PLAN, "gt"), path)
    return read_tiles(p.sparkSession, path)


@query("SK6")
def sk6(p):
    return store_of(p).groupBy("col", "row").agg(F.count("*").alias("n"))


@query("SC8")
def sc8(p):
    return store_of(p).where("col >= 3 and row < 5").groupBy("col", "row").agg(F.count("*").alias("n"))


# the same tiles as TL3, of which the reader opens some
ORACLE_SQL["SK6"] = ORACLE_SQL["TL3"]
ORACLE_SQL["SC8"] = f"SELECT * FROM ({ORACLE_SQL['TL3']}) WHERE col >= 3 AND row < 5"


@query("JN14", f"SELECT col, row, point_id, {r('f')} AS f FROM kk JOIN (SELECT col, row, vx, vy, vz, avg(x) FILTER (k <= 3) AS f FROM kk GROUP BY ALL) USING (col, row, vx, vy, vz)", g=GRID, t=TILES, kk="SELECT *, row_number() OVER (PARTITION BY col, row, vx, vy, vz ORDER BY point_id) AS k FROM (SELECT col, row, point_id, x, CAST(floor(x / 1e0) AS BIGINT) AS vx, CAST(floor(y / 1e0) AS BIGINT) AS vy, CAST(floor(z / 1e0) AS BIGINT) AS vz FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi)")
def jn14(p):
    placed = tiles.assign_tiles(p.select("point_id", "x", "y", "z"), grid_of(p))
    features = predictions.occupied_voxels(placed, 1.0).select("col", "row", "vx", "vy", "vz", F.col("x").alias("f"))
    return rounded(predictions.gather_features(placed, features, 1.0).select("col", "row", "point_id", "f"), "f")


def height_predictor(part: pd.DataFrame) -> pd.DataFrame:
    """Calls what is over two metres a tree, and fails on some tiles, as a model does that runs out of memory."""
    if (part["col"].iloc[0] + part["row"].iloc[0]) % 5 == 0:
        raise ValueError("no prediction")
    high = (part["z"] > 2.0) * 4.0 - 2.0
    return pd.DataFrame({"col": part["col"], "row": part["row"], "point_id": part["point_id"], "sem0": high, "sem1": -high})


@query("MD5", "SELECT col, row, count(*) FILTER ((col + row) % 5 <> 0) AS n, coalesce(sum(CASE WHEN z > 2e0 THEN 1 ELSE 0 END) FILTER ((col + row) % 5 <> 0), 0) AS trees, CASE WHEN (col + row) % 5 = 0 THEN 'ValueError: no prediction' END AS error FROM points JOIN t ON x >= xlo AND x < xhi AND y > ylo AND y <= yhi GROUP BY col, row", g=GRID, t=TILES)
def md5(p):
    placed = tiles.assign_tiles(p.select("point_id", "x", "y", "z"), grid_of(p))
    found, failed = predictions.predict_surviving(placed, height_predictor, f"col bigint, row bigint, point_id {id_type(p)}, sem0 double, sem1 double")
    good = found.groupBy("col", "row").agg(F.count("*").alias("n"), F.count_if(F.col("sem0") > F.col("sem1")).alias("trees"), F.lit(None).cast("string").alias("error"))
    zero = F.lit(0).cast("bigint")
    return good.unionByName(failed.select("col", "row", zero.alias("n"), zero.alias("trees"), "error"))
