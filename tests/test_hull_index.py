"""Distance to a ring by cells against all edges; archives that are unpacked once; trees that share a prediction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groveframe.operators import evaluation, hulls
from groveframe.sources import clouds

XYZ = "point_id bigint, x double, y double, z double"


def distances(xy, ring):
    a = np.array(ring, float)
    d = np.roll(a, -1, 0) - a
    size = (d * d).sum(1)
    v = xy[:, None] - a[None]
    t = np.where(size > 0, np.clip((v * d).sum(2) / np.where(size > 0, size, 1), 0, 1), 0)
    return np.sqrt(((v - t[..., None] * d) ** 2).sum(2)).min(1)


def circle(n, radius, x=0.0, y=0.0):
    return [(x + radius * math.cos(t), y + radius * math.sin(t)) for t in np.linspace(0, 2 * math.pi, n, endpoint=False)]


RINGS = {
    "square": ([(0, 0), (10, 0), (10, 10), (0, 10)], 1.5),
    "wide": ([(0, 0), (1, 0), (0.4, 2)], 8.0),
    "thin": ([(0, 0), (10, 0), (10, 10), (0, 10)], 0.01),
    "slanted": ([(0, 0), (10, 9.5), (9, 10), *((9 - i / 40, 10 - i * i / 9e4) for i in range(300))], 0.4),
    "far": ([(4e5 + x, 5.6e6 + y) for x, y in circle(70, 8)], 0.5),
    "repeated": ([(1, 1), (1, 1), (9, 1), (9, 9), (9, 9)], 1.0),
    "one place": ([(3, 3), (3, 3), (3, 3)], 2.0),
    "no width": ([(0, 0), (10, 0), (10, 10)], 0.0),
}


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("name", RINGS)
def test_buffer_by_cells(spark, name, most):
    ring, width = RINGS[name]
    low, high = np.min(ring, 0) - 1.5 * width - 1, np.max(ring, 0) + 1.5 * width + 1
    rng = np.random.default_rng(31)
    corners = np.array(ring, float)
    # anywhere, near the ring, and at corners and cell borders
    xy = np.concatenate([rng.uniform(low, high, (1500, 2)), corners[rng.integers(0, len(corners), 500)] + rng.normal(0, width + 0.01, (500, 2)), corners, np.round(rng.uniform(low, high, (200, 2)))])
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    rows = hulls.in_buffer(df, ring, width, most).toPandas().set_index("point_id").sort_index()
    d = distances(xy, ring)
    clear = np.abs(d - width) > 1e-8 if name == "far" else np.abs(d - width) > 1e-12
    assert len(rows) == len(xy) and (rows["in_buffer"].to_numpy()[clear] == (d < width)[clear]).all()
    assert name == "no width" or 0 < rows["in_buffer"].sum() < len(xy)


def test_buffer_of_odd_rows(spark):
    rows = [(1, 0.0, 0.5, "a"), (1, 0.0, 0.5, "a"), (2, None, 1.0, "b"), (3, float("nan"), 1.0, "c"), (4, float("inf"), 0.0, "d"), (None, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "point_id bigint, x double, y double, edges string")
    got = hulls.in_buffer(df, [(0, 0), (10, 0), (10, 10), (0, 10)], 1.0)
    assert got.columns == ["point_id", "x", "y", "edges", "in_buffer"]
    assert sorted((r.point_id or 0, r.in_buffer) for r in got.collect() if r.in_buffer is not None) == [(0, False), (1, True), (1, True), (3, False), (4, False)]
    assert got.where("in_buffer is null").count() == 1 and hulls.in_buffer(df.limit(0), [(0, 0), (1, 0), (1, 1)], 1.0).count() == 0
    assert not any(r.in_buffer for r in hulls.in_buffer(df, [], 1.0).collect())


def test_a_point_looks_at_the_edges_of_its_cell_only(spark):
    """Edges a point looks at, on average over the plane around the ring, and at worst."""
    seen = {}
    for n in (100, 1000, 10_000):
        cells, size = hulls.ring_cells(spark, circle(n, 60), 0.3)
        total = cells.agg(F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("n"), F.max(F.coalesce(F.size("edges"), F.lit(0))).alias("most")).first()
        seen[n] = total["n"] * size * size / 130**2, total["most"]
    assert seen[10_000][0] <= seen[1000][0] <= seen[100][0] < 1 and max(m for _, m in seen.values()) <= 16


def test_archives_are_unpacked_once(tmp_path, monkeypatch):
    points, labels = np.random.default_rng(5).normal(size=(50_000, 3)), np.arange(50_000)
    np.savez_compressed(tmp_path / "packed.npz", points=points, labels=labels)
    np.savez(tmp_path / "plain.npz", points=points, labels=labels)
    np.save(tmp_path / "plain.npy", points)
    read = []
    whole = clouds.Member.read
    monkeypatch.setattr(clouds.Member, "read", lambda self, rows: read.append(rows * self.width * self.kind.itemsize) or whole(self, rows))
    for name, parts in (("packed.npz", 1), ("plain.npz", 50), ("plain.npy", 50)):
        reader = clouds.NumpyReader(str(tmp_path / name), 1000)
        ranges = reader.partitions()
        assert len(ranges) == parts
        got = [b.to_pandas() for p in ranges for b in reader.read(p)]
        rows = pd.concat(got)
        assert (rows[["x", "y", "z"]].to_numpy() == points).all() and (rows["point_id"].to_numpy() == labels).all()
        assert (rows["label"].to_numpy() == (labels if "npz" in name else -1)).all()
    assert sum(read) == 3 * points.nbytes + 2 * labels.nbytes  # nothing is unpacked to be passed over


def plain_metrics(rows, best, axis, bins=10):
    """Counts by looking at every point for every tree."""
    trees = {g: [r for r in rows if r[5] == g] for g in best}
    out = {}
    for g, p in best.items():
        low = min(r[3] for r in trees[g])
        base = [r for r in trees[g] if r[3] < low + 0.3]
        px, py = np.mean([r[1] for r in base]), np.mean([r[2] for r in base])
        at = (lambda r, px=px, py=py: math.hypot(r[1] - px, r[2] - py)) if axis == "xy" else lambda r, low=low: r[3] - low
        far = sorted(map(at, trees[g]))[-5:][0] if len(trees[g]) > 4 else 0
        for r in rows:
            if far > 0 and (r[5] == g or (r[4] == p and p > 0)) and 0 <= at(r) / far < 1:
                n = out.setdefault((g, math.floor(at(r) / far * bins)), [0, 0, 0])
                n[0 if r[5] == g and r[4] == p else 1 if r[5] != g else 2] += 1
    return out


@pytest.mark.parametrize("axis", ["xy", "z"])
def test_bins_of_trees_that_share_a_prediction(spark, axis):
    rng = np.random.default_rng(8)
    gt = rng.integers(0, 30, 1500)
    # one prediction swallowed two thirds of all trees; tree 7 has its points in one place, tree 9 reaches far out
    pred = np.where(rng.random(1500) < 0.1, rng.integers(0, 5, 1500), np.where(gt % 3 == 0, gt, 99))
    x, y = gt % 6 * 3.0 + rng.normal(0, 0.8, 1500), gt // 6 * 3.0 + rng.normal(0, 0.8, 1500)
    x, y, z = np.where(gt == 7, 3.0, np.where(gt == 9, x * 40, x)), np.where(gt == 7, 3.0, y), np.where(gt == 7, 1.0, np.round(rng.uniform(0, 20, 1500), 1))
    rows = [(i, float(x[i]), float(y[i]), float(z[i]), int(pred[i]), int(gt[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "point_id bigint, x double, y double, z double, pred bigint, gt bigint")
    best = {int(g): 99 if g % 3 else int(g) for g in range(1, 30)} | {5: 0}
    got = evaluation.partition_metrics(df, spark.createDataFrame(list(best.items()), "gt bigint, pred bigint"), axis).collect()
    want = plain_metrics(rows, best, axis)
    assert {(r.gt, r.bin) for r in got} == set(want)
    for r in got:
        tp, fp, fn = want[r.gt, r.bin]
        for value, a, b in ((r.prec, tp, tp + fp), (r.rec, tp, tp + fn), (r.iou, tp, tp + fp + fn)):
            assert value is None if b == 0 else math.isclose(value, a / b)


def test_points_meet_the_trees_near_them(spark):
    """A prediction that 400 trees chose: pairs of points and circles grow with the trees, not with their square."""
    rows = [(i, i % 20 * 4 + math.cos(k), i // 20 * 4 + math.sin(k), float(k), 1, i + 1) for i in range(400) for k in range(10)]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "point_id bigint, x double, y double, z double, pred bigint, gt bigint")
    circles = spark.createDataFrame([(i + 1, 1, i % 20 * 4.0, i // 20 * 4.0, 1.01) for i in range(400)], "gt bigint, p bigint, px double, py double, far double")
    met = evaluation.foreign_in_circles(df, circles)
    assert met.count() == 0 and evaluation.foreign_in_circles(df, circles.withColumn("far", F.lit(4.5))).count() < 400 * 10 * 9
    assert evaluation.foreign_in_circles(df, circles.limit(0)).count() == 0
