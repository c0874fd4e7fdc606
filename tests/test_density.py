"""Density clusters: cells in doubt with many points, and the whole queries against plain solutions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groveframe.functions.columns import tree_probability
from groveframe.operators import clustering
from groveframe.plans import registry
from groveframe.plans.forest import points
from groveframe.plans.queries import shifted, with_offsets

from .conftest import SF


def plain_dbscan(ids, xy, eps, least):
    """Components of the eps-graph by blocks of distances; numbered by their smallest id."""
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(ids), 500):
        d2 = ((xy[a : a + 500, None] - xy[None]) ** 2).sum(2)
        for i, j in np.argwhere(d2 <= eps * eps):
            root[top(a + i)] = top(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(int(ids[i]))
    large = sorted((g for g in groups.values() if len(g) >= max(2, least)), key=min)
    return dict.fromkeys(map(int, ids), -1) | {i: n for n, g in enumerate(large, 1) for i in g}


def borders(gap, n):
    """Two straight rows of points in neighbouring cells (across a corner) of eps 1: far more pairs than may be compared."""
    t = np.linspace(0.0, 0.5, n)
    one = np.stack([t, 0.5 - t], 1)
    return one, one + gap / math.sqrt(2)


@pytest.mark.parametrize("near", [False, True])
def test_cells_in_doubt_with_many_points(spark, near):
    one, two = borders(1.0005, 20_000)
    if near:  # one point of the second row, and none of the extreme ones, is near enough
        two[7013] = one[7013] + (1 - 1e-7) / math.sqrt(2)
    xy = np.concatenate([one, two])
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    got = clustering.dbscan(df, 1.0, 2).toPandas().set_index("point_id").sort_index()["cluster"].to_numpy()
    assert (got[:20_000] == 1).all() and (got[20_000:] == (1 if near else 2)).all()


@pytest.mark.parametrize("few", [0, 250_000])
def test_pairs_by_parts_equal_pairs_by_points(spark, few):
    """Random cells, ties at the very distance, repeated points; with few = 0 every pair is divided."""
    rng = np.random.default_rng(12)
    side, rows = 1 / 2**0.5, {"l": [], "r": []}
    want = set()
    for a in range(40):
        cells = [(0.0, 0.0), (side, side) if a % 2 else (side, 0.0)]
        one, two = (np.array(c) + rng.uniform(0.02, side - 0.02, (int(rng.integers(1, 30)), 2)) * (1 if a % 3 else 0.4) for c in cells)
        if a == 5:
            one, two = np.array([[0.25, 0.25]] * 3), np.array([[0.25 + 0.5, 0.25 + 0.5], [1.25, 0.75]])
        if (((one[:, None] - two[None]) ** 2).sum(2) <= 1.0).any():
            want.add((a, a + 100))
        rows["l"] += [(a, a + 100, *map(float, p)) for p in one]
        rows["r"] += [(a, a + 100, *map(float, p)) for p in two]
    left, right = (spark.createDataFrame(rows[k], "a bigint, b bigint, x double, y double") for k in "lr")
    for levels in (12, 1):
        assert {(r.a, r.b) for r in clustering.near_pairs(left, right, 1.0, side, few, levels).collect()} == want


def test_whole_query_of_density_clusters(spark):
    rows = shifted(points(spark, SF)).toPandas()
    got = {r.point_id: r.cluster for r in registry.QUERIES["CL2"](spark, SF).collect()}
    assert got == plain_dbscan(rows["point_id"].to_numpy(), rows[["x", "y"]].to_numpy(), 0.15, 20)


def test_whole_queries_of_verticality_and_instances(spark):
    """Normals by an eigenvalue solver over all pairs, and the instances that follow from them."""
    cloud = points(spark, SF).toPandas().sort_values("point_id", ignore_index=True)
    xyz, value = cloud[["x", "y", "z"]].to_numpy(), np.full(len(cloud), np.nan)
    for i, p in enumerate(xyz):
        near = xyz[((xyz - p) ** 2).sum(1) <= 0.36]
        if len(near) > 2:
            low, vectors = np.linalg.eigh(np.cov((near - p).T, bias=True))
            if low[1] - low[0] > 1e-9 * max(low[2], 1e-9):
                value[i] = 1 - abs(vectors[2, 0])
    got = {r.point_id: r.verticality for r in registry.QUERIES["AG2"](spark, SF).collect()}
    sure = [i for i in range(len(cloud)) if not np.isnan(value[i])]
    assert len(sure) > 0 and all(got[int(cloud["point_id"][i])] is not None and abs(got[int(cloud["point_id"][i])] - value[i]) < 1e-4 for i in sure)
    cloud["verticality"] = [got[i] for i in cloud["point_id"]]
    cloud["verticality"] = cloud["verticality"].astype(float).fillna(cloud["verticality"].astype(float).mean())
    made = with_offsets(points(spark, SF)).withColumn("p_tree", tree_probability(F.col("sem0"), F.col("sem1"))).toPandas().sort_values("point_id", ignore_index=True)
    kept = (made["p_tree"] >= 0.5) & (cloud["verticality"] > 0.6) & (made["dz"].abs() < 4.0)
    moved = made[["x", "y"]].to_numpy() + made[["dx", "dy"]].to_numpy()
    want = dict(zip(made["point_id"].tolist(), np.where(made["p_tree"] >= 0.5, -1, 0).tolist(), strict=True))
    want |= plain_dbscan(made["point_id"][kept].to_numpy(), moved[kept], 0.15, 20)
    assert {r.point_id: r.instance for r in registry.QUERIES["CL1"](spark, SF).collect()} == want
