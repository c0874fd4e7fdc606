"""The segmentation plan with a hull, outer removal, edge categories and the nearest fallback, and the categories of trees, by brute force."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from groveframe.operators import hulls
from groveframe.plans import registry, segmentation
from groveframe.plans.forest import points
from groveframe.plans.queries import PLAN, tile_predictions

from .conftest import SF
from .test_hull_index import distances


def inside(xy, ring):
    a = np.array(ring, float)
    b = np.roll(a, -1, 0)
    x, y = xy[:, :1], xy[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum(1) % 2 == 1


def categories(label, edge, xy, ring):
    out = {}
    for tree in np.unique(label[label > 0]):
        mine = label == tree
        within = inside(xy[mine].mean(0)[None], ring)[0]
        out[int(tree)] = "trunk_base_outside" if not within else "trunk_base_inside" if edge[mine].any() else "completely_inside"
    return out


def hull_of_a_part(xy):
    (x0, y0), (x1, y1) = np.quantile(xy, 0.3, 0).tolist(), np.quantile(xy, 0.9, 0).tolist()
    return [(x0, y0), (x1, y0 - 3.0), (x1 + 2.0, y1), (x0 - 1.0, y1 + 1.0)]


def test_categories_of_trees(spark):
    cloud = points(spark, SF)
    ring = hulls.plot_hull(cloud, 0.6)
    rows = cloud.toPandas()
    xy = rows[["x", "y"]].to_numpy()
    pred = rows["pred"].to_numpy()
    assert {r.pred: r.category for r in registry.QUERIES["PJ9"](spark, SF).collect()} == categories(pred, distances(xy, ring) < 0.3, xy, ring)
    # trees of this forest lie across the plot: a hull around a part of it has trees of other categories
    ring = hull_of_a_part(xy)
    for width in (0.3, 1e-3):
        got = {r.pred: r.category for r in hulls.tree_categories(cloud, ring, width).collect()}
        assert got == categories(pred, distances(xy, ring) < width, xy, ring)
    assert len(set(got.values())) > 1


def test_segmentation_with_a_hull(spark):
    cloud, config = points(spark, SF), replace(PLAN, outer_remove=1.0, edge_buffer=2.5)
    ring = hull_of_a_part(cloud.toPandas()[["x", "y"]].to_numpy())
    got, named = segmentation.segment(cloud, tile_predictions(cloud), config, ring)
    got, named = {r.point_id: r.instance for r in got.collect()}, {r.label: r.category for r in named.collect()}

    done = segmentation.pointwise(tile_predictions(cloud), config).toPandas()
    done = done[distances(done[["x", "y"]].to_numpy(), ring) >= 1.0].sort_values("point_id", ignore_index=True)
    names = {v: n for n, v in enumerate(sorted(set(done["instance"]) - {0, -1}), 1)}
    label = done["instance"].map(lambda v: names.get(v, v)).to_numpy()
    edge = distances(done[["x", "y"]].to_numpy(), ring) < 2.5
    assert named == categories(label, edge, done[["x", "y"]].to_numpy() + done[["dx", "dy"]].to_numpy(), ring)

    rows = cloud.toPandas()
    rows = rows[distances(rows[["x", "y"]].to_numpy(), ring) >= 1.0]
    voxel = dict(zip(done[["vx", "vy", "vz"]].itertuples(index=False, name=None), label, strict=True))
    at, ids, want, fallen = done[["x", "y", "z"]].to_numpy(), done["point_id"].to_numpy(), {}, 0
    for r in rows.itertuples():
        key = tuple(int(np.floor((v + 200.0) / PLAN.sampling.voxel_size)) for v in (r.x, r.y, r.z))
        if key not in voxel:
            fallen += 1
            d2 = (at[:, 0] - r.x) ** 2 + (at[:, 1] - r.y) ** 2 + (at[:, 2] - r.z) ** 2
            values, counts = np.unique(label[np.lexsort((ids, d2))[:5]], return_counts=True)
            want[r.point_id] = values[counts.argmax()]
        else:
            want[r.point_id] = voxel[key]
    assert got == want and fallen > 100 and 0 < len(rows) < cloud.count() and len(set(named.values())) > 1
