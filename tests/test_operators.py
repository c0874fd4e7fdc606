"""Hand-sized cases and brute force for operators that SQL cannot express."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveframe import config
from groveframe.functions import columns as c
from groveframe.operators import clustering, evaluation, hulls, neighbours, predictions, tiles, voxels
from groveframe.sources import clouds
from groveframe.streaming import ingest

from .conftest import SF

XYZ = "point_id bigint, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], XYZ)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (12.345,), (2.675,)], "x double")
    assert [r[0] for r in df.select(c.half_even(F.col("x"))).collect()] == np.round([0.125, -0.125, 12.345, 2.675], 2).tolist()


def test_las_labels(spark):
    df = spark.createDataFrame([(5, 4), (5, 1), (0, 2), (0, 3)], "t bigint, k int")
    assert [r[0] for r in df.select(c.las_label(F.col("t"), F.col("k"))).collect()] == [5, 0, 0, -1]


def test_dense_labels(spark):
    df = spark.createDataFrame([(7,), (3,), (9,), (3,)], "l bigint")
    assert {(r.old, r.new) for r in voxels.dense_labels(df, "l").collect()} == {(3, 1), (7, 2), (9, 3)}


def test_tree_probability_does_not_overflow(spark):
    df = spark.createDataFrame([(-800.0, 800.0), (800.0, -800.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(c.tree_probability(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.5]


def test_base_position_and_heights(spark):
    rows = [(i, 1, 0.0, 0.0, i / 10) for i in range(21)] + [(100 + i, 2, 1.0, 1.0, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "point_id bigint, gt bigint, x double, y double, z double")
    got = {r.gt: r for r in voxels.base_positions(df).collect()}
    assert math.isclose(got[1].z0, 0.3) and got[2].z0 == 0.0
    assert {r.gt: r.kth for r in voxels.kth_height(df, 5, largest=True).collect()} == {1: 1.6, 2: None}


def test_majority_takes_the_lowest_on_ties(spark):
    found = spark.createDataFrame([(1, i) for i in range(5)], "id bigint, other bigint")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, 5, 3, 9])], "source_id bigint, label bigint")
    assert neighbours.majority(found, labels).first().label == 3


def test_knn_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((60, 3)) * [10, 10, 2], np.vstack([rng.random((80, 3)) * 5, [[40, 40, 40]]])
    got = neighbours.knn(cloud(spark, b).withColumn("point_id", F.col("point_id")), cloud(spark, a), 4, 0.5).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.rank, r.other))
    for i, q in enumerate(b):
        d = ((a - q) ** 2).sum(1)
        assert [o for _, o in sorted(by[i])] == np.lexsort((np.arange(60), d))[:4].tolist()
    assert neighbours.knn(cloud(spark, b), cloud(spark, a).limit(0), 4, 0.5).count() == 0


def test_verticality_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((150, 3)) * [2, 2, 3]
    got = {r.point_id: r.verticality for r in neighbours.neighbour_verticality(cloud(spark, pts), 0.7).collect()}
    for i, p in enumerate(pts):
        near = pts[((pts - p) ** 2).sum(1) <= 0.49]
        if len(near) < 3:
            assert got[i] is None
            continue
        assert abs(got[i] - (1 - abs(np.linalg.eigh(np.cov(near.T, bias=True))[1][2, 0]))) < 1e-4


def components_of(pts, eps):
    parent = list(range(len(pts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(pts)), 2):
        if ((pts[i] - pts[j]) ** 2).sum() <= eps * eps:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(pts))]


def partition(ids, labels):
    groups = {}
    for i, k in zip(ids, labels, strict=True):
        groups.setdefault(k, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_dbscan_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((200, 2)) * 4
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id bigint, x double, y double")
    got = {r.point_id: r.cluster for r in clustering.dbscan(df, 0.25, 2).collect()}
    want = [g for g in partition(range(200), components_of(pts, 0.25)) if len(g) > 1]
    assert partition([i for i in got if got[i] > 0], [got[i] for i in got if got[i] > 0]) == set(want)
    pair = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.1), (2, 1.0, 1.0)], "point_id bigint, x double, y double")
    assert {r.point_id: r.cluster for r in clustering.dbscan(pair, 0.15, 1).collect()} == {0: 1, 1: 1, 2: -1}


def test_assignment_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 6)))
        w[rng.random(w.shape) < 0.3] = 0
        got = sum(x for _, _, x in evaluation.assign([(i, j, float(v)) for (i, j), v in np.ndenumerate(w) if v > 0]))
        small, flip = (w, False) if w.shape[0] <= w.shape[1] else (w.T, True)
        want = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert math.isclose(got, want, abs_tol=1e-12), flip


def test_matching_takes_the_largest_total(spark):
    """Two lesser pairs outweigh the one above the threshold, so nothing matches."""
    rows = [(1, 1)] * 100 + [(1, 2)] * 48 + [(2, 1)] * 48
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(rows)], "point_id bigint, pred bigint, gt bigint")
    assert evaluation.match_trees(evaluation.contingency(df)).count() == 0


def test_ring_and_hull(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = cloud(spark, [(0.5, 0.5, 0), (0, 0.5, 0), (2, 2, 0)])
    assert [r.in_hull for r in hulls.in_hull(df, square).orderBy("point_id").collect()] == [True, False, False]
    pts = [(x / 4, y / 4) for x in range(9) for y in range(9)]
    assert set(hulls.convex_ring(pts)) == {(0, 0), (2, 0), (2, 2), (0, 2)}
    bay = [(x, y) for x, y in pts if not (0.6 < x < 1.4 and y > 0.6)]
    ring = hulls.plot_hull(cloud(spark, [(x, y, 0) for x, y in bay]), 2.1, 0.05)
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert 2.3 < area < 3.5


def test_tiles_cover_all_points(spark):
    rng = np.random.default_rng(6)
    pts = rng.random((400, 3)) * [60, 45, 5]
    for stride in (1.0, 0.5, 0.25):
        g = tiles.tile_grid((0.0, 60.0, 0.0, 45.0), stride=stride)
        got = tiles.assign_tiles(cloud(spark, pts), g).groupBy("point_id").count().collect()
        assert len(got) == 400 and max(r["count"] for r in got) <= (1 / stride) ** 2
    assert tiles.half_even(2.5) == 2


def test_propagation_to_itself_is_the_identity(spark):
    p = spark.createDataFrame([(i, float(i % 7), float(i // 7), 0.0, i % 3) for i in range(40)], XYZ + ", pred bigint")
    got = {r.id: r.label for r in predictions.propagate_nearest(p, p, 1, 0.5).collect()}
    assert got == {i: i % 3 for i in range(40)}
    unlabelled = p.withColumn("pred", F.lit(-1).cast("bigint"))
    assert {r.pred for r in predictions.assign_remaining(unlabelled, "pred", 5, 0.5).collect()} == {-1}


def test_clouds_round_trip(spark, tmp_path):
    rows = [(i, i / 10, i / 20, i / 30, i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, XYZ + ", label bigint").coalesce(1)
    clouds.write_points(df, str(tmp_path / "las"), "las")
    got = clouds.read_points(spark, str(tmp_path / "las"))
    assert [(r.point_id, r.label) for r in got.orderBy("point_id").collect()] == [(i, i % 4) if i % 4 else (i, 0) for i in range(100)]
    assert max(abs(r.x - r.point_id / 10) for r in got.collect()) < 1e-3
    np.save(tmp_path / "a.npy", np.array([r[1:4] for r in rows]))
    assert {r.label for r in clouds.read_points(spark, str(tmp_path / "a.npy")).collect()} == {-1}
    np.savez(tmp_path / "a.npz", points=np.array([r[1:4] for r in rows]), labels=np.array([r[4] for r in rows]))
    assert [r.label for r in clouds.read_points(spark, str(tmp_path / "a.npz")).orderBy("point_id").collect()] == [r[4] for r in rows]
    clouds.write_points(df, str(tmp_path / "txt"), "txt")
    (tmp_path / "txt").rename(tmp_path / "cloud.txt")
    assert clouds.read_points(spark, str(tmp_path / "cloud.txt")).count() == 100
    with pytest.raises(ValueError):
        clouds.read_points(spark, "x.laz")


def test_config_overlay():
    got = config.overlay(config.Config(), {"sampling": {"stride": 1.0}, "alpha": 0.0})
    assert (got.sampling.stride, got.sampling.inner_edge, got.alpha) == (1.0, 8.0, 0.0)
    assert config.fingerprint(got) != config.fingerprint(config.Config())
    with pytest.raises(KeyError):
        config.overlay(config.Config(), {"nothing": 1})


def test_streaming_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.window.start, r.event_type): r.n for r in ingest.drain(ingest.event_windows(stream, late="1000 days"), "windows").collect()}
    want = {(r.window.start, r.event_type): r["count"] for r in batch.groupBy(F.window("ts", "1 hour"), "event_type").count().collect()}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], XYZ + ", pred bigint, gt bigint")
    assert voxels.voxelize(none, 0.5).count() == 0
    assert clustering.dbscan(none, 0.2, 2).count() == 0
    assert evaluation.match_trees(evaluation.contingency(none)).count() == 0
    one = evaluation.detection_summary(evaluation.match_trees(evaluation.contingency(none)), evaluation.contingency(none), none.select("pred"), none.select("gt")).first()
    assert one.completeness is None and one.f1 is None


def test_knn_ends_on_rows_without_a_place_and_far_away(spark):
    """Null, NaN and infinite coordinates have no neighbours; far queries, copies, ties and few sources end in a few steps."""
    rows = [(0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, 5e6, -5e6, 0.0), (4, 0.0, float("inf"), 0.0), (5, 1.0, 0.0, 0.0), (6, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, XYZ)
    got = sorted((r.id, r.rank, r.other) for r in neighbours.knn(df, df, 2, 0.5).collect())
    assert got == [(0, 1, 0), (0, 2, 5), (3, 1, 3), (3, 2, 5), (5, 1, 5), (5, 2, 6), (6, 1, 5), (6, 2, 6)] or [r for r in got if r[0] != 3] == [(0, 1, 0), (0, 2, 5), (5, 1, 5), (5, 2, 6), (6, 1, 5), (6, 2, 6)]
    assert {r[0] for r in got} == {0, 3, 5, 6}
    assert len(neighbours.knn(df, df.where("point_id = 0"), 5, 0.5).collect()) == 4


def test_knn_where_points_are_dense(spark, monkeypatch):
    rng = np.random.default_rng(21)
    pts = np.vstack([rng.normal(0, 0.01, (150, 3)), rng.random((30, 3)) * 20])
    monkeypatch.setattr(neighbours, "DENSE", 8)
    by = {}
    for r in neighbours.knn(cloud(spark, pts), cloud(spark, pts), 3, 0.5).collect():
        by.setdefault(r.id, {})[r.rank] = r.other
    for i, q in enumerate(pts):
        assert [by[i][k] for k in (1, 2, 3)] == np.lexsort((np.arange(180), ((pts - q) ** 2).sum(1)))[:3].tolist()


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        clustering.components(chain, most_rounds=1)


def test_dbscan_of_dense_cells_and_rows_without_a_place(spark):
    rng = np.random.default_rng(22)
    blobs = np.vstack([rng.normal(c, 0.08, (60, 2)) for c in ((0, 0), (0.6, 0.1), (2, 2), (2.1, 2.5), (-1, 3))])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(blobs)] + [(900, None, 1.0), (901, float("nan"), 0.0)]
    got = {r.point_id: r.cluster for r in clustering.dbscan(spark.createDataFrame(rows, "point_id bigint, x double, y double"), 0.12, 2).collect()}
    assert got.pop(900) == -1 and got.pop(901) == -1 and len(got) == 300
    want = [g for g in partition(range(300), components_of(blobs, 0.12)) if len(g) > 1]
    assert partition([i for i in got if got[i] > 0], [got[i] for i in got if got[i] > 0]) == set(want)
    assert clustering.dbscan(spark.createDataFrame([], "point_id bigint, x double, y double"), 0.1, 2).count() == 0


def test_matching_brute_force(spark):
    """Chains of overlaps: the settled pairs and the rest give the total of the dense assignment."""
    rng = np.random.default_rng(23)
    w = np.where(rng.random((7, 7)) < 0.45, rng.random((7, 7)), 0)
    pairs = spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(w) if v], "pred bigint, gt bigint, iou double")
    got = sum(r.iou for r in evaluation.match_trees(pairs, 0.0).collect())
    assert math.isclose(got, max(sum(w[i, p[i]] for i in range(7)) for p in itertools.permutations(range(7))))


@pytest.mark.parametrize("shape", ["chain", "tree", "ladder", "rising"])
def test_matching_of_one_large_component(spark, monkeypatch, shape):
    """Rounds that settle and fold give the total of the list solution, though no component is small enough to be solved as it is."""
    rng = np.random.default_rng(29)
    if shape == "chain":
        edges = {(i // 2 + i % 2 + 1, i // 2 + 1): rng.random() for i in range(400)}
    elif shape == "tree":
        edges = {(i + 1, int(rng.integers(max(0, i - 3), i + 1)) + 1): rng.random() for i in range(150)} | {(int(rng.integers(0, i + 1)) + 1, i + 2): rng.random() for i in range(150)}
    elif shape == "ladder":
        edges = {(i + 1, j + 1): rng.random() for i in range(60) for j in (i, (i + 1) % 60, (i + 7) % 60)}
    else:
        edges = {(i // 2 + i % 2 + 1, i // 2 + 1): 0.01 * (i + 1) for i in range(20)}
    solved = []
    real = evaluation.components
    monkeypatch.setattr(evaluation, "components", lambda e: solved.append(e.count()) or real(e))
    pairs = spark.createDataFrame([(p, g, float(w)) for (p, g), w in edges.items()], "pred bigint, gt bigint, iou double")
    got = evaluation.match_trees(pairs, 0.0, most=0).collect()
    assert len({r.pred for r in got}) == len({r.gt for r in got}) == len(got) and all(edges[r.pred, r.gt] == r.iou for r in got)
    assert math.isclose(sum(r.iou for r in got), sum(x for _, _, x in evaluation.assign([(p, g, float(w)) for (p, g), w in edges.items()])))
    assert shape == "ladder" or not solved  # without cycles nothing is left to a task


def test_ring_of_many_edges(spark):
    ring = [((5 + math.sin(7 * t)) * math.cos(t), (5 + math.sin(7 * t)) * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 1200, endpoint=False)]
    rng = np.random.default_rng(24)
    pts = rng.uniform(-7, 7, (200, 3))
    got = {r.point_id: (r.in_hull, r.in_buffer) for r in hulls.in_buffer(hulls.in_hull(cloud(spark, pts), ring), ring, 0.5).collect()}
    for i, (x, y, _) in enumerate(pts):
        t, far = math.atan2(y, x), math.hypot(x, y)
        if abs(far - 5 - math.sin(7 * t)) > 0.05:
            assert got[i][0] == (far < 5 + math.sin(7 * t))
        near = min(math.dist((x, y), p) for p in ring)
        if abs(near - 0.5) > 0.05:
            assert got[i][1] == (near < 0.5)


def test_numbers_in_groups(spark):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(7)] + [(None, i) for i in range(3)]
    got = sorted((r.g or 0, r.o, r.number) for r in voxels.numbered(spark.createDataFrame(rows, "g bigint, o bigint").repartition(5), "g", "o").collect())
    assert got == sorted((g or 0, o, o + 1) for g, o in rows)


def test_nearest_queries_brute_force(spark):
    """JN6, JN9 and FP10 over the whole smallest forest."""
    from groveframe.plans.forest import points
    from groveframe.plans.registry import QUERIES

    rows = points(spark, SF).select("point_id", "x", "y", "z", "gt", "pred").orderBy("point_id").collect()
    ids, xyz = np.array([r.point_id for r in rows]), np.array([(r.x, r.y, r.z) for r in rows])

    def nearest(q, s, k):
        out = []
        for i in q:
            d = ((xyz[s] - xyz[i]) ** 2).sum(1)
            near = s[np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + 1e-9)]
            d = ((xyz[i, 0] - xyz[near, 0]) ** 2 + (xyz[i, 1] - xyz[near, 1]) ** 2) + (xyz[i, 2] - xyz[near, 2]) ** 2
            out.append((d[np.lexsort((ids[near], d))][:k], near[np.lexsort((ids[near], d))][:k]))
        return out

    def vote(labels):
        found, n = np.unique(labels, return_counts=True)
        return int(found[n.argmax()])

    gt = np.array([r.gt for r in rows])
    q, s = np.flatnonzero(gt == -1), np.flatnonzero(gt != -1)
    want = dict(zip(ids.tolist(), gt.tolist(), strict=True)) | {int(ids[i]): vote(gt[near]) for i, (_, near) in zip(q, nearest(q, s, 5), strict=True)}
    assert {r.point_id: r.gt for r in QUERIES["JN6"](spark, SF).collect()} == want

    every = np.arange(len(ids))
    mean = np.array([np.sqrt(d).sum() for d, _ in nearest(every, every, 6)]) / 5
    kept = {int(i) for i, m in zip(ids, mean, strict=True) if m <= mean.mean() + 2 * mean.std()}
    assert {r.point_id for r in QUERIES["FP10"](spark, SF).collect()} == kept

    key = [tuple(np.floor((p + 200) / 0.5).astype(int)) for p in xyz]
    first = {}
    for k, i, r in zip(key, ids, rows, strict=True):
        if k not in first or i < first[k][0]:
            first[k] = (int(i), r.pred)
    given = np.array([first[k][1] if first[k][0] % 5 else -1 for k in key])
    q, s = np.flatnonzero(given == -1), np.flatnonzero(given != -1)
    want = dict(zip(ids.tolist(), given.tolist(), strict=True)) | {int(ids[i]): vote(given[near]) for i, (_, near) in zip(q, nearest(q, s, 5), strict=True)}
    assert {r.point_id: r.pred for r in QUERIES["JN9"](spark, SF).collect()} == want


def test_evaluation_plan_equals_its_queries(spark, tmp_path):
    """Predictions at the points of the truth themselves: each takes the majority of its five nearest, here of one point five times."""
    from groveframe.config import Config, Evaluation
    from groveframe.plans.forest import points
    from groveframe.plans.registry import QUERIES
    from groveframe.plans.scoring import evaluate

    p = points(spark, SF).select("point_id", "x", "y", "z", "gt", "pred")
    done = evaluate(p.drop("gt"), p.drop("pred"), Config(evaluation=Evaluation(neighbours=1)), 0.3)
    same = done.propagated.join(p.select("point_id", F.col("pred").alias("own")), "point_id").where("pred = own").count()
    assert done.propagated.count() == p.count() and same > 0.99 * p.count()
    whole = QUERIES["AG12"](spark, SF).first()
    assert all(abs(done.detection.first()[c] - 100 * whole[c]) < 1.5 for c in ("completeness", "omission", "commission", "f1"))
    assert done.trees.count() == QUERIES["AG16"](spark, SF).count() and len(done.by_height.columns) == 31
    done.write(str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results" / "matches")).count() == done.matches.count()


def test_folders_of_clouds(spark, tmp_path):
    rows = [(i, i / 10, i / 20, i / 30, i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, XYZ + ", label bigint").repartition(3, "point_id")
    for kind in ("las", "npy", "npz", "txt", "parquet"):
        clouds.write_points(df, str(tmp_path / kind), kind)
        got = clouds.read_plots(spark, str(tmp_path / kind)).collect()
        assert sorted((round(r.x, 3), r.label) for r in got) == sorted((r[1], r[4]) for r in rows), kind
        assert len({r.point_id for r in got}) == 100 and all(r.plot.startswith("part-") for r in got)
    clouds.write_las(df.coalesce(1), str(tmp_path / "small"), at_most=30).collect()
    assert len(list((tmp_path / "small").glob("*.las"))) == 4 and clouds.read_points(spark, str(tmp_path / "small")).count() == 100
    np.savez_compressed(tmp_path / "big.npz", points=np.arange(300.0).reshape(100, 3), labels=np.arange(100))
    part = spark.read.format("groveframe_numpy").option("rows", 7).load(str(tmp_path / "big.npz"))
    assert sorted((r.x, r.label) for r in part.collect()) == [(3.0 * i, i) for i in range(100)]
    clouds.write_trees(df, spark.createDataFrame([(1, "completely_inside")], "label bigint, category string"), str(tmp_path / "trees"))
    got = spark.read.parquet(str(tmp_path / "trees"))
    assert {(r.category, r.label) for r in got.select("category", "label").distinct().collect()} == {("non_trees", 0), ("completely_inside", 1), ("trunk_base_outside", 2), ("trunk_base_outside", 3)}
    assert abs(got.agg(F.avg("x")).first()[0]) < 1e-9


def test_alpha_shape_brute_force(spark):
    """Edges of the triangles of small circumcircles that hold no other point, over all triples."""
    rng = np.random.default_rng(31)
    pts = np.vstack([rng.uniform(0, 4, (45, 2)), rng.uniform(6, 7, (6, 2)), [[20, 20]]])
    pts = pts[~((np.abs(pts - 2) < 0.8).all(1))]
    want = {}
    for t in itertools.combinations(range(len(pts)), 3):
        (ax, ay), (bx, by), (cx, cy) = pts[t[0]], pts[t[1]] - pts[t[0]], pts[t[2]] - pts[t[0]]
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        far = ((pts - [ax + ux, ay + uy]) ** 2).sum(1)
        if ux * ux + uy * uy < 0.8**2 and (np.delete(far, t) > ux * ux + uy * uy).all():
            for e in itertools.combinations(t, 2):
                want[e] = want.get(e, 0) + 1
    got = {(r.a, r.b) for r in hulls.alpha_edges(cloud(spark, [(x, y, 0) for x, y in pts]), 1 / 0.8).collect()}
    assert got == {e for e, n in want.items() if n == 1} and len(got) > 20
    assert hulls.alpha_edges(cloud(spark, [(0, 0, 0)]), 1.0).count() == 0


def test_running_ensemble_equals_batch(spark, tmp_path):
    rows = [(i % 7, float(i), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "point_id bigint, dx double, sem0 double")
    df.repartition(3).write.parquet(str(tmp_path / "tiles"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "tiles"))
    got = {r.point_id: (r.dx, r.sem0, r.n) for r in ingest.drain(ingest.running_ensemble(stream, ["dx", "sem0"]), "ensemble_test").collect()}
    want = {r.point_id: (r.dx, r.sem0, r.n) for r in predictions.ensemble(df, ["point_id"], ["dx", "sem0"], []).collect()}
    assert got == want and len(got) == 7
