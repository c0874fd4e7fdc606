"""The tile store, crops, draws, augmentation, inference that survives failed tiles, exact centroids."""

from __future__ import annotations

import hashlib
import math
import os
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groveframe.operators import predictions, sampling, tiles, voxels
from groveframe.plans import crops, segmentation
from groveframe.plans.forest import points
from groveframe.plans.queries import PLAN
from groveframe.sources import tile_store
from groveframe.sources.tile_store import read_tiles, write_tiles

from .conftest import SF


def made_tiles(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    col, row = rng.integers(0, 4, n), rng.integers(0, 3, n)
    df = pd.DataFrame({"col": col, "row": row, "mx": col * 4.0 + 0.25, "my": row * -4.0, "vx": rng.integers(0, 9, n), "vy": rng.integers(0, 9, n), "vz": rng.integers(0, 9, n), "point_id": np.arange(n), "x": rng.normal(size=n), "y": rng.normal(size=n), "z": rng.normal(size=n), "label": rng.integers(-1, 5, n), "verticality": rng.random(n), "inner": rng.random(n) < 0.5})
    return spark.createDataFrame(df, tile_store.SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select(*tile_store.NAMES).collect()))


def npz_files(folder):
    return sorted(f for f in os.listdir(f"{folder}/tiles")) if os.path.isdir(f"{folder}/tiles") else []


def test_store_round_trip_and_pruning(spark, tmp_path):
    tiles, folder = made_tiles(spark), str(tmp_path / "store")
    write_tiles(tiles, folder)
    assert rows_of(read_tiles(spark, folder)) == rows_of(tiles) and len(npz_files(folder)) == 12
    for condition, files in (("col = 2", 3), ("col = 2 and row >= 1", 2), ("mx < 4.0", 3), ("col in (0, 3) and my > -5.0", 4), ("col = 9", 1), ("x > 0", 12)):
        some = read_tiles(spark, folder).where(condition)
        assert rows_of(some) == rows_of(tiles.where(condition))
        assert some.rdd.getNumPartitions() == files  # a partition a file; none at all is an empty one


def test_store_appends_and_overwrites(spark, tmp_path):
    one, two, folder = made_tiles(spark), made_tiles(spark, 50, 2).withColumn("col", F.col("col") + 10), str(tmp_path / "store")
    write_tiles(one, folder)
    write_tiles(two, folder)
    assert rows_of(read_tiles(spark, folder)) == sorted(rows_of(one) + rows_of(two))
    write_tiles(two, folder, "overwrite")
    assert rows_of(read_tiles(spark, folder)) == rows_of(two) and len(npz_files(folder)) == two.select("col", "row").distinct().count()
    write_tiles(two.limit(0), str(tmp_path / "empty"))
    assert rows_of(read_tiles(spark, str(tmp_path / "empty"))) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_tiles(made_tiles(spark), folder)
    before = npz_files(folder)
    broken = made_tiles(spark).withColumn("z", F.when(F.col("point_id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="."):
        write_tiles(broken, folder)
    assert rows_of(read_tiles(spark, folder)) == rows_of(made_tiles(spark))
    writer = tile_store.Writer(folder, False)

    def breaking():
        yield made_tiles(spark).orderBy("col", "row").toArrow().combine_chunks().to_batches()[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaking())
    done = writer.write(iter(made_tiles(spark).orderBy("col", "row").toArrow().combine_chunks().to_batches()))
    assert len(npz_files(folder)) > len(before)
    writer.abort([done, None])
    assert set(npz_files(folder)) >= set(before) and len(npz_files(folder)) <= len(before) + 12


def test_centroids_are_exact_and_ties_go_to_even(spark):
    rng = np.random.default_rng(3)
    groups = [[1, 2], [2, 3], [-1, -2], [-2, -3], [-3525, -3524, -3525, -3523], [5], [-7, 0, 0, 0], *[rng.integers(-9000, 9000, int(rng.integers(1, 9))).tolist() for _ in range(300)]]
    df = spark.createDataFrame([(g, sum(v), len(v)) for g, v in enumerate(groups)], "g int, total long, n long")
    got = {r["g"]: r["c"] for r in df.select("g", voxels.mean_centimetres(F.col("total"), F.col("n")).alias("c")).collect()}
    assert got == {g: round(Fraction(sum(v), len(v))) / 100 for g, v in enumerate(groups)}


def test_tiles_do_not_depend_on_the_partitioning(spark):
    p = points(spark, SF).withColumn("label", F.col("gt"))
    found = [sorted(map(tuple, segmentation.generate_tiles(p.repartition(n), PLAN).groupBy("col", "row").agg(F.count("*"), F.sum(F.col("point_id") % 1000), F.min("x")).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_draws(spark):
    rows = [("a", i, i % 3) for i in range(500)] + [("b", 7, 1)] + [("c", 1, 0), ("c", 2, None)]
    df = spark.createDataFrame(rows, "g string, id long, w int")
    found = [sorted(map(tuple, sampling.draws(df.repartition(n), "g", "id", F.col("w"), F.when(F.col("g") == "a", 4000).otherwise(5)).collect())) for n in (1, 9)]
    assert found[0] == found[1]
    total, at, want = 499, {}, []
    for g, i, w in rows[:500]:
        for _ in range(w):
            at[len(at)] = i
    want = [("a", k, at[int(hashlib.md5(f"a:{k}".encode()).hexdigest()[:15], 16) % total]) for k in range(4000)] + [("b", k, 7) for k in range(5)]
    assert len(at) == total and found[0] == sorted(want)
    counts = pd.Series([r[2] for r in want[:4000]]).value_counts()
    assert all(i % 3 for i in counts.index) and abs(counts[counts.index % 3 == 2].sum() / 4000 - 2 / 3) < 0.03


def test_choice_without_replacement_follows_the_weights(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 4 < 2, 1.0).otherwise(3.0).alias("w"))
    quotas = spark.createDataFrame([(0, 500), (1, 5000)], "g long, quota long")
    got = sampling.chosen(df, "g", F.col("w"), quotas, "k").toPandas()
    assert (got.g == 0).sum() == 500 and (got.g == 1).sum() == 2000 and not got.k.duplicated().any()
    assert 2.0 < (got[got.g == 0].w == 3).sum() / (got[got.g == 0].w == 1).sum() < 3.6


def test_uniform_and_normal_moments(spark):
    row = spark.range(40000).select(F.floor(F.col("id") / 200).alias("t"), F.col("id")).select(sampling.uniform(F.col("t"), F.lit(4)).alias("tile"), sampling.uniform(F.col("t"), F.col("id"), F.lit(1)).alias("u"), sampling.normal(F.col("t"), F.col("id"), F.lit(2)).alias("n"))
    u, n, tile = (np.array(v) for v in row.toPandas()[["u", "n", "tile"]].to_numpy().T)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003 and 0 < u.min() and u.max() < 1
    assert abs(n.mean()) < 0.02 and abs(n.var() - 1) < 0.03 and abs((n**3).mean()) < 0.06 and abs(np.corrcoef(u, n)[0, 1]) < 0.02
    assert abs(np.unique(tile).mean() - 0.5) < 0.08


def test_augmentation_is_one_map_a_tile(spark):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"tile": np.repeat(np.arange(60), 30), "point_id": np.arange(1800), "x": rng.normal(size=1800), "y": rng.normal(size=1800), "z": rng.normal(size=1800)})
    got = sampling.augmented(spark.createDataFrame(df), jitter_prob=0.0).toPandas().sort_values("point_id")
    same = 0
    for t, part in df.groupby("tile"):
        a, b = part[["x", "y", "z"]].to_numpy(), got[got.tile == t][["x", "y", "z"]].to_numpy()
        m, rest, *_ = np.linalg.lstsq(a, b, rcond=None)
        assert np.abs(a @ m - b).max() < 1e-9
        same += np.allclose(m, np.eye(3))
    assert 0 <= same < 20
    shaken = sampling.augmented(spark.createDataFrame(df), jitter_prob=1.0, prob=0.0).toPandas().sort_values("point_id")
    moved = np.abs(shaken[["x", "y", "z"]].to_numpy() - df[["x", "y", "z"]].to_numpy())
    assert moved.max() <= 0.2 + 1e-9 and 0.06 < moved.mean() < 0.09


def test_failed_tiles_are_rows(spark):
    df = spark.createDataFrame([(c, r, 10 * c + r + 100 * k) for c in range(3) for r in range(2) for k in range(5)], "col long, row long, point_id long")

    def model(part):
        if part["col"].iloc[0] == 1 and part["row"].iloc[0] == 1:
            raise MemoryError("too large")
        return pd.DataFrame({"point_id": part["point_id"], "sem0": 1.0})

    found, failed = predictions.predict_surviving(df, model, "point_id long, sem0 double")
    assert found.columns == ["point_id", "sem0"] and sorted(r["point_id"] for r in found.collect()) == sorted(r["point_id"] for r in df.where("not (col = 1 and row = 1)").collect())
    assert [tuple(r) for r in failed.collect()] == [(1, 1, "MemoryError: too large")]


def test_outliers_are_told_within_a_crop(spark):
    rng = np.random.default_rng(6)
    rows = [(int(p), int(c), int(i), *map(float, rng.normal(size=3).round(2))) for p, c in ((0, 1), (0, 2), (3, 1)) for i in range(60 if c == 1 else 4)]
    rows += [(0, 1, 99, 9.0, 9.0, 9.0)]
    found = spark.createDataFrame(rows, "plot int, crop long, point_id long, u double, v double, z double")
    want_sor, want_rad = set(), set()
    for key in {r[:2] for r in rows}:
        part = [r for r in rows if r[:2] == key]
        xyz = np.array([r[3:] for r in part])
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
        mean = np.sort(d, axis=1)[:, 1:6].mean(axis=1)
        want_sor |= {part[i][:3] for i in np.flatnonzero(mean <= mean.mean() + 2.0 * mean.std())}
        want_rad |= {part[i][:3] for i in np.flatnonzero((d <= 0.9).sum(1) - 1 > 3)}
    assert {tuple(r)[:3] for r in crops.crop_inliers(found, 5, 2.0).select("plot", "crop", "point_id").collect()} == want_sor
    assert {tuple(r) for r in crops.crowded(found, 0.9, 3).select("plot", "crop", "point_id").collect()} == want_rad


def test_crops_meet_their_quotas(spark):
    p = points(spark, SF).withColumn("label", F.col("gt"))
    plan = crops.Crops(total=40, size=10.0, lattice=14, draws=3000, least_covered=0.02)
    taken = crops.chosen_crops(p, plan).toPandas()
    assert 0 < len(taken) <= 40 and not taken[["plot", "crop"]].duplicated().any() and taken["plot"].nunique() == 3
    inside = crops.training_crops(p, plan).selectExpr("max(greatest(abs(u), abs(v)))", "count(distinct plot, crop)").first()
    assert inside[0] <= 5.0 and inside[1] <= len(taken) and math.isfinite(inside[0])


def test_live_tiles_are_met_before_points_fan_out(spark):
    p = points(spark, SF)
    placed = segmentation.generate_tiles(p, PLAN, "gt")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(") < plan.index("Join ")


def test_some_tiles_are_those_of_all(spark):
    p = points(spark, SF).select("point_id", "x", "y")
    for outer, grid in ((13.5, tiles.tile_grid(tiles.bounds_of(p))), (0.5, tiles.tile_grid(tiles.bounds_of(p), 3.0, 2.0, 0.3))):
        some = tiles.tile_bounds(spark, grid).where("(col * 7 + row) % 3 = 0").select("col", "row")
        want = tiles.assign_tiles(p, grid, outer).join(some, ["col", "row"], "left_semi")
        got = tiles.assign_some_tiles(p, some, grid, outer)
        columns = ["point_id", "col", "row", "xlo", "yhi", "mx", "my"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
