"""Ids that 64 bits don't hold: order keys so far up that only they change, by a number which leaves all places and choices as they are."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from groveframe.operators import clustering, neighbours
from groveframe.plans import registry
from groveframe.plans.forest import points

from .conftest import SF

#: A multiple of what places and choices are taken modulo.
UP = 201 * 97 * 21 * 11 * 5
LARGE = {"CL1", "CL2", "CL3", "JN6", "JN9", "PLAN_SEGMENT", "SC8", "SK6", "AG1", "AG16b", "AG15", "AG2", "AG21", "AG22", "AG24", "FP10", "AG3", "AG5", "AG9", "AG7", "CL4", "FP11", "FP13", "FP19"}
#: Those that take long; AG9, CL2, SC8 and the operators below go the same ways.
SLOW = {"CL1", "CL3", "FP10", "JN6", "JN9", "PLAN_SEGMENT", "SK6"}
IDS = {"point_id", "id", "other", "a", "b"}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folders = []
    for up in (0, UP):
        folders.append(str(tmp_path_factory.mktemp(f"up{up}")))
        rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 4 = 0").withColumn("l_orderkey", F.col("l_orderkey") + up)
        rows.write.parquet(f"{folders[-1]}/lineitem.parquet")
        spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{folders[-1]}/supplier.parquet")
    return folders


def rows_of(df, up: int) -> list[tuple]:
    less = [Decimal(up) * 10**13 if c in IDS else None for c in df.columns]
    return sorted((tuple(v if n is None else Decimal(v) - n for v, n in zip(r, less, strict=True)) for r in df.collect()), key=repr)


def test_ids_are_whole(spark, both):
    narrow, wide = (points(spark, d) for d in both)
    assert narrow.schema["point_id"].dataType.simpleString() == "bigint"
    assert rows_of(wide, UP) == rows_of(narrow, 0)


@pytest.mark.parametrize("name", sorted(LARGE - SLOW) + ["MD1", "MD5"])
def test_queries_with_wide_ids(spark, both, name):
    narrow, wide = (registry.QUERIES[name](spark, d) for d in both)
    want = rows_of(narrow, 0)
    assert want and rows_of(wide, UP) == want


def test_hierarchical_clusters_with_wide_ids(spark):
    rows = [(i, 5.0 * (i % 3) + (i * 7919 % 41) / 100, (i * 104729 % 37) / 100) for i in range(240)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double")
    wide = p.withColumn("point_id", F.col("point_id") + F.lit(Decimal(10) ** 20).cast("decimal(38,0)"))
    found = [sorted((int(r[0]) % 10**20, r[1]) for r in clustering.hdbscan(q, 20).collect()) for q in (p, wide)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) > 1


def test_no_sources_with_wide_ids(spark, both):
    p = points(spark, both[1])
    assert neighbours.knn(p, p.where("false"), 5, 0.6).collect() == []
