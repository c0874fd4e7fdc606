"""The derived forest: labelled points from lineitem, trees from supplier, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINTS = """
SELECT point_id, tree_key, tree_key % 3 AS plot, {r}(x * 100e0{z}) / 100e0 AS x, {r}(y * 100e0{z}) / 100e0 AS y, {r}(z * 100e0{z}) / 100e0 AS z, x0, y0,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN CAST(-1 AS BIGINT) WHEN l_tax < 1e-2 THEN CAST(0 AS BIGINT) ELSE tree_key + 1 END AS gt,
       CASE WHEN l_discount >= 9e-2 THEN (tree_key + 1) % (SELECT count(*) FROM supplier) + 1 WHEN l_tax < 1e-2 THEN CAST(0 AS BIGINT) ELSE tree_key + 1 END AS pred
FROM (SELECT *, l_suppkey AS tree_key,
             l_orderkey * 10000000000000 + l_partkey * 100000000 + l_suppkey * 100000 + l_linenumber * 10000 + CAST(l_quantity AS BIGINT) * 100 + CAST(round(l_discount * 100e0) AS BIGINT) AS point_id,
             5e0 * (l_suppkey % 32) - 80e0 AS x0, 5e0 * floor(l_suppkey / 32e0) - 80e0 AS y0,
             5e0 * (l_suppkey % 32) - 80e0 + ((l_partkey * 7919) % 201 - 100) / 100e0 * (2e-1 + l_tax * l_quantity * 5e-1) AS x,
             5e0 * floor(l_suppkey / 32e0) - 80e0 + ((l_orderkey * 104729) % 201 - 100) / 100e0 * (2e-1 + l_tax * l_quantity * 5e-1) AS y,
             l_quantity * 5e-1 + l_discount AS z
      FROM lineitem) q
"""

SPARK_POINTS = _POINTS.format(r="rint", z="").replace("FROM lineitem", "FROM {lineitem}").replace("FROM supplier", "FROM {supplier}")
DUCK_POINTS = _POINTS.format(r="round_even", z=", 0")
#: The same ids where 64 bits don't hold them, as orders above 922,336 make them.
WIDE_POINTS = SPARK_POINTS.replace("l_orderkey * 10000000000000", "CAST(l_orderkey AS DECIMAL(38, 0)) * 10000000000000").replace("l_partkey * 100000000 ", "CAST(l_partkey AS DECIMAL(38, 0)) * 100000000 ")
_TOO_WIDE = """l_orderkey + l_partkey + l_suppkey + l_linenumber + l_quantity + l_discount IS NOT NULL AND try_add(try_add(try_multiply(l_orderkey, 10000000000000),
  try_multiply(l_partkey, 100000000)), l_suppkey * 100000 + l_linenumber * 10000 + CAST(l_quantity AS BIGINT) * 100 + CAST(round(l_discount * 100e0) AS BIGINT)) IS NULL"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, tree_key, plot, x, y, z, x0, y0, gt, pred.

    Ids are whole numbers: longs, or decimals if there is a row whose id no long holds.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")}
    fits = tables["lineitem"].where(_TOO_WIDE).isEmpty()
    return spark.sql(SPARK_POINTS if fits else WIDE_POINTS, **tables)


def oracle(body: str, **parts: str) -> str:
    """DuckDB SQL over ``points``; further named parts become CTEs."""
    return "WITH points AS (" + DUCK_POINTS + ")" + "".join(f", {k} AS ({v})" for k, v in parts.items()) + " " + body


def r(expr: str, digits: int = 4) -> str:
    """Rounding in DuckDB, as the queries round."""
    return f"round_even((({expr}) + {3.1e-3 * 10.0**-digits!r}) * 1e{digits}, 0) / 1e{digits}"
