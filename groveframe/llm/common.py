"""Helpers that the training-data operators share: tables, the shared folder, ordered buckets."""

from __future__ import annotations

import gc
import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LONG = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine (tests) gets a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="groveframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else "file://" + found if found.startswith("/") else found


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/groveframe/{label}-{uuid.uuid4().hex}"


#: Tables that a worker keeps from task to task, by the kind of work that fills them.
_KEPT: dict[str, dict] = {}


def kept_table(kind: str, table: dict) -> dict:
    """Names a table of a module that workers keep between tasks."""
    return _KEPT.setdefault(kind, table)


def use_only(*kinds: str) -> None:
    """Begins a task that needs these kept tables: all others are emptied, since a worker goes on to stages of other operators."""
    for kind, table in _KEPT.items():
        if kind not in kinds:
            table.clear()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done: it does so once the driver has collected their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: later work survives lost executors and starts from files.

    Shuffle files of earlier steps go first, so a chain of steps needs the disk of its largest one, not of their sum.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    release(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fraction_of(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``: the deterministic fold of a row (null keys count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def quantile_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 65536) -> list[int]:
    """Sorted distinct values of ``key`` that are upper bounds of buckets of about ``rows_per_bucket`` rows; the last is the maximum.

    One aggregation over the key column alone. The number of buckets follows the rows, up to ``most`` (a bound on the driver's list).
    """
    n, top = df.agg(F.count(key), F.max(key)).first()
    if not n:
        return []
    parts = max(1, min(most, math.ceil(n / rows_per_bucket)))
    if parts == 1:
        return [top]
    cuts = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, cuts, max(10000, 4 * parts))).first()[0]
    return sorted({*found, top})


def bucket_of(key: str, bounds: list[int]) -> Column:
    """Index of the first bound that is not below the key (null keys: 0), found by bisection in a constant array."""
    levels = max(1, len(bounds).bit_length())
    padded = bounds + [MAX_LONG] * ((1 << levels) - len(bounds))
    steps = F.expr(
        f"aggregate(sequence({levels - 1}, 0, -1), 0, (low, i) -> if(element_at("
        f"from_json('{json.dumps(padded)}', 'array<bigint>'), low + shiftleft(1, i)) < `{key}`, low + shiftleft(1, i), low))"
    )
    return F.coalesce(steps, F.lit(0))


def one_task_each(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that stand for much work each (files): as many tasks as rows."""
    return rows.repartitionByRange(max(1, rows.count()), key)


#: Share of a table that is looked at to tell which keys are hot, the least rows of it and the least part of it that make a key hot
#: (so there are at most a hundred thousand hot keys), and shares that a hot key is dealt to.
HOT_SAMPLE, HOT_ROWS, HOT_PART, HOT_SHARES = 256, 8, 1e-5, 1024


def in_sample(*columns) -> Column:
    """Whether a row is in the sample that hot keys are told from; by a hash, so it is the same in every attempt."""
    return F.pmod(F.xxhash64(F.lit(77), *columns), F.lit(HOT_SAMPLE)) == 0


def hot_keys(sample: DataFrame, key: str = "key") -> DataFrame:
    """Keys of so many rows in the sample that one task should not take them whole. Only how rows are dealt depends on it."""
    counts = materialize(sample.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    least = max(HOT_ROWS, HOT_PART * (counts.agg(F.sum("n")).first()[0] or 0))
    return counts.where(F.col("n") >= least).select(key)


def with_shares(rows: DataFrame, hot: DataFrame, by: str, key: str = "key") -> DataFrame:
    """Adds ``share``: 0 for ordinary keys, one of HOT_SHARES from 1 on by a hash of ``by`` for hot ones, of which there are few."""
    dealt = F.pmod(F.xxhash64(by), F.lit(HOT_SHARES)).cast("int") + 1
    return rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left").withColumn("share", F.when(F.col("_hot"), dealt).otherwise(0)).drop("_hot")
