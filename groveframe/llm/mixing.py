"""Mixing sources to target weights by temperature, realised as budgeted block permutations. DataFrame functions throughout.

The weight of a source is its share of tokens raised to an exponent and normalised: 1 keeps the shares, 0 makes all equal. The
exponent is found by bisection, many points of the bracket at a time, so that either the entropy of the weights meets a target
or no source is repeated more often than a limit allows. A budget of tokens times the weight of a source, divided by its tokens,
is the number of passes over it. By default the budget is the smallest that keeps every document.

The documents of a source are dealt into blocks by hash; the blocks stand in the order of another hash, and so do the documents
of a block: a permutation of the source. Whole passes take every document, the last, partial pass takes documents from the
start of the permutation until its tokens are spent. ``place`` is a document's position in its source as a fraction: ordering
copies by pass + place interleaves all sources at their weights, at any point of the mix.

Tokens are runs of other than white space. Nothing is gathered by source but sums: blocks are the unit of the only window over
documents, so one source may hold any part of the rows.

Defined cases: a null source is a source of its own; null and empty texts have no tokens, stand in the permutation and are kept
once for each whole pass; sources without tokens have weight 0 and are kept once; a single source has weight 1; equal rows are
each kept (ties in the permutation are broken by the rows' order in the window); an empty table gives an empty result; further
columns are carried along unless they are named like the added ones, which replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

POINTS, ROUNDS, SALTS, BLOCK_TOKENS, MOST_BLOCKS = 33, 7, 32, 200_000, 1 << 20
MAX_REPEATS = 1.5
ADDED = ["n_tokens", "weight", "passes", "copies", "place"]


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def curve(shares: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights, and most repeats when the least repeated source has one pass, for each exponent; one aggregation."""
    known = shares.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("g"))
    top = known.agg(F.max("g")).first()[0]
    spread = known.select((F.col("g") - top).alias("x"), F.posexplode(F.from_json(F.lit(str(points)), "array<double>")).alias("i", "a"))
    power = F.exp(F.col("a") * F.col("x"))
    ratio = (F.col("a") - 1) * F.col("x")
    sums = spread.groupBy("i").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("x")).alias("s"), (F.max(ratio) - F.min(ratio)).alias("r"))
    return [(math.log(r["z"]) - r["s"] / r["z"], math.exp(r["r"])) for r in sorted(sums.collect(), key=lambda r: r["i"])]


def find_exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] nearest 0 that keeps the repetition limit, or whose entropy meets the target (clipped to [0, 1])."""
    if shares.where("tokens > 0").limit(1).count() == 0:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        # both fall as the exponent rises: the first point at or below the aim closes the bracket
        aims = [(e <= target_entropy + 1e-12) if target_entropy is not None else (r <= max_repeats + 1e-12) for e, r in curve(shares, points)]
        k = aims.index(True) if True in aims else len(points) - 1
        low, high = points[max(0, k - 1)] if k else points[0], points[k]
        if high - low < 1e-12:
            break
    return high


def source_weights(shares: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """source, tokens, docs, weight, passes of each source."""
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    summed = shares.agg(F.sum(power).alias("z"), F.min(F.when(F.col("tokens") > 0, power / F.col("tokens"))).alias("least"))
    scale = F.lit(float(budget)) / F.col("z") if budget is not None else 1 / F.col("least")
    passes = F.when(F.col("tokens") > 0, power / F.col("tokens") * scale).otherwise(1.0)
    # rounding must not drop the last document of a source that is kept exactly once
    return shares.crossJoin(F.broadcast(summed)).select("source", "tokens", "docs", F.when(F.col("z") > 0, power / F.col("z")).otherwise(0.0).alias("weight"), (F.round(passes * 1e9) / 1e9).alias("passes"))


def block_of(seed: int, blocks) -> Column:
    """The block of a document; rows without an id are dealt by their text."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), blocks).cast("int")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 1) -> DataFrame:
    """All documents with n_tokens, weight, passes (of their source), copies (how often the mix holds them) and place."""
    counted = docs.drop(*ADDED).withColumn("n_tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long"))
    shares = materialize(source_totals(counted.select("source", "n_tokens")), "source-totals")
    exponent = find_exponent(shares, target_entropy, None if target_entropy is not None else max_repeats)
    weights = materialize(source_weights(shares, exponent, budget), "source-weights")
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.lit(1.0)))).cast("int")
    spread = weights.select(F.col("source").alias("_source"), "tokens", "weight", "passes", blocks.alias("_blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = counted.withColumn("_s", block_of(seed - 1, F.lit(SALTS)))
    joined = salted.join(spread, salted["source"].eqNullSafe(spread["_source"]) & (salted["_s"] == spread["_s"])).drop("_s", "_source")
    dealt = joined.withColumn("_block", block_of(seed, F.col("_blocks")))

    sums = dealt.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_sum"))
    ahead = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "_block"), "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).select(F.col("source").alias("_source"), F.col("_block").alias("_b"), "_before"), "block-starts")

    inside = W.partitionBy("source", "_block").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "text")).rowsBetween(W.unboundedPreceding, -1)
    ordered = dealt.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = ordered.join(starts, ordered["source"].eqNullSafe(starts["_source"]) & (ordered["_block"] == starts["_b"]))
    at = F.col("_before") + F.col("_own")
    whole = F.floor("passes")
    more = (F.col("passes") - whole) * F.col("tokens") > at
    return placed.withColumn("copies", (whole + F.when(more & (F.col("n_tokens") > 0), 1).otherwise(0)).cast("long")).withColumn("place", F.when(F.col("tokens") > 0, at / F.col("tokens")).otherwise(0.0)).drop("_source", "_b", "_before", "_own", "_block", "_blocks", "tokens")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "passes", "copies", "place")
