"""Hard-negative mining by a pivot table.

Inner products become distances: with M the largest norm, a row x is augmented by sqrt(M^2 - |x|^2) and an anchor q by 0, so that
d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The distances of all rows to a few pivots (rows themselves, far from each other) are stored beside
the rows. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), so two stored numbers a pivot bracket a score:
blocks of rows and single rows that cannot reach what an anchor has already found, or lie above all that it looks for, are ruled
out; the survivors are checked exactly in integers.

Anchors are the stated query set. They are taken in blocks of ANCHORS, one scan of the table for the positives of a block and one
for its negatives; a task keeps the few best an anchor and Spark merges these by anchor. What is broadcast is one block of anchors,
the pivots and a bounded sample of rows, which gives each anchor a first threshold: it only saves work.

Defined cases: rows with a null label, vector or component, or a component that is not finite, take no part; a null id takes part
as no anchor and comes last on ties; equal rows (id, label, vector) are one row with a number of copies, an anchor's copies are
further anchors, and its other copies are rows like any other; a shorter vector goes on in zeros; an empty table gives an empty
result; further columns are ignored. Scores are exact: a component beyond 2^31, or a score that may exceed 2^63, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_LONG, materialize, table

PIVOTS, SAMPLE = 8, 2048
#: Anchors of a block, rows that a task scores at a time.
ANCHORS, BATCH = 8192, 512
#: From this share of survivors on, the whole block is scored by one matrix product.
DENSE = 0.05
LARGEST, EXACT_DOUBLE, EXACT_LONG = 2.0**31, 2.0**53, 2.0**63


@dataclass(frozen=True)
class Rules:
    """Positives an anchor, negatives a positive, and the percentages of the positive's score between which a negative lies."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of components as rows of doubles, continued with zeros."""
    out = np.zeros((len(vectors), width))
    if vectors.null_count or isinstance(vectors, pa.ChunkedArray):
        raise ValueError("vectors are lists without nulls")
    sizes = np.diff(vectors.offsets.to_numpy())
    at = np.arange(width) < sizes[:, None]
    out[at] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of integer rows, exact: no partial sum exceeds ``bound``, the product of the largest norms."""
    if bound < EXACT_DOUBLE:
        return (a @ b.T).astype(np.int64)
    if bound < EXACT_LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("scores may exceed 64 bits")


def pair_products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the i-th rows of both."""
    if bound < EXACT_DOUBLE:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if bound < EXACT_LONG:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    raise ValueError("scores may exceed 64 bits")


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    if not len(rows):
        return rows
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def augmented(rows: np.ndarray, largest: float) -> np.ndarray:
    """Rows with the component that gives all of them the same norm."""
    return np.column_stack([rows, np.sqrt(np.maximum(largest - (rows**2).sum(1), 0.0))])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots)."""
    return np.sqrt(np.maximum((rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T, 0.0))


@dataclass
class Space:
    """What tasks know of the table: width and largest squared norm of its vectors, the pivots (augmented), the sample of rows; and how they work."""

    width: int
    largest: float
    pivots: np.ndarray
    sample: np.ndarray
    sample_labels: np.ndarray
    batch: int
    dense: float


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Space]:
    """The distinct rows (vec_id, label, v, copies) with the distances ``d`` to the pivots, near rows together, and the space."""
    rows = materialize(rows.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")), "negatives-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    width, largest, reach = rows.agg(F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (reach or 0.0) > LARGEST:
        raise ValueError("components beyond 2^31")
    drawn = rows.select("label", "v", F.xxhash64(F.lit(5), "v", "label", "vec_id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    sample = np.zeros((len(drawn), width or 0))
    for at, r in enumerate(drawn):
        sample[at, : len(r["v"])] = r["v"]
    space = Space(width or 0, largest or 0.0, np.zeros((0, 0)), sample, np.array([r["label"] for r in drawn], np.int64), BATCH, DENSE)
    space.pivots = far_apart(augmented(sample, space.largest), PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(augmented(matrix(batch.column("v"), space.width), space.largest), space.pivots)
            nearest = d.argmin(1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], [*batch.schema.names, "d", "cell", "near"])

    if drawn:
        rows = rows.mapInArrow(run, "vec_id long, label long, v array<double>, copies long, d array<double>, cell int, near double")
    else:
        rows = rows.select("*", F.array().cast("array<double>").alias("d"), F.lit(0).alias("cell"), F.lit(0.0).alias("near"))
    # rows near each other share blocks, whose bounds are then narrow; ids part what is equal
    placed = rows.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id")
    return materialize(placed, "negatives-pivots"), space


class Best:
    """The best few (score, id) of each of n places, kept as rows ordered by place, score descending, id ascending."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.rows = np.zeros((4, 0), np.int64)  # place, score, whether the id is null, id
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, place: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        again = np.minimum(copies, self.most)
        new = np.repeat(np.stack([place, score, null, ids]), again, axis=1)
        every = np.concatenate([self.rows, new], axis=1)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        starts = np.searchsorted(every[0], np.arange(self.n))
        rank = np.arange(every.shape[1]) - starts[every[0]]
        self.rows = every[:, rank < self.most]
        full = every[:, rank == self.most - 1]
        self.least[full[0]] = full[1]


def upper(block: dict, near: np.ndarray, far: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the scores of anchors with rows, from distances to pivots: (highest, lowest), a little wider than computed.

    ``near`` and ``far`` (pivots, rows) are equal for single rows, or the smallest and largest distances of a block of rows.
    """
    d = block["d"]
    low = np.zeros((len(d), near.shape[1]))
    high = np.full(low.shape, np.inf)
    for p in range(d.shape[1]):
        own = d[:, p, None]
        np.maximum(low, np.maximum(near[p] - own, own - far[p]), out=low)
        np.minimum(high, own + far[p], out=high)
    total = block["norm"][:, None] + largest
    slack = 1e-6 * total + 1.0
    return (total - low * low) / 2 + slack, (total - high * high) / 2 - slack


def scored(block: dict, space: Space, wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pairs (anchor, row) that ``wanted`` lets through: places of the anchors, exact scores, and the batch's part with the rows' places.

    ``wanted(highest, lowest, anchors, same)`` takes the bounds on the scores of some anchors and which of the pairs share a label
    (None for blocks), and returns a mask of the pairs that may matter.
    """
    bound = float(np.sqrt(block["norm"].max(initial=0.0) * space.largest)) + 1.0
    every = np.arange(len(block["label"]))
    for batch in batches:
        for at in range(0, batch.num_rows, space.batch):
            part = batch.slice(at, space.batch)
            rows = matrix(part.column("v"), space.width)
            d = matrix(part.column("d"), len(space.pivots)).T
            # first the block as a whole, then each of its rows
            high, low = upper(block, d.min(1, keepdims=True), d.max(1, keepdims=True), space.largest)
            some = every[wanted(high, low, every, None)[:, 0]]
            if not len(some):
                continue
            few = {"d": block["d"][some], "norm": block["norm"][some]}
            high, low = upper(few, d, d, space.largest)
            same = block["label"][some, None] == part.column("label").to_numpy()
            mask = wanted(high, low, some, same)
            a, r = np.nonzero(mask)
            if not len(a):
                continue
            if len(a) > space.dense * mask.size:
                scores = products(block["v"][some], rows, bound)[a, r]
            else:
                scores = pair_products(block["v"][some[a]], rows[r], bound)
            yield some[a], scores, part, r


def columns_of(part: pa.RecordBatch, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = part.column("vec_id")
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return null[r], ids.fill_null(MAX_LONG).to_numpy()[r], part.column("copies").to_numpy()[r]


def best_rows(best: Best, **more: np.ndarray) -> pa.RecordBatch:
    place, score, null, ids = best.rows
    out = {"place": pa.array(place), **{k: pa.array(v[place]) for k, v in more.items()}, "score": pa.array(score), "id": pa.array(ids, mask=null.astype(bool))}
    return pa.RecordBatch.from_pydict(out)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives_of(rows: DataFrame, block: dict, space: Space, rules: Rules) -> list:
    """(place, id, score, rank) of the best rows with the anchor's label, itself among them: at most ANCHORS times a few rows."""
    most = rules.positives + 1
    own = products(block["v"], space.sample, float(np.sqrt(block["norm"].max(initial=0.0) * space.largest)) + 1.0)
    own = np.where(block["label"][:, None] == space.sample_labels, own, np.iinfo(np.int64).min)
    first = np.sort(own, axis=1)[:, -most] if own.shape[1] >= most else np.full(len(own), np.iinfo(np.int64).min)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block["label"]), most)
        best.least = np.maximum(best.least, first)

        def wanted(high, low, anchors, same):
            mask = high >= best.least[anchors, None]
            return mask if same is None else mask & same

        for place, score, part, r in scored(block, space, wanted, batches):
            keep = score >= best.least[place]
            if keep.any():
                best.add(place[keep], score[keep], *(c[keep] for c in columns_of(part, r)))
                best.least = np.maximum(best.least, first)
        yield best_rows(best)

    return ranked(rows.mapInArrow(run, "place long, score long, id long"), most).collect()


def own_positives(found: list, block: dict, rules: Rules) -> list[list[tuple[int, int | None]]]:
    """The (score, id) of each anchor's positives, in order: without itself, if it is among the best."""
    out: list[list] = [[] for _ in block["label"]]
    for r in sorted(found, key=lambda r: (r["place"], r["rank"])):
        out[r["place"]].append((r["score"], r["id"]))
    for place, rows in enumerate(out):
        # a row of the same id, label and score is no other result
        itself = (int(block["norm"][place]), block["id"][place])
        if itself in rows:
            rows.remove(itself)
        del rows[rules.positives :]
    return out


def negatives_of(rows: DataFrame, block: dict, space: Space, targets: np.ndarray, owners: np.ndarray, rules: Rules) -> DataFrame:
    """(place, rank, id, score): the best rows of other labels for each target, the score of a positive of anchor ``owners``.

    Targets are distinct in (owner, score), ordered by owner and ascending score.
    """
    floor, ceiling = targets * rules.low, targets * rules.high  # of a hundred times the score
    starts = np.searchsorted(owners, np.arange(len(block["label"])))
    ends = np.searchsorted(owners, np.arange(len(block["label"])), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(targets), rules.negatives)
        none = np.iinfo(np.int64).max
        top = np.array([ceiling[s:e].max(initial=-none) for s, e in zip(starts, ends, strict=True)])

        def open_from() -> np.ndarray:
            """The lowest score, a hundred times, that any target of an anchor still takes."""
            least = np.where(best.least > np.iinfo(np.int64).min, np.maximum(floor, 100 * np.maximum(best.least, -(2**56))), floor)
            out = np.full(len(starts), none)
            np.minimum.at(out, owners, least)
            return out

        bottom = open_from()

        def wanted(high, low, anchors, same):
            mask = (100 * high >= bottom[anchors, None]) & (100 * low <= top[anchors, None])
            return mask if same is None else mask & ~same

        for anchor, score, part, r in scored(block, space, wanted, batches):
            null, ids, copies = columns_of(part, r)
            hundred, found = 100 * score, []
            for k in range(int((ends - starts).max(initial=0))):
                at = np.flatnonzero(starts[anchor] + k < ends[anchor])
                place = starts[anchor[at]] + k
                fits = (hundred[at] >= floor[place]) & (hundred[at] <= ceiling[place]) & (score[at] >= best.least[place])
                found.append((place[fits], at[fits]))
            place, at = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(at):
                best.add(place, score[at], null[at], ids[at], copies[at])
                bottom = open_from()
        yield best_rows(best)

    return ranked(rows.mapInArrow(run, "place long, score long, id long"), rules.negatives)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: Column, rules: Rules = Rules()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, label, v) that ``anchors`` marks."""
    spark = rows.sparkSession
    stored, space = pivot_table(rows.select("vec_id", F.col("label").cast("long").alias("label"), "v"))
    asked = stored.where(anchors).select("vec_id", "label", "v", "d", "copies")
    count = asked.count()
    dealt = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, -(-2 * count // ANCHORS))))
    asked = materialize(asked.withColumn("block", dealt), "negatives-anchors") if count else asked
    out = None
    for k in range(-(-2 * count // ANCHORS) if count else 0):
        drawn = asked.where(F.col("block") == k).orderBy("vec_id", "label", "v").toArrow().combine_chunks()
        for at in range(0, drawn.num_rows, ANCHORS):
            found = mined(spark, stored, space, drawn.slice(at, ANCHORS), rules)
            if found is not None:
                out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def mined(spark: SparkSession, stored: DataFrame, space: Space, drawn: pa.Table, rules: Rules) -> DataFrame | None:
    """The result of one block of anchors."""
    drawn = drawn.combine_chunks()
    one = {c: drawn.column(c).chunk(0) if drawn.column(c).num_chunks else drawn.column(c) for c in drawn.column_names}
    v = matrix(one["v"], space.width)
    norm = (v**2).sum(1)
    # an anchor is augmented by 0; its distances to the pivots follow from that
    block = {"v": v, "norm": norm, "label": one["label"].to_numpy(), "id": one["vec_id"].to_pylist(), "d": distances(np.column_stack([v, np.zeros(len(v))]), space.pivots)}
    copies = one["copies"].to_pylist()
    positives = own_positives(positives_of(stored, block, space, rules), block, rules)
    pairs = sorted({(place, score) for place, rows in enumerate(positives) for score, _ in rows})
    if not pairs:
        return None
    place_of = {pair: at for at, pair in enumerate(pairs)}
    owners, targets = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    if len(targets) and np.abs(targets).max() >= 2**56:
        raise ValueError("a hundred times a score may exceed 64 bits")
    wide = [(place_of[a, score], block["id"][a], pid, score, copies[a]) for a, rows in enumerate(positives) for score, pid in rows]
    named = spark.createDataFrame(wide, "place long, anchor_id long, positive_id long, positive_score long, copies long")
    found = negatives_of(stored, block, space, targets, owners, rules)
    joined = materialize(found.join(F.broadcast(named), "place"), "negatives-found")
    again = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return again.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def usable(df: DataFrame, vector: str, label: str) -> DataFrame:
    """The rows that take part: label, vector and all its components are there and finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows; labels of ids divisible by 7 go up by one."""
    rows = usable(table(spark, sf_dir, "embeddings"), "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    # halves the way to integers: doubles, so that a component of any size stays what it is
    whole = F.transform("embedding", lambda x: scaled(x.cast("double") * 256.0))
    return mine(rows.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


def scaled(x: Column) -> Column:
    """The largest whole number that is not above x, as a double (what exceeds 64 bits is whole already)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


OP11_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid),
p AS (SELECT * FROM (SELECT rid, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.score DESC, s.other) AS place
      FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
