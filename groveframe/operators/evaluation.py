"""Scores of a labelling against ground truth: contingency, matching, detection errors, metrics by distance and height."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import cut
from .clustering import components
from .voxels import evaluation_positions, kth_height


def contingency(points: DataFrame) -> DataFrame:
    """(pred, gt, tp, n_pred, n_gt, iou, prec, rec) of all overlapping pairs of trees.

    One shuffle over the points; the margins count all points, also those whose other label is no tree.
    """
    pairs = points.groupBy("pred", "gt").agg(F.count("*").alias("tp"))
    preds = pairs.groupBy("pred").agg(F.sum("tp").alias("n_pred"))
    gts = pairs.groupBy("gt").agg(F.sum("tp").alias("n_gt"))
    both = pairs.where("pred > 0 and gt > 0").join(preds, "pred").join(gts, "gt")
    return both.select("pred", "gt", "tp", "n_pred", "n_gt", ratio(F.col("tp"), F.col("n_pred") + F.col("n_gt") - F.col("tp")).alias("iou"), ratio(F.col("tp"), F.col("n_pred")).alias("prec"), ratio(F.col("tp"), F.col("n_gt")).alias("rec"))


def best_prediction(pairs: DataFrame, gts: DataFrame) -> DataFrame:
    """(gt, pred, iou): for each gt the prediction of the highest IoU, the lowest label on ties; 0 without any overlap."""
    best = pairs.groupBy("gt").agg(F.max_by("pred", F.struct("iou", -F.col("pred"))).alias("pred"), F.max("iou").alias("iou"))
    return gts.select("gt").join(best, "gt", "left").select("gt", F.coalesce("pred", F.lit(0).cast("bigint")).alias("pred"), F.coalesce("iou", F.lit(0.0)).alias("iou"))


def assign(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Edges (row, column, weight > 0) of an assignment of the largest total weight, by augmenting paths over the list of edges.

    Each round looks for the path that adds most, with column prices that keep the reduced costs from falling below zero; memory
    is that of the edges, never of rows times columns.
    """
    out_of: dict[int, list[tuple[int, float]]] = {}
    for r, c, w in edges:
        out_of.setdefault(r, []).append((c, w))
    row_price = {r: max(w for _, w in cs) for r, cs in out_of.items()}
    col_price: dict[int, float] = dict.fromkeys((c for _, c, _ in edges), 0.0)
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    for start in sorted(out_of):
        # shortest paths over reduced costs row_price + col_price - w >= 0; a path may also end by leaving a row unmatched
        far, came, done, heap = {}, {}, set(), []
        rows_at = {start: 0.0}
        best_row, best_end = start, row_price[start]
        best_col = None

        def relax(row: int, low: float, far=far, came=came, done=done, heap=heap) -> None:
            for c, w in out_of[row]:
                d = low + max(0.0, row_price[row] + col_price[c] - w)
                if c not in done and d < far.get(c, np.inf):
                    far[c], came[c] = d, row
                    heappush(heap, (d, c))

        relax(start, 0.0)
        while heap:
            d, c = heappop(heap)
            if c in done or d > far[c]:
                continue
            if d >= best_end:
                break
            done.add(c)
            if c not in row_of:
                best_end, best_col = d, c
                break
            row = row_of[c]
            rows_at[row] = d
            if d + row_price[row] < best_end:
                best_end, best_row, best_col = d + row_price[row], row, None
            relax(row, d)
        for row, d in rows_at.items():
            if d < best_end:
                row_price[row] -= best_end - d
        for c in done:
            if far[c] < best_end:
                col_price[c] += best_end - far[c]
        if best_col is None:  # best_row goes without a column
            c = col_of.pop(best_row, None)
            if c is None:
                continue
            del row_of[c]
        else:
            c = best_col
        while True:
            row = came[c]
            previous = col_of.get(row)
            col_of[row], row_of[c] = c, row
            if row == start:
                break
            c = previous
    weight = {(r, c): w for r, c, w in edges}
    return [(r, c, weight[r, c]) for r, c in sorted(col_of.items())]


#: Overlaps left after the first round up to which components are solved as they are, and the part a further round must take off.
MOST_OVERLAPS, LEAST_PROGRESS = 200_000, 0.01


def settled_pairs(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of edges (a, b, w) that belong to an assignment of the largest total: heaviest of both ends, and no lighter than
    the best other edge of one end and of the other together."""
    by = {k: W.partitionBy(k).orderBy(F.desc("w"), o) for k, o in (("a", "b"), ("b", "a"))}
    ranked = edges.withColumns({f"{k}_{n}": v for k, o in by.items() for n, v in (("place", F.row_number().over(o)), ("next", F.coalesce(F.lead("w").over(o), F.lit(0.0))))})
    return ranked.where("a_place = 1 and b_place = 1 and w >= a_next + b_next").select("a", "b")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes; the two ends of an edge never share a number."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_anti").join(nodes.select(F.col("node").alias("b")), "b", "left_anti")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def fold_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes off all nodes of one edge: (hub, leaf), the heaviest leaf of each hub, and the edges that are left.

    A hub takes that leaf unless another edge is worth more, so its other edges count only for what they add to the leaf's weight;
    those that add nothing go. An assignment of the largest total of what is left, with the leaf for each hub that it leaves
    without a partner, is one of the whole.
    """
    halves = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "w"))).alias("h")).select("h.*")
    leaves = halves.groupBy("node").agg(F.count("*").alias("n"), F.first("other").alias("hub"), F.first("w").alias("w")).where("n = 1").drop("n")
    hubs = cut(leaves.groupBy("hub").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("leaf"), F.max("w").alias("less")))
    inner = without(edges, leaves.select("node"))
    for end in ("a", "b"):
        inner = inner.join(hubs.select(F.col("hub").alias(end), F.col("less").alias(f"less_{end}")), end, "left")
    rest = inner.select("a", "b", (F.col("w") - F.coalesce("less_a", F.lit(0.0)) - F.coalesce("less_b", F.lit(0.0))).alias("w")).where("w > 0")
    return hubs.select("hub", "leaf"), rest


def best_assignment(edges: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of an assignment of the largest total weight of edges (a, b, w > 0), where all a > 0 > b.

    While more than ``most`` edges are left, rounds over all of them settle sure pairs and fold leaves, both without a loss, as
    long as a round takes off a hundredth: chains and trees of overlaps vanish, cycles stay. What is left is solved as a list of
    edges per component. The folds are then undone in reverse: each hub without a partner takes its leaf.
    """
    rounds, left = [], edges.count()
    while left > most:
        sure = cut(settled_pairs(edges))
        folds, rest = fold_leaves(without(edges, ends_of(sure)))
        edges, before = cut(rest), left
        rounds.append((sure, folds))
        left = edges.count()
        if before - left < LEAST_PROGRESS * before:
            break

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x[:2] for x in assign(list(zip(part["a"].tolist(), part["b"].tolist(), part["w"].tolist(), strict=True)))], columns=["a", "b"])

    pairs = edges.select("a", "b").limit(0)
    if left:
        roots = components(edges.select("a", "b")).withColumnRenamed("node", "a")
        pairs = cut(edges.join(roots, "a").groupBy("root").applyInPandas(solve, "a bigint, b bigint"))
    for sure, folds in reversed(rounds):
        pairs = pairs.unionByName(sure)
        free = folds.join(ends_of(pairs).withColumnRenamed("node", "hub"), "hub", "left_anti")
        pairs = cut(pairs.unionByName(free.select(F.greatest("hub", "leaf").alias("a"), F.least("hub", "leaf").alias("b"))))
    return pairs


def match_trees(pairs: DataFrame, min_iou: float = 0.5, most: int = MOST_OVERLAPS) -> DataFrame:
    """(pred, gt, iou) of the assignment with the largest total IoU, above the threshold.

    Pairs that outweigh all that competes are settled in windows first, and what they rule out goes with them; the rest goes to
    ``best_assignment``.
    """
    edges = cut(pairs.where("iou > 0").select(F.col("pred").cast("bigint").alias("a"), (-F.col("gt").cast("bigint")).alias("b"), F.col("iou").alias("w")))
    sure = cut(settled_pairs(edges))
    rest = cut(without(edges, ends_of(sure)))
    found = sure if rest.isEmpty() else sure.unionByName(best_assignment(rest, most))
    return edges.where(F.col("w") > min_iou).join(found, ["a", "b"], "left_semi").select(F.col("a").alias("pred"), (-F.col("b")).alias("gt"), F.col("w").alias("iou"))


def detection_summary(matched: DataFrame, pairs: DataFrame, preds: DataFrame, gts: DataFrame, min_precision: float = 0.5) -> DataFrame:
    """completeness, omission, commission and F1 in one row; unmatched predictions count if enough of them lies on trees."""
    on_trees = pairs.groupBy("pred").agg(F.sum("prec").alias("share"))
    false = preds.join(matched, "pred", "left_anti").join(on_trees, "pred").where(F.col("share") >= min_precision)
    one = matched.agg(F.count("*").alias("m")).crossJoin(gts.agg(F.count("*").alias("g"))).crossJoin(false.agg(F.count("*").alias("f")))
    c, o = ratio(F.col("f"), F.col("m") + F.col("f")), ratio(F.col("g") - F.col("m"), F.col("g"))
    return one.select(ratio(F.col("m"), F.col("g")).alias("completeness"), o.alias("omission"), c.alias("commission"), ratio(2 * (1 - c) * (1 - o), 2 - (c + o)).alias("f1"))


def failures(matched: DataFrame, pairs: DataFrame, preds: DataFrame, gts: DataFrame, min_precision: float = 0.5, min_recall: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Unmatched predictions with the gt they mostly lie on, and unmatched gts with the prediction that took them and the gt it took most of."""
    lost = preds.join(matched, "pred", "left_anti")
    top = pairs.groupBy("pred").agg(F.max_by("gt", F.struct("prec", -F.col("gt"))).alias("gt"), F.max("prec").alias("prec"), F.sum("prec").alias("share"))
    commissions = lost.join(top, "pred").where(F.col("share") >= min_precision).select("pred", F.when(F.col("prec") >= min_precision, F.col("gt")).alias("gt"))
    missed = gts.join(matched, "gt", "left_anti")
    taker = pairs.groupBy("gt").agg(F.max_by("pred", F.struct("rec", -F.col("pred"))).alias("pred"), F.max("rec").alias("rec")).where(F.col("rec") >= min_recall)
    other = pairs.select("pred", F.col("gt").alias("other"), F.col("rec").alias("other_rec"))
    rival = missed.join(taker, "gt").join(other, "pred").where("other != gt").groupBy("gt").agg(F.max_by("other", F.struct("other_rec", -F.col("other"))).alias("other"), F.max("other_rec").alias("other_rec")).where(F.col("other_rec") >= min_recall)
    omissions = missed.join(taker.select("gt", "pred"), "gt", "left").join(rival.select("gt", "other"), "gt", "left")
    return commissions, omissions


def tree_metrics(pairs: DataFrame, best: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gt, pred, prec, rec, iou) of each gt with its best prediction."""
    joined = best.select("gt", "pred").join(pairs.select("gt", "pred", "tp", "n_pred"), ["gt", "pred"], "left").join(sizes, "gt")
    tp, n_pred = F.coalesce("tp", F.lit(0)), F.coalesce("n_pred", F.lit(0))
    return joined.select("gt", "pred", ratio(tp, n_pred).alias("prec"), ratio(tp, F.col("n_gt")).alias("rec"), ratio(tp, n_pred + F.col("n_gt") - tp).alias("iou"))


def partition_metrics(points: DataFrame, best: DataFrame, axis: str, bins: int = 10) -> DataFrame:
    """(gt, bin, prec, rec, iou) by distance from the tree position (axis xy) or by height (axis z), relative to the fifth largest.

    Points of the tree and points of its prediction count. Many trees may have chosen one prediction, so its points are not
    joined with all of them: heights are counted before they meet the trees, and by distance a point meets only the trees whose
    circle its cell touches.
    """
    trees = points.where("gt > 0")
    names = best.select("gt", F.col("pred").alias("p"))
    if axis == "xy":
        at = evaluation_positions(trees)
        far = kth_height(trees.join(at, "gt").select("gt", "point_id", distance().alias("z")), 5, largest=True)
        circles = cut(names.join(at, "gt").join(far.select("gt", F.col("kth").alias("far")), "gt").where("far > 0"))
        own = points.join(circles, "gt").select("gt", "far", distance().alias("at"), F.when(F.col("pred") == F.col("p"), 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("pred") != F.col("p"), 1).otherwise(0).alias("fn"))
        seen = own.unionByName(foreign_in_circles(points, circles.where("p > 0")))
    else:
        low = trees.groupBy("gt").agg(F.min("z").alias("zmin"))
        scale = names.join(low, "gt").join(kth_height(trees, 5, largest=True).select("gt", F.col("kth").alias("top")), "gt")
        scale = scale.select("gt", "p", "zmin", (F.col("top") - F.col("zmin")).alias("far")).where("far > 0")
        heights = points.where("gt is not null").groupBy("pred", "gt", "z").agg(F.count("*").alias("n"))
        # what a prediction holds at a height, less what of it is the tree's own, is foreign
        whole = heights.groupBy("pred", "z").agg(F.sum("n").alias("n")).join(scale.where("p > 0"), F.col("pred") == F.col("p"))
        own, none = heights.join(scale, "gt"), F.lit(0).cast("bigint")
        same = F.when(F.col("pred") == F.col("p"), F.col("n")).otherwise(none)
        rows = own.select("gt", "far", "zmin", "z", same.alias("tp"), F.when(F.col("p") > 0, -same).otherwise(none).alias("fp"), F.when(F.col("pred") != F.col("p"), F.col("n")).otherwise(none).alias("fn"))
        rows = rows.unionByName(whole.select("gt", "far", "zmin", "z", none.alias("tp"), F.col("n").alias("fp"), none.alias("fn")))
        seen = rows.withColumn("at", F.col("z") - F.col("zmin"))
    placed = seen.withColumn("share", F.col("at") / F.col("far")).where("share >= 0 and share < 1")
    counts = placed.groupBy("gt", F.floor(F.col("share") * bins).cast("bigint").alias("bin")).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("gt", "bin", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("rec"), ratio(tp, tp + fp + fn).alias("iou"))


def foreign_in_circles(points: DataFrame, circles: DataFrame) -> DataFrame:
    """(gt, far, at, tp, fp, fn) of the points of other trees that lie in the circle of a tree and in the prediction it chose.

    A circle lies in at most four cells twice to eight times its radius wide; a point goes to one cell of each width that occurs
    (powers of four, so there are few) and meets the circles of its prediction there: not all trees that chose it, but those near it.
    """
    width = (2 * F.greatest(F.lit(-1), F.least(F.lit(510), F.ceil((F.log2("far") + 1) / 2)))).cast("int")
    wide = circles.withColumn("w", width)
    widths = [r["w"] for r in wide.select("w").distinct().collect()]  # one for each power of four at most
    size = F.pow(F.lit(2.0), F.col("w"))
    touched = wide
    for c in "xy":
        reach = F.col("far") * (1 + 1e-9) + F.abs(f"p{c}") * 1e-12
        touched = touched.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"p{c}") - reach) / size), F.floor((F.col(f"p{c}") + reach) / size))))
    placed = points.where("gt is not null and pred > 0").select("x", "y", F.col("gt").alias("g"), F.col("pred").alias("p"), F.explode(F.lit(widths).cast("array<int>")).alias("w"))
    placed = placed.withColumns({f"c{c}": F.floor(F.col(c) / size) for c in "xy"})
    met = placed.join(touched, ["p", "w", "cx", "cy"]).where("g != gt").select("gt", "far", distance().alias("at"))
    return met.where("at < far").select("*", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))


def distance():
    return F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))


def wide(metrics: DataFrame, bins: int = 10) -> DataFrame:
    """One row a tree with a column for each metric and interval."""
    wide = metrics.groupBy("gt").pivot("bin", list(range(bins))).agg(F.first("prec").alias("prec"), F.first("rec").alias("rec"), F.first("iou").alias("iou"))
    names = {f"{b}_{m}": f"{m}_intvl{b / bins:g}_{(b + 1) / bins:g}" for b in range(bins) for m in ("prec", "rec", "iou")}
    return wide.withColumnsRenamed(names)
