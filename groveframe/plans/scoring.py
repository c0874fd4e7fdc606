"""The evaluation of a segmented plot against ground truth as one plan, with its result tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import percent
from ..functions.lineage import cut
from ..operators import evaluation, predictions


@dataclass
class Results:
    """Result tables: labels are those of the clouds, shares of ``detection`` and ``segmentation`` are percent with one decimal."""

    propagated: DataFrame  # point_id, x, y, z, gt, pred: the predictions at the points of the ground truth
    detection: DataFrame  # completeness, omission, commission, f1
    matches: DataFrame  # pred, gt, iou
    commissions: DataFrame  # pred, gt: predictions without a match that lie on trees, and the tree they mostly lie on
    omissions: DataFrame  # gt, pred, other: trees without a match, the prediction that took them, what else that took
    segmentation: DataFrame  # prec, rec, iou
    trees: DataFrame  # gt, pred, prec, rec, iou
    by_distance: DataFrame  # gt and a column for each metric and interval of the distance from the stem
    by_height: DataFrame  # the same by height

    def write(self, folder: str) -> None:
        """A Parquet table each below ``folder``."""
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{folder.rstrip('/')}/{f.name}")


def evaluate(predicted: DataFrame, truth: DataFrame, config: Config, reach: float = 0.1) -> Results:
    """``predicted`` (point_id, x, y, z, pred) and ``truth`` (point_id, x, y, z, gt) may be different clouds of one plot.

    Each point of the truth takes the majority of its nearest predicted points, the lowest label on ties. Labels above 0 are trees.
    """
    c = config.evaluation
    near = predictions.propagate_nearest(predicted, truth, c.neighbours, reach).withColumnsRenamed({"id": "point_id", "label": "pred"})
    points = cut(truth.join(near, "point_id").select("point_id", "x", "y", "z", "gt", "pred"))
    pairs = cut(evaluation.contingency(points))
    gts = cut(points.where("gt > 0").groupBy("gt").agg(F.count("*").alias("n_gt")))
    preds = points.where("pred > 0").select("pred").distinct()
    matched = cut(evaluation.match_trees(pairs, c.min_iou))
    commissions, omissions = evaluation.failures(matched, pairs, preds, gts.select("gt"), c.min_precision, c.min_recall)
    summary = evaluation.detection_summary(matched, pairs, preds, gts, c.min_precision)
    best = cut(evaluation.best_prediction(pairs, gts))
    trees = evaluation.tree_metrics(pairs, best, gts)
    return Results(
        points, summary.select(*(percent(F.col(x)).alias(x) for x in summary.columns)), matched, commissions, omissions,
        trees.agg(*(percent(F.avg(x)).alias(x) for x in ("prec", "rec", "iou"))), trees,
        evaluation.wide(evaluation.partition_metrics(points, best, "xy")), evaluation.wide(evaluation.partition_metrics(points, best, "z")),
    )
