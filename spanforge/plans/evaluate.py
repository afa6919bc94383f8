"""Evaluation job: ensemble and members judged in one keyed pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ensemble import member_predictions, rank_folds, rank_sets, vote, votes_needed
from spanforge.operators.metrics import (
    curve_summary,
    downsample_curve,
    evaluate,
    pr_points,
    roc_points,
    score_bounds,
    threshold_grid,
)
from spanforge.session import cut_lineage

ENSEMBLE = "ensemble"


@dataclass(frozen=True)
class Evaluation:
    """Outputs of an evaluation; every table is lazy and keyed by ``member``."""

    results: DataFrame
    grid: DataFrame
    counters: DataFrame
    curves: DataFrame
    best_fold: DataFrame | None


def scored_rows(
    scores: DataFrame, thresholds: dict[str, float], *, aggregation: str = "majority",
    ensemble_threshold: float | None = None, members: bool = True,
) -> DataFrame:
    """``(member, y, p, pred)`` rows: the ensemble under its own key, then each member."""
    voted = vote(scores, thresholds, aggregation=aggregation, ensemble_threshold=ensemble_threshold, keep=("y",))
    ensemble = voted.select(F.lit(ENSEMBLE).alias("member"), "y", "p", "pred")
    if not members:
        return ensemble
    own = member_predictions(scores, thresholds).select(F.col("member").cast("string").alias("member"), "y", "p", "pred")
    return ensemble.unionByName(own)


def protein_counters(support: DataFrame) -> DataFrame:
    """Processed, with-valid and zero-valid sequences."""
    return support.agg(
        F.count(F.lit(1)).alias("processed_proteins"),
        F.count_if(F.col("valid_residues") > 0).alias("proteins_with_valid_residues"),
        F.count_if(F.col("valid_residues") == 0).alias("proteins_zero_valid_residues"),
    )


def evaluate_ensemble(
    scores: DataFrame,
    support: DataFrame,
    thresholds: dict[str, float],
    *,
    aggregation: str = "majority",
    ensemble_threshold: float | None = None,
    best_fold_by: str = "pr_auc",
    best_fold_direction: str = "auto",
    max_points: int = 2048,
) -> Evaluation:
    """Judge an ensemble and its members on ``(id, pos, member, y, p)`` valid positions.

    ``support`` has one row per processed sequence with its ``valid_residues``.
    """
    rows = scored_rows(scores, thresholds, aggregation=aggregation, ensemble_threshold=ensemble_threshold)
    rows = cut_lineage(rows)  # results, grid and both curves read it
    bounds = score_bounds(rows)
    n = len(thresholds)
    results = evaluate(rows, ["member"], bounds=bounds).withColumn(
        "votes_needed",
        F.when((F.col("member") == ENSEMBLE) & F.lit(n > 1 and aggregation == "majority"), votes_needed(n)),
    )
    folds = results.filter(F.col("member") != ENSEMBLE).withColumn("fold_index", F.col("member"))
    roc = downsample_curve(roc_points(rows, ["member"], bounds=bounds), ["member"], max_points, bounds).select(
        "member", F.lit("roc").alias("curve"), "idx", F.col("fpr").alias("x"), F.col("tpr").alias("y")
    )
    pr = downsample_curve(pr_points(rows, ["member"], bounds=bounds), ["member"], max_points, bounds).select(
        "member", F.lit("pr").alias("curve"), "idx", F.col("recall").alias("x"), F.col("precision").alias("y")
    )
    return Evaluation(
        results=results.join(curve_summary(rows, ["member"], bounds=bounds).drop("ap", "auprc_trapz"), "member"),
        grid=threshold_grid(rows, ["member"]),
        counters=protein_counters(support),
        curves=roc.unionByName(pr),
        best_fold=rank_folds(folds, best_fold_by, direction=best_fold_direction),
    )


def best_set(runs: DataFrame, metric: str, *, agg: str = "mean", direction: str = "auto") -> DataFrame:
    """The winning ensemble set (one row)."""
    return rank_sets(runs, metric, agg=agg, direction=direction).filter("rank = 1").drop("rank")
