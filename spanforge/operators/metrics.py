"""Exact, distributed threshold search, ROC/PR curves and classifier evaluation.

Input is a long score table: ``y`` (1 = positive), ``p`` (probability) and any
number of key columns (fold, member, run). Rows are first reduced to one per
distinct score, so ties cost nothing and a score shared by a third of all rows
is one row after the map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.stats import (
    BELOW_ONE,
    DIAGNOSTIC_THRESHOLDS,
    confusion_columns,
    extended_confusion_columns,
    finite_or_null,
    ratio_or_nan,
    ratio_or_zero,
    weighted_log_loss,
)
from spanforge.operators.ranking import Bounds, join_keys, keep_downsampled, numeric_bounds, prefix_sums

# Policy names and selection statuses.
THRESHOLD_POLICIES = ("max-recall-min-precision", "best-f1", "best-mcc", "min-recall-max-precision", "fixed")
OK, NO_ROWS = "ok", "no_valid_residues"
UNREACHABLE = {
    "max-recall-min-precision": "min_precision_unreachable",
    "min-recall-max-precision": "min_recall_unreachable",
}

NAN = float("nan")


def check_constraint(value: float, name: str) -> float:
    """A constraint must lie in [0, 1]."""
    value = float(value)
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be in [0.0, 1.0]")
    return value


def check_probability(value: float, name: str) -> float:
    """A decision threshold must lie strictly inside (0, 1)."""
    value = float(value)
    if not 0.0 < value < 1.0:
        raise ValueError(f"{name} must be in (0.0, 1.0)")
    return value


def finite_score(p: Column) -> Column:
    """The score as double; the job fails on NaN or infinity."""
    value = p.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(value)


def score_counts(scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives per distinct score (and key)."""
    return (
        scores.select(*keys, F.col(y).alias("y"), finite_score(F.col(p)).alias("threshold"))
        .groupBy(*keys, "threshold")
        .agg(
            F.count_if(F.col("y") == 1).alias("pos"),
            F.count_if(F.col("y") != 1).alias("neg"),
        )
    )


def score_bounds(scores: DataFrame, p: str = "p", n_blocks: int | None = None) -> Bounds:
    """Block bounds of the scores, for callers that build several curves of one table."""
    return numeric_bounds(scores, -F.col(p).cast("double"), n_blocks)


def operating_points(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", bounds: Bounds | None = None
) -> DataFrame:
    """One row per distinct score, descending: cumulative ``tp``/``fp`` at that
    threshold, the class totals, and the counts of the following point."""
    counts = score_counts(scores, keys, y, p)
    bounds = score_bounds(scores, p) if bounds is None else bounds
    points = prefix_sums(
        counts,
        [-F.col("threshold")],
        {"pos": F.col("pos"), "neg": F.col("neg")},
        keys,
        bounds=bounds,
        peek=("pos", "neg"),
    )
    return points.select(
        *keys,
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("n_pos"),
        F.col("total_neg").alias("n_neg"),
        "next_pos",
        "next_neg",
    )


def candidate_rows(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metric row of every candidate threshold, plus the one that predicts nothing."""
    row = F.struct("threshold", "tp", "fp")
    none = F.struct(F.lit(BELOW_ONE).alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("fp"))
    # The highest score is the point whose running counts are its own counts.
    top = (F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")) & (F.col("threshold") < BELOW_ONE)
    each = points.select(
        *keys, "n_pos", "n_neg", F.explode(F.when(top, F.array(row, none)).otherwise(F.array(row))).alias("c")
    )
    tp, fp = F.col("c.tp"), F.col("c.fp")
    columns = confusion_columns(F.col("c.threshold"), tp, fp, F.col("n_neg") - fp, F.col("n_pos") - tp)
    return each.select(*keys, *[c.alias(name) for name, c in columns.items()])


def _policy_key(policy: str, min_precision: float, min_recall: float) -> tuple[Column, Column]:
    """(ordering struct, "constraint met") for one policy; the struct's maximum wins."""
    precision, recall, threshold = F.col("precision"), F.col("recall"), F.col("threshold")
    if policy == "best-f1":
        return F.struct("f1", "precision", "recall", "threshold"), F.lit(True)
    if policy == "best-mcc":
        return F.struct("mcc", "f1", "precision", "recall", "threshold"), F.lit(True)
    if policy == "max-recall-min-precision":
        met = precision >= min_precision
        return (
            F.struct(
                met.alias("met"),
                F.when(met, recall).otherwise(precision).alias("k1"),
                F.when(met, precision).otherwise(threshold).alias("k2"),
                threshold.alias("k3"),
            ),
            met,
        )
    met = recall >= min_recall
    return (
        F.struct(
            met.alias("met"),
            F.when(met, precision).otherwise(recall).alias("k1"),
            F.when(met, recall).otherwise(precision).alias("k2"),
            threshold.alias("k3"),
        ),
        met,
    )


_ROW_FIELDS = (
    "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "mcc",
    "support_pos", "support_neg", "valid_residues", "pred_pos", "pred_neg", "pred_pos_frac",
)
_COUNT_FIELDS = ("tp", "fp", "tn", "fn", "support_pos", "support_neg", "valid_residues", "pred_pos", "pred_neg")


def select_thresholds(
    scores: DataFrame,
    policies: Sequence[str] = THRESHOLD_POLICIES,
    keys: Sequence[str] = (),
    *,
    y: str = "y",
    p: str = "p",
    min_precision: float = 0.25,
    min_recall: float = 0.80,
    fixed_threshold: float = 0.50,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Decision threshold per policy (and key), all searching policies in one pass.

    Without keys an empty input yields one ``no_valid_residues`` row per policy.
    """
    policies = [str(name).strip().lower() for name in policies]
    unknown = [name for name in policies if name not in THRESHOLD_POLICIES]
    if unknown:
        raise ValueError(f"unsupported threshold policy {unknown}; expected one of {THRESHOLD_POLICIES}")
    check_constraint(min_precision, "min_precision")
    check_constraint(min_recall, "min_recall")
    check_probability(fixed_threshold, "fixed_threshold")

    parts = []
    searching = [name for name in policies if name != "fixed"]
    if searching:
        rows = candidate_rows(operating_points(scores, keys, y, p, bounds), keys)
        picks = []
        for name in searching:
            key, met = _policy_key(name, min_precision, min_recall)
            row = F.struct(*_ROW_FIELDS, met.alias("met"))
            picks.append(F.struct(F.lit(name).alias("policy"), F.max_by(row, key).alias("row")))
        best = rows.groupBy(*keys).agg(F.array(*picks).alias("picks"))
        best = best.select(*keys, F.explode("picks").alias("pick")).select(*keys, "pick.policy", "pick.row.*")
        unmet = F.when(F.col("policy") == searching[0], F.lit(UNREACHABLE.get(searching[0], OK)))
        for name in searching[1:]:
            unmet = unmet.when(F.col("policy") == name, F.lit(UNREACHABLE.get(name, OK)))
        parts.append(best.withColumn("status", F.when(F.col("met"), OK).otherwise(unmet)).drop("met"))
    if "fixed" in policies:
        at = confusion_at(scores, F.lit(float(fixed_threshold)), keys, y, p)
        parts.append(at.withColumn("policy", F.lit("fixed")).withColumn("status", F.lit(OK)))

    chosen = parts[0]
    for more in parts[1:]:
        chosen = chosen.unionByName(more)
    empty = F.coalesce(F.col("valid_residues"), F.lit(0)) == 0
    out = [F.when(empty, NAN).otherwise(F.col(c)).alias(c) if c not in _COUNT_FIELDS
           else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _ROW_FIELDS]
    return chosen.select(
        *keys,
        "policy",
        *out,
        F.when(empty, NO_ROWS).otherwise(F.col("status")).alias("status"),
        F.lit(float(min_precision)).alias("min_precision"),
        F.lit(float(min_recall)).alias("min_recall"),
        F.lit(float(fixed_threshold)).alias("fixed_threshold"),
    )


def max_recall_threshold(scores: DataFrame, min_precision: float = 0.50, keys: Sequence[str] = ()) -> DataFrame:
    """Highest recall at a minimum precision, with the stricter default of 0.50."""
    return select_thresholds(scores, ["max-recall-min-precision"], keys, min_precision=min_precision)


def _confusion_sums(y: Column, predicted: Column) -> list[Column]:
    positive = y == 1
    return [
        F.count_if(predicted & positive).alias("tp"),
        F.count_if(predicted & ~positive).alias("fp"),
        F.count_if(~predicted & ~positive).alias("tn"),
        F.count_if(~predicted & positive).alias("fn"),
    ]


def _with_confusion_row(df: DataFrame, keys: Sequence[str], threshold: Column, keep: Sequence[str] = ()) -> DataFrame:
    columns = confusion_columns(threshold, *[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return df.select(*keys, *keep, *[c.alias(name) for name, c in columns.items()])


def confusion_at(
    scores: DataFrame, threshold: Column, keys: Sequence[str] = (), y: str = "y", p: str = "p"
) -> DataFrame:
    """Metric row at one threshold: a single map-side-combined pass."""
    sums = _confusion_sums(F.col(y), finite_score(F.col(p)) >= threshold)
    return _with_confusion_row(scores.groupBy(*keys).agg(*sums), keys, threshold)


def threshold_grid(
    scores: DataFrame,
    keys: Sequence[str] = (),
    thresholds: Sequence[float] = DIAGNOSTIC_THRESHOLDS,
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """Metric rows at fixed thresholds. All thresholds are counted in one pass
    over the scores, not by multiplying rows with the grid."""
    grid = [check_probability(t, "threshold") for t in thresholds]
    cells = [
        F.struct(F.lit(t).alias("threshold"), *_confusion_sums(F.col(y), finite_score(F.col(p)) >= t)) for t in grid
    ]
    rows = scores.groupBy(*keys).agg(F.array(*cells).alias("cells"))
    rows = rows.select(*keys, F.explode("cells").alias("cell")).select(*keys, "cell.*")
    rows = rows.filter(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") > 0)
    return _with_confusion_row(rows, keys, F.col("threshold"))


# --- ranking metrics -------------------------------------------------------


def _on_roc_corner() -> Column:
    """True for points an ROC curve keeps: first, last, and wherever the step changes."""
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return first | F.col("next_pos").isNull() | bend


def ranking_metrics(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", bounds: Bounds | None = None
) -> DataFrame:
    """ROC AUC, average precision, PR trapezoid and the area left of FPR 0.10.

    Every point carries its predecessor implicitly (running counts minus its own
    counts), so all areas are plain sums over the points of a key.
    """
    points = operating_points(scores, keys, y, p, bounds)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    roc_area = neg * (tp - pos / 2.0)
    precision = tp / (tp + fp)
    before = tp + fp - pos - neg
    precision_before = F.when(before > 0, (tp - pos) / before).otherwise(1.0)
    low = F.try_divide(fp, n_neg) <= 0.10  # null without negatives
    corner = low & _on_roc_corner()

    sums = points.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(roc_area).alias("roc"),
        F.sum(pos * precision).alias("ap"),
        F.sum(pos * (precision + precision_before) / 2.0).alias("trapezoid"),
        F.sum(F.when(low, roc_area)).alias("low_area"),
        # Both counts only grow along the curve, so each maximum is the last point's.
        *[F.max(F.when(low, v)).alias(f"low_{n}") for n, v in (("fp", fp), ("tp", tp))],
        *[F.max(F.when(corner, v)).alias(f"corner_{n}") for n, v in (("fp", fp), ("tp", tp))],
    )
    p_total, n_total = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    lone = F.when(F.col("n_pos") > 0, 1.0).otherwise(0.0)
    # Points after the last kept corner lie on one straight segment: cut it off.
    tail = (F.col("low_fp") - F.col("corner_fp")) * (F.col("low_tp") + F.col("corner_tp")) / 2.0
    pairs = p_total * n_total
    auc10 = F.try_divide(F.col("low_area") - tail, pairs) / 0.10
    empty = F.col("n_pos").isNull()
    return sums.select(
        *keys,
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
        F.when(both, F.try_divide("roc", pairs)).otherwise(NAN).alias("auc"),
        F.when(empty, NAN).when(both, F.try_divide("ap", p_total)).otherwise(lone).alias("pr_auc"),
        F.when(both & F.col("corner_fp").isNotNull(), auc10).otherwise(NAN).alias("auc10"),
        F.when(empty, NAN).when(both, F.try_divide("trapezoid", p_total)).otherwise(lone).alias("pr_auc_trapz"),
    )


def roc_points(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", bounds: Bounds | None = None
) -> DataFrame:
    """ROC corners (``fpr``, ``tpr``) from (0,0); keys with a single class give no rows."""
    points = operating_points(scores, keys, y, p, bounds)
    kept = points.filter(_on_roc_corner() & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    here = F.struct("threshold", F.col("fp").alias("fp"), F.col("tp").alias("tp"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fp"),
                      F.lit(0).cast("bigint").alias("tp"))
    rows = kept.select(
        *keys, "n_pos", "n_neg", F.explode(F.when(first, F.array(origin, here)).otherwise(F.array(here))).alias("c")
    )
    return rows.select(
        *keys,
        "c.threshold",
        F.col("c.fp").alias("fp"),
        F.col("c.tp").alias("tp"),
        F.try_divide("c.fp", "n_neg").alias("fpr"),
        F.try_divide("c.tp", "n_pos").alias("tpr"),
    )


def pr_points(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", bounds: Bounds | None = None
) -> DataFrame:
    """Every precision/recall point in ascending recall, led by (recall 0, precision 1).
    Without positives recall is 1 everywhere but at that leading point."""
    points = operating_points(scores, keys, y, p, bounds)
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    lead = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    here = F.struct(
        F.col("threshold"),
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(1.0).alias("recall"),
        ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )
    exploded = points.select(*keys, F.explode(F.when(first, F.array(lead, here)).otherwise(F.array(here))).alias("c"))
    return exploded.select(*keys, "c.*")


def downsample_curve(
    points: DataFrame, keys: Sequence[str] = (), max_points: int = 2048, bounds: Bounds | None = None
) -> DataFrame:
    """Evenly spaced points of a curve (descending ``threshold``), ends included, with
    their ``idx``. The bounds the curve was built with spare another pass over it."""
    order = -F.col("threshold")
    bounds = numeric_bounds(points, order) if bounds is None else bounds
    ranked = prefix_sums(points, [order], {"n": F.lit(1)}, keys, bounds=bounds)
    indexed = ranked.withColumn("idx", F.col("cum_n") - 1)
    return keep_downsampled(indexed, "idx", "total_n", max_points).drop("cum_n", "total_n")


def curve_summary(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", bounds: Bounds | None = None
) -> DataFrame:
    """Scalar part of the curve payloads: availability, reason, baseline, AP, trapezoid."""
    m = ranking_metrics(scores, keys, y, p, bounds)
    total = F.col("n_pos") + F.col("n_neg")
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return m.select(
        *keys,
        (~single).alias("roc_available"),
        F.when(single, "single-class-labels").alias("roc_reason"),
        (total > 0).alias("pr_available"),
        F.when(total == 0, "no-valid-residues").alias("pr_reason"),
        F.when(total > 0, F.col("n_pos") / total).alias("baseline_positive_rate"),
        F.when(total > 0, F.col("pr_auc")).alias("ap"),
        F.when(total > 0, F.col("pr_auc_trapz")).alias("auprc_trapz"),
    )


# --- full evaluation -------------------------------------------------------


def evaluate(
    scores: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", pred: str = "pred",
    bounds: Bounds | None = None,
) -> DataFrame:
    """Complete evaluation per key: counts, confusion family and ranking metrics."""
    keys = list(keys)
    sums = scores.groupBy(*keys).agg(*_confusion_sums(F.col(y), F.col(pred) == 1))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    row = confusion_columns(F.lit(None).cast("double"), tp, fp, tn, fn)
    extended = extended_confusion_columns(tp, fp, tn, fn)
    missing = total == 0
    basics = sums.select(
        *keys,
        "tp",
        "fp",
        "tn",
        "fn",
        total.alias("valid_residues"),
        (tp + fn).alias("pos_residues"),
        (tn + fp).alias("neg_residues"),
        (tp + fp).alias("pred_pos_residues"),
        (tn + fn).alias("pred_neg_residues"),
        ratio_or_nan(tp + tn, total).alias("accuracy"),
        *[F.when(missing, NAN).otherwise(row[c]).alias(c) for c in ("precision", "recall", "f1", "mcc")],
        *[c.alias(name) for name, c in extended.items()],
    )
    ranked = ranking_metrics(scores, keys, y, p, bounds).drop("n_pos", "n_neg")
    return join_keys(basics, ranked, keys) if keys else basics.crossJoin(F.broadcast(ranked))  # one row each


def log_loss(
    scores: DataFrame, keys: Sequence[str] = (), *, logit: str = "logit", y: str = "y", pos_weight: float | Column = 1.0
) -> DataFrame:
    """Mean weighted cross-entropy over the (valid) rows of each key."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return scores.groupBy(*keys).agg(
        F.avg(weighted_log_loss(F.col(logit), F.col(y), weight)).alias("loss"), F.count(F.lit(1)).alias("n_valid")
    )


def numeric_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation (0 for one value), min and max of the finite values."""
    v = finite_or_null(F.col(value))
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


