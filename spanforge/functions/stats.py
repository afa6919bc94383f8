"""Column expressions for confusion-table, proportion and sign-test arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 11 diagnostic thresholds, the 95 % normal quantile and the
# largest double below 1.0 (the threshold that predicts nothing).
DIAGNOSTIC_THRESHOLDS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95)
Z_95 = 1.959963984540054
BELOW_ONE = math.nextafter(1.0, 0.0)


def ratio_or_zero(n: Column, d: Column) -> Column:
    """n/d as double, 0.0 on a zero denominator."""
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def ratio_or_nan(n: Column, d: Column) -> Column:
    """n/d as double, NaN unless the denominator is positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(float("nan")))


def finite_or_null(c: Column) -> Column:
    """Numeric text or number as a finite double, everything else null."""
    value = c.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def open_unit_or_null(c: Column) -> Column:
    """A finite value strictly inside (0, 1), else null."""
    value = finite_or_null(c)
    return F.when((value > 0.0) & (value < 1.0), value)


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation, 0.0 when undefined; doubles throughout, since the
    four-way product overflows 64-bit integers at a few million rows."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, tn, fn))
    under = (a + b) * (a + d) * (c + b) * (c + d)
    return F.when(under > 0, (a * c - b * d) / F.sqrt(under)).otherwise(F.lit(0.0))


def confusion_columns(threshold: Column, tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """The full metric row of one confusion table, by column name."""
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    total = tp + fp + tn + fn
    return {
        "threshold": threshold,
        "tp": tp,
        "fp": fp,
        "tn": tn,
        "fn": fn,
        "precision": precision,
        "recall": recall,
        "f1": ratio_or_zero(2.0 * precision * recall, precision + recall),
        "mcc": mcc(tp, fp, tn, fn),
        "support_pos": tp + fn,
        "support_neg": tn + fp,
        "valid_residues": total,
        "pred_pos": tp + fp,
        "pred_neg": tn + fn,
        "pred_pos_frac": ratio_or_zero(tp + fp, total),
    }


def extended_confusion_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Specificity family; NaN where a class has no support."""
    nan = F.lit(float("nan"))
    neg_acc, pos_acc = ratio_or_nan(tn, tn + fp), ratio_or_nan(tp, tp + fn)
    both = F.when(F.isnan(neg_acc) & F.isnan(pos_acc), nan).when(F.isnan(neg_acc), pos_acc)
    return {
        "specificity": neg_acc,
        "fpr": ratio_or_nan(fp, tn + fp),
        "npv": ratio_or_nan(tn, tn + fn),
        "neg_acc": neg_acc,
        "pos_acc": pos_acc,
        "res_balanced_acc": both.when(F.isnan(pos_acc), neg_acc).otherwise((neg_acc + pos_acc) / 2.0),
        "has_both_classes": ((tn + fp) > 0) & ((tp + fn) > 0),
    }


def f1_from_rates(precision: Column, recall: Column) -> Column:
    """F1 of two rates: NaN if either is not finite, 0.0 if both are zero."""
    p, r = finite_or_null(precision), finite_or_null(recall)
    return F.when(p.isNull() | r.isNull(), F.lit(float("nan"))).otherwise(ratio_or_zero(2.0 * p * r, p + r))


def prevalence_lift(score: Column, positives: Column, negatives: Column) -> Column:
    """Average precision over prevalence; NaN without positives or a finite score."""
    prevalence = ratio_or_nan(positives, positives + negatives)
    value = finite_or_null(score)
    return F.when(value.isNull() | F.isnan(prevalence) | (prevalence <= 0), F.lit(float("nan"))).otherwise(
        value / prevalence
    )


def wilson_low(successes: Column, n: Column, z: float = Z_95) -> Column:
    return _wilson(successes, n, z, -1)


def wilson_high(successes: Column, n: Column, z: float = Z_95) -> Column:
    return _wilson(successes, n, z, 1)


def _wilson(successes: Column, n: Column, z: float, side: int) -> Column:
    size = n.cast("double")
    p, zz = successes.cast("double") / size, z * z
    half = z * F.sqrt((p * (1.0 - p) + zz / (4.0 * size)) / size)
    edge = (p + zz / (2.0 * size) + side * half) / (1.0 + zz / size)
    return F.when(n <= 0, F.lit(float("nan"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), edge)))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z statistic for p1 > p2; NaN for empty samples or zero variance."""
    a, m, b, n = (c.cast("double") for c in (x1, n1, x2, n2))
    pooled = (a + b) / (m + n)
    variance = pooled * (1.0 - pooled) * (1.0 / m + 1.0 / n)
    return F.when((n1 <= 0) | (n2 <= 0), F.lit(float("nan"))).otherwise(
        F.when(variance <= 0.0, F.lit(float("nan"))).otherwise((a / m - b / n) / F.sqrt(variance))
    )


#: Terms of the series and of the continued fraction; both are exact to 1e-15 with them.
TAIL_TERMS = 40


def normal_upper_tail(z: Column) -> Column:
    """1 - Phi(z) from built-in functions; null or NaN gives null.

    Up to |z| = 3 the odd power series around zero, beyond it the continued fraction
    of the tail, each evaluated from its last term inward.
    """
    size = F.abs(z.cast("double"))
    density = F.exp(-size * size / 2.0) / math.sqrt(2.0 * math.pi)

    inward = F.sequence(F.lit(TAIL_TERMS), F.lit(1))
    series = size * F.aggregate(inward, F.lit(1.0), lambda total, k: 1.0 + total * size * size / (2 * k + 1))
    fraction = F.aggregate(inward, size, lambda total, k: size + k / total)
    upper = F.when(size <= 3.0, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(z >= 0, upper).otherwise(1.0 - upper))


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided binomial sign test; ties are already out. Terms run on the log
    scale, so large n neither overflows nor underflows to a wrong sum."""
    n, k = (wins + losses).cast("bigint"), F.least(wins, losses).cast("bigint")
    start = F.struct((-n * F.lit(math.log(2.0))).alias("term"), F.lit(0.0).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        here = F.when(i == 0, state["term"]).otherwise(
            state["term"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))
        )
        return F.struct(here.alias("term"), (state["sum"] + F.exp(here)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), start, step, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def weighted_log_loss(logit: Column, y: Column, pos_weight: Column) -> Column:
    """Per-row cross-entropy on logits, stable for large |x|."""
    spread = F.log1p(F.exp(-F.abs(logit)))
    return F.when(y == 1, pos_weight * (F.greatest(-logit, F.lit(0.0)) + spread)).otherwise(
        F.greatest(logit, F.lit(0.0)) + spread
    )
