import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import stats
from spanforge.operators import metrics as M


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(y, map(float, p))), "y int, p double")


def pick(spark, y, p, policy, **kw):
    return M.select_thresholds(frame(spark, y, p), [policy], **kw).first()


def test_policy_fixtures(spark):
    row = pick(spark, [1, 1, 0, 0], [.9, .8, .4, .1], "max-recall-min-precision", min_precision=.5)
    assert (row["status"], row["threshold"], row["precision"], row["recall"]) == ("ok", .8, 1.0, 1.0)
    row = pick(spark, [1, 0, 0], [.1, .9, .8], "max-recall-min-precision", min_precision=.8)
    assert row["status"] == "min_precision_unreachable"
    assert row["threshold"] == .1 and row["precision"] == pytest.approx(1 / 3)
    for policy in ("best-f1", "best-mcc"):
        row = pick(spark, [1, 1, 0, 0], [.9, .4, .8, .1], policy)
        assert row["threshold"] == .4 and row["f1"] == pytest.approx(.8)
    row = pick(spark, [1, 1, 0, 0], [.9, .3, .8, .1], "min-recall-max-precision", min_recall=1.0)
    assert row["threshold"] == .3 and row["recall"] == 1.0 and row["precision"] == pytest.approx(2 / 3)
    row = pick(spark, [1, 0, 1, 0], [.7, .6, .2, .1], "fixed")
    assert (row["tp"], row["fp"]) == (1, 1)
    assert M.threshold_grid(frame(spark, [1, 0, 1, 0], [.7, .6, .2, .1])).count() == 11


def test_min_recall_out_of_reach(spark):
    # Every score is at or above the "predict nothing" threshold's neighbour; recall 1 is always reachable,
    # so only an empty positive class misses the constraint.
    row = pick(spark, [0, 0], [.2, .4], "min-recall-max-precision")
    assert row["status"] == "min_recall_unreachable"


def test_empty_and_invalid(spark):
    empty = frame(spark, [1], [.5]).limit(0)
    for row in M.select_thresholds(empty).collect():
        assert row["status"] == "no_valid_residues" and math.isnan(row["threshold"]) and row["tp"] == 0
    assert M.threshold_grid(empty).count() == 0
    with pytest.raises(ValueError):
        M.select_thresholds(empty, ["best-of-all"])
    with pytest.raises(ValueError):
        M.select_thresholds(empty, min_precision=1.5)
    with pytest.raises(Exception, match="finite"):
        M.ranking_metrics(frame(spark, [1, 0], [float("nan"), .5])).collect()


def test_single_class(spark):
    row = M.ranking_metrics(frame(spark, [1, 1, 1, 1], [.9, .8, .7, .6])).first()
    assert math.isnan(row["auc"]) and math.isnan(row["auc10"]) and row["pr_auc"] == 1.0
    summary = M.curve_summary(frame(spark, [0, 0, 0], [.1, .2, .3])).first()
    assert not summary["roc_available"] and summary["roc_reason"] == "single-class-labels"
    assert M.roc_points(frame(spark, [0, 0, 0], [.1, .2, .3])).count() == 0
    # Without positives recall is 1 at every point but the leading one.
    points = M.pr_points(frame(spark, [0, 0], [.1, .2])).collect()
    assert sorted(r["recall"] for r in points) == [0.0, 1.0, 1.0]


def brute(y, p):
    """AUC by pairs, AP and trapezoid by scanning thresholds, low-FPR area from kept corners."""
    y, p = np.array(y), np.array(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]) + .5 * (pos[:, None] == neg[None, :])).mean()
    cuts = sorted(set(p), reverse=True)
    tp = np.array([(pos >= c).sum() for c in cuts])
    fp = np.array([(neg >= c).sum() for c in cuts])
    recall, precision = tp / len(pos), tp / (tp + fp)
    ap = float(np.sum(np.diff(np.r_[0, recall]) * precision))
    trapezoid = float(np.trapezoid(np.r_[1, precision], np.r_[0, recall]))
    keep = [True] + [
        not (tp[i + 1] - tp[i] == tp[i] - tp[i - 1] and fp[i + 1] - fp[i] == fp[i] - fp[i - 1])
        for i in range(1, len(cuts) - 1)
    ] + [True]
    keep = np.array(keep[: len(cuts)])
    fpr, tpr = np.r_[0, fp[keep] / len(neg)], np.r_[0, tp[keep] / len(pos)]
    low = fpr <= .10
    auc10 = float(np.trapezoid(tpr[low], fpr[low])) / .10 if low.sum() >= 2 else float("nan")
    return auc, ap, auc10, trapezoid


@pytest.mark.parametrize("seed", range(4))
def test_random_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.round(rng.random(n), 1 + seed % 3)
    row = M.ranking_metrics(frame(spark, y.tolist(), p)).first()
    want = brute(y, p)
    for name, value in zip(("auc", "pr_auc", "auc10", "pr_auc_trapz"), want):
        assert row[name] == pytest.approx(value, abs=1e-12, nan_ok=True)


def test_block_count_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = frame(spark, rng.integers(0, 2, 300).tolist(), np.round(rng.random(300), 2))
    results = {M.ranking_metrics(rows, bounds=M.score_bounds(rows, n_blocks=k)).first() for k in (1, 2, 7, 50, 300)}
    assert len({tuple(round(v, 12) for v in r) for r in results}) == 1


def test_downsample_indices(spark):
    points = spark.range(11).select((-F.col("id")).cast("double").alias("threshold"))
    kept = M.downsample_curve(points, max_points=5)
    assert sorted(r["idx"] for r in kept.collect()) == [0, 2, 5, 7, 10]
    for n, m in ((100, 7), (101, 100), (5, 9), (1000, 33)):
        points = spark.range(n).select((-F.col("id")).cast("double").alias("threshold"))
        got = sorted(r["idx"] for r in M.downsample_curve(points, max_points=m).collect())
        want = sorted(set(np.linspace(0, n - 1, num=m, dtype=np.int64).tolist())) if n > m else list(range(n))
        assert got == want


def test_extended_confusion(spark):
    rows = spark.createDataFrame([(0, 27, 73, 0), (45, 10, 40, 5)], "tp long, fp long, tn long, fn long")
    columns = stats.extended_confusion_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    a, b = rows.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert (a["specificity"], a["fpr"], a["npv"], a["res_balanced_acc"]) == (.73, .27, 1.0, .73)
    assert not a["has_both_classes"]
    assert b["specificity"] == .8 and b["fpr"] == .2 and b["npv"] == pytest.approx(40 / 45) and b["res_balanced_acc"] == pytest.approx(.85)


def test_sign_test_published_values(spark):
    rows = spark.createDataFrame([(k, 10 - k) for k in (0, 1, 3, 4, 5)] + [(0, 0), (400, 600)], "w int, l int")
    got = [r["p"] for r in rows.select(stats.sign_test_p(F.col("w"), F.col("l")).alias("p")).collect()]
    want = [0.001953125, 0.021484375, 0.34375, 0.75390625, 1.0, 1.0]
    assert got[:6] == pytest.approx(want)
    assert got[6] == pytest.approx(2 * sum(math.comb(1000, i) for i in range(401)) / 2**1000, rel=1e-9)


def test_normal_tail_and_wilson(spark):
    row = spark.range(1).select(
        stats.normal_upper_tail(F.lit(1.959963984540054)).alias("p"),
        stats.wilson_low(F.lit(8), F.lit(10)).alias("lo"), stats.wilson_high(F.lit(8), F.lit(10)).alias("hi"),
        stats.wilson_low(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert row["p"] == pytest.approx(.025, abs=1e-9)
    points = [i / 10 for i in range(-100, 101)]
    tails = spark.createDataFrame([(z,) for z in points], "z double").select("z", stats.normal_upper_tail(F.col("z")).alias("p")).collect()
    for r in tails:
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-11)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(stats.normal_upper_tail(F.col("z")).alias("p"))
    assert [r.p for r in odd.collect()] == [None, None]
    assert row["lo"] == pytest.approx(.490162, abs=1e-6) and row["hi"] == pytest.approx(.943318, abs=1e-6)
    assert math.isnan(row["none"])


def test_mcc_does_not_overflow(spark):
    big = 3_000_000_000
    row = spark.range(1).select(stats.mcc(F.lit(big), F.lit(1), F.lit(big), F.lit(1)).alias("m")).first()
    assert row["m"] == pytest.approx(1.0, abs=1e-6)


def test_null_keys_are_a_key(spark):
    rows = [(fold, i % 3 == 0, (i * 37 % 101) / 101) for i in range(60) for fold in (None, 1)]
    df = spark.createDataFrame([(f, int(y), p, int(p > .5)) for f, y, p in rows], "fold int, y int, p double, pred int")
    got = {r["fold"]: r.asDict() for r in M.evaluate(df, ["fold"]).collect()}
    assert set(got) == {None, 1}
    assert {k: v for k, v in got[None].items() if k != "fold"} == pytest.approx({k: v for k, v in got[1].items() if k != "fold"}, nan_ok=True)
    chosen = M.select_thresholds(df.drop("pred"), ["best-f1", "fixed"], ["fold"]).collect()
    assert sorted((r["policy"], str(r["fold"])) for r in chosen) == [("best-f1", "1"), ("best-f1", "None"), ("fixed", "1"), ("fixed", "None")]
