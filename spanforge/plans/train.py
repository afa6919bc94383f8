"""Cross-validated classifier runs, fitted together; run rows, manifests and sweeps."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.stats import finite_or_null
from spanforge.operators.ensemble import best_trial
from spanforge.operators.fits import Fit, Model, fit_all, score_held_out
from spanforge.operators.metrics import evaluate, log_loss, score_bounds, select_thresholds
from spanforge.operators.quality import run_status
from spanforge.operators.splits import FoldPlan
from spanforge.session import cut_lineage

# How a run was trained, the columns of its counts, and the head of these models.
TRAIN_MODES = {True: "ensemble-kfold", False: "seeded"}
_SIDES = {"train": "Train", "validation": "Val"}
MODEL_HEAD = "linear"
#: Iterations of a fit, and the share of trials that goes on at each rung of a sweep.
MAX_ITER, KEPT = 20, 3


def training_table(examples: DataFrame, plan: FoldPlan) -> DataFrame:
    """Written ``(id, features, y, folds)``: every example once, with its fold in each set of the plan."""
    folds = plan.rows.groupBy(F.col(plan.id_col).alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("set_number", "fold"))), lambda s: s["fold"]).alias("folds"))  # one entry per set
    rows = examples.select("id", F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"))
    return cut_lineage(rows.join(folds, "id"))


def plan_models(plan: FoldPlan, *, penalty: float = 0.01, max_iter: int = MAX_ITER, first: int = 0) -> list[Model]:
    """One model per run of the plan, named by its run index (after ``first``)."""
    folds = range(1, plan.n_folds + 1)
    runs = [(s, f) for s in range(1, len(plan.split_seeds) + 1) for f in folds]
    return [Model(first + k, s, f, penalty, max_iter) for k, (s, f) in enumerate(runs, start=1)]


def _penalty(params: Mapping[str, float]) -> float:
    unknown = set(params) - {"regParam", "maxIter"}
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}; expected regParam and maxIter")
    return float(params.get("regParam", 0.01))


def judge(
    table: DataFrame, models: Sequence[Model], fits: Sequence[Fit], weights: np.ndarray, *, policy: str, min_precision: float = 0.25,
    min_recall: float = 0.80, fixed_threshold: float = 0.50,
) -> tuple[DataFrame, DataFrame]:
    """(metrics of every model on the rows it did not see, the scores): one pass scores all models."""
    scored = cut_lineage(score_held_out(table, models, fits))  # feeds the threshold search, the metrics and the loss
    bounds = score_bounds(scored)
    picked = select_thresholds(
        scored, [policy], ["model"], min_precision=min_precision, min_recall=min_recall, fixed_threshold=fixed_threshold, bounds=bounds,
    ).select("model", F.col("threshold").alias("Threshold"), F.col("policy").alias("ThresholdPolicy"), F.col("status").alias("ThresholdStatus"),
             F.col("pred_pos_frac").alias("ThresholdPredPosFrac"))
    picked = cut_lineage(picked)  # one row per model
    judged = scored.join(F.broadcast(picked), "model").withColumn("pred", (F.col("p") >= F.col("Threshold")).cast("int"))
    spark = table.sparkSession
    heads = spark.createDataFrame(
        [(m.name, f.weights.tolist(), f.bias, f.iterations, f.converged, float(w)) for m, f, w in zip(models, fits, weights)],
        "model int, weights array<double>, bias double, iterations int, converged boolean, pos_weight double")
    loss = log_loss(scored.join(F.broadcast(heads.select("model", "pos_weight")), "model"), ["model"], pos_weight=F.col("pos_weight"))
    return evaluate(judged, ["model"], bounds=bounds).join(picked, "model").join(heads, "model").join(loss, "model"), scored


def cross_validate(
    examples: DataFrame,
    plan: FoldPlan,
    *,
    policy: str = "max-recall-min-precision",
    params: Mapping[str, float] | None = None,
    metric: str = "pr_auc",
    min_precision: float = 0.25,
    min_recall: float = 0.80,
    fixed_threshold: float = 0.50,
    strategy: str = "size-balanced",
    save_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit one weighted logistic model per run, all runs together, and judge each on its validation rows.

    ``examples`` is ``(id, features array, y)``. Returns the run rows and the validation
    scores ``(run_index, id, y, p)``. Every example is joined to its folds once.
    """
    started = time.monotonic()
    params = dict(params or {})
    table = training_table(examples, plan)
    models = plan_models(plan, penalty=_penalty(params), max_iter=int(params.get("maxIter", MAX_ITER)))
    fits, weights = fit_all(table, models)
    results, scored = judge(
        table, models, fits, weights, policy=policy, min_precision=min_precision, min_recall=min_recall, fixed_threshold=fixed_threshold)
    elapsed = time.monotonic() - started
    value = finite_or_null(F.col(metric))
    place = results.withColumn("set_number", F.floor((F.col("model") - 1) / plan.n_folds).cast("int") + 1)
    seed = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("set_number") - 1)
    kfold = plan.n_folds > 1
    none = lambda kind: F.lit(None).cast(kind)
    of_set = F.col("set_number") if kfold else none("int")
    constraint = {"max-recall-min-precision": ("ThresholdMinPrecision", min_precision), "min-recall-max-precision": ("ThresholdMinRecall", min_recall),
                  "fixed": ("ThresholdFixedValue", fixed_threshold)}.get(policy, (None, None))
    run_dir = F.concat(F.lit(f"{save_path}/"), F.lit("run_"), F.format_string("%03d", "model")) if save_path else none("string")
    rows = place.join(_side_counts(table, plan), "model").select(
        F.col("model").alias("RunIndex"),
        F.lit(TRAIN_MODES[kfold]).alias("TrainMode"),
        of_set.alias("EnsembleSetIndex"),
        (seed(plan.split_seeds) if kfold else none("int")).alias("EnsembleSetSplitSeed"),
        (seed(plan.train_seeds) if kfold else none("int")).alias("EnsembleSetTrainSeed"),
        (F.format_string(f"{save_path}/set_%02d", "set_number") if save_path and kfold else none("string")).alias("EnsembleSetDir"),
        (F.pmod(F.col("model") - 1, F.lit(plan.n_folds)) + 1 if kfold else none("int")).alias("FoldIndex"),
        F.lit(plan.n_folds).alias("NFolds"),
        seed(plan.split_seeds).alias("SplitSeed"),
        seed(plan.train_seeds).alias("TrainSeed"),
        F.lit(strategy).alias("SplitStrategy"),
        F.lit(f"{save_path}/split_report.json" if save_path else None).cast("string").alias("SplitReportJson"),
        F.lit(MODEL_HEAD).alias("ModelHead"),
        F.lit("none").alias("SeqLenFeature"),
        *[F.lit(0).alias(c) for c in ("ConvChannels", "ConvLayers", "ConvKernelSize")],
        F.lit(0.0).alias("ConvDropout"),
        *[f"{side}{c}" for side in _SIDES.values() for c in ("Proteins", "ValidResidues", "PosResidues", "NegResidues", "PositiveRate")],
        run_dir.alias("RunSaveDir"),
        run_dir.alias("CheckpointPath"),
        F.lit(metric).alias("BestMetricKey"),
        value.alias("BestMetricValue"),
        F.col("iterations").alias("BestEpoch"),
        finite_or_null(F.col("loss")).alias("BestValLoss"),
        "Threshold", "ThresholdPolicy", "ThresholdStatus",
        *[F.lit(constraint[1] if constraint[0] == c else None).cast("double").alias(c) for c in ("ThresholdMinPrecision", "ThresholdMinRecall", "ThresholdFixedValue")],
        "ThresholdPredPosFrac",
        *[finite_or_null(F.col(c)).alias(name) for name, c in (
            ("PR_AUC", "pr_auc"), ("F1", "f1"), ("MCC", "mcc"), ("AUC", "auc"), ("AUC10", "auc10"), ("BalancedAcc", "res_balanced_acc"))],
        F.lit(elapsed).alias("ElapsedSec"),
        run_status(F.lit(0), value).alias("Status"),
        "weights", "bias",
    )
    return rows, scored.select(F.col("model").alias("run_index"), "id", "y", "p")


def _side_counts(table: DataFrame, plan: FoldPlan) -> DataFrame:
    """Examples, positives and negatives of both sides of every run, by complement: one row per run."""
    spread = table.select("y", F.posexplode("folds").alias("s", "fold")).withColumn("set_number", F.col("s") + 1)
    sums = plan.sums(spread, {"n": F.count(F.lit(1)), "pos": F.count_if(F.col("y") == 1)}).groupBy(F.col("run_index").alias("model"))
    columns = []
    for role, side in _SIDES.items():
        n, pos = (F.sum(F.when(F.col("role") == role, F.col(c))) for c in ("n", "pos"))
        columns += [n.alias(f"{side}Proteins"), n.alias(f"{side}ValidResidues"), pos.alias(f"{side}PosResidues"), (n - pos).alias(f"{side}NegResidues"),
                    F.when(n > 0, pos / n).alias(f"{side}PositiveRate")]
    return sums.agg(*columns)


def ensemble_manifest(run_rows: DataFrame, *, n_folds: int, policy: str, metric: str) -> DataFrame:
    """Manifest document: schema 1 for one set, schema 2 with a set list for several."""
    member = F.struct(
        F.col("RunIndex").alias("member_index"),
        F.col("FoldIndex").alias("fold_index"),
        F.col("SplitSeed").alias("split_seed"),
        F.col("TrainSeed").alias("train_seed"),
        F.concat(F.lit("run_"), F.format_string("%03d", "RunIndex")).alias("checkpoint"),
        F.col("Threshold").alias("threshold"),
        F.col("ThresholdPolicy").alias("threshold_policy"),
        F.col("ThresholdStatus").alias("threshold_status"),
        F.col("Status").alias("status"),
        F.col("BestMetricValue").alias("best_metric_value"),
    )
    sets = run_rows.groupBy(F.coalesce("EnsembleSetIndex", F.lit(1)).alias("set_index")).agg(
        F.min("SplitSeed").alias("split_seed"),
        F.min("TrainSeed").alias("train_seed"),
        F.count(F.lit(1)).alias("n_members"),
        F.count_if(F.col("Status") == "OK").alias("n_valid_members"),
        F.transform(F.array_sort(F.collect_list(F.struct("FoldIndex", "RunIndex", member.alias("m")))),
                    lambda s: s["m"]).alias("members"),
    )
    document = F.struct(
        F.lit(1).alias("schema_version"), F.lit("kfold_majority_vote").alias("ensemble_type"),
        F.lit(n_folds).alias("n_folds"), "set_index", "split_seed", "train_seed",
        F.lit(metric).alias("best_model_metric"), F.lit(policy).alias("threshold_policy"), "n_members",
        "n_valid_members", F.struct(F.lit("majority").alias("rule"), F.lit("negative").alias("tie_break")).alias("voting"),
        "members",
    )
    packed = sets.agg(F.array_sort(F.collect_list(document)).alias("sets"))
    single = F.to_json(F.get(F.col("sets"), F.lit(0)), {"ignoreNullFields": "false"})
    several = F.to_json(
        F.struct(F.lit(2).alias("schema_version"), F.lit("kfold_majority_vote").alias("ensemble_type"),
                 F.lit(n_folds).alias("n_folds"), F.size("sets").alias("n_sets"),
                 F.lit("set-paired").alias("ensemble_seed_mode"), F.lit(metric).alias("best_model_metric"),
                 F.lit(policy).alias("threshold_policy"), F.col("sets")),
        {"ignoreNullFields": "false"},
    )
    return packed.select(F.when(F.size("sets") == 1, single).otherwise(several).alias("value"))


def drawn_trials(space: Mapping[str, Sequence[float] | tuple], n_trials: int | None, seed: int) -> list[dict]:
    """Parameter settings of a sweep.

    Without ``n_trials`` every combination of the listed values. With it that many seeded
    draws: a list is a choice, ``("uniform", low, high)`` and ``("log", low, high)`` are ranges.
    """
    ranges = {name for name, v in space.items() if v and v[0] in ("uniform", "log")}
    if n_trials is None:
        if ranges:
            raise ValueError(f"ranges need a number of trials: {sorted(ranges)}")
        return [dict(zip(space, values)) for values in product(*space.values())]
    generator = np.random.default_rng(seed)
    trials = []
    for _ in range(n_trials):
        u = {name: float(generator.random()) for name in space}  # one draw each, so names do not shift each other's draws
        trial = {}
        for name, v in space.items():
            if name not in ranges:
                trial[name] = v[int(u[name] * len(v))]
            elif v[0] == "uniform":
                trial[name] = v[1] + u[name] * (v[2] - v[1])
            else:
                trial[name] = math.exp(math.log(v[1]) + u[name] * (math.log(v[2]) - math.log(v[1])))
        trials.append(trial)
    return trials


def sweep(
    examples: DataFrame, plan: FoldPlan, space: Mapping[str, Sequence[float] | tuple], *, policy: str = "max-recall-min-precision", metric: str = "pr_auc",
    n_trials: int | None = None, seed: int = 42, rungs: Sequence[int] = (MAX_ITER,),
) -> tuple[DataFrame, DataFrame]:
    """Cross-validate parameter settings; ``(trials, best trial)``.

    All runs of all trials of a rung are fitted in the same passes. ``rungs`` are growing
    numbers of iterations: after each but the last, only the best 1/``KEPT`` of the trials
    goes on, the others are pruned with the score and the rung they reached. A trial's score
    is its mean run metric; a trial with a run whose threshold policy was not met is pruned.
    """
    if not rungs or list(rungs) != sorted(set(rungs)) or rungs[0] < 1:
        raise ValueError("rungs must be growing numbers of iterations")
    trials = drawn_trials(space, n_trials, seed)
    table = training_table(examples, plan)
    runs = len(plan.split_seeds) * plan.n_folds
    alive, rows = list(range(len(trials))), []
    for rung, iterations in enumerate(rungs, start=1):
        models = [
            m for number in alive for m in plan_models(
                plan, penalty=_penalty(trials[number]), max_iter=int(trials[number].get("maxIter", iterations)), first=number * runs)]
        results, _ = judge(table, models, *fit_all(table, models), policy=policy)
        met = F.min((F.col("ThresholdStatus") == "ok").cast("int")) == 1
        scores = results.groupBy(F.floor((F.col("model") - 1) / runs).cast("int").alias("trial")).agg(
            F.avg(finite_or_null(F.col(metric))).alias("score"), met.alias("met")).collect()  # one row per trial
        # scores that differ by rounding alone are ties, which go to the lower number
        ranked = sorted(scores, key=lambda r: (not r["met"], -(round(r["score"], 12) if r["score"] is not None else -math.inf), r["trial"]))
        last = rung == len(rungs)
        kept = len(ranked) if last else max(1, len(ranked) // KEPT)
        for place, r in enumerate(ranked):
            if last or place >= kept:
                state = "COMPLETE" if last and r["met"] else "PRUNED"
                rows.append((r["trial"], json.dumps(trials[r["trial"]], sort_keys=True), r["score"], state, rung, len(ranked)))
        alive = sorted(r["trial"] for r in ranked[:kept])
    table = examples.sparkSession.createDataFrame(sorted(rows), "trial int, params string, score double, state string, rung int, rivals int")
    return table, best_trial(table)
