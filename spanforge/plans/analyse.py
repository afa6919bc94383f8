"""Analysis job: per-set result documents to metric tables and paired statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.stats import f1_from_rates, prevalence_lift, ratio_or_nan
from spanforge.operators.paired import long_metrics, paired_summary

# The metrics compared between models.
PAIRED_METRICS = (
    "best_fold_auc", "best_fold_pr_auc", "best_fold_pr_lift", "overall_auc", "overall_pr_auc",
    "peptide_precision", "peptide_recall", "peptide_f1",
)
_METRICS = "struct<auc:double,pr_auc:double,pr_auc_trapz:double,precision:double,recall:double,f1:double,mcc:double," \
           "support_pos:double,support_neg:double>"
_EVALUATION = (
    "struct<n_members:double,evaluation:struct<valid_residues:double,pos_residues:double,neg_residues:double,"
    f"metrics:{_METRICS},best_fold:struct<fold_index:double,metrics:{_METRICS}>,"
    f"folds:array<struct<fold_index:double,metrics:{_METRICS}>>>>"
)
_COMPARISON = (
    "struct<n_rows_compared:double,n_reactive:double,n_nonreactive:double,exact_match_rate:double,"
    "mean_pred_ones_overall:double,confusion_peptide_any_positive:struct<tp:double,fp:double,tn:double,fn:double,"
    "accuracy:double,precision:double,recall:double>>"
)


def _documents(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """``(model, set_index, d)`` of one document kind below the base folder.

    A document is a file ``base/<model>/set_NN/<name>`` or, as Spark's own sinks write it, a
    folder of that name. Only such paths are listed, and none at all is an empty table.
    """
    try:
        raw = spark.read.text(f"{base}/*/set_*/{name}", wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"model string, set_index int, d {schema}")
    pattern = r"/([^/]+)/set_(\d+)/" + name.replace(".", r"\.") + r"(?:/[^/]+)?$"
    path = F.col("_metadata.file_path")
    return raw.filter(path.rlike(pattern)).select(
        F.regexp_extract(path, pattern, 1).alias("model"),
        F.regexp_extract(path, pattern, 2).cast("int").alias("set_index"),
        F.from_json("value", schema).alias("d"),
    )


def seed_metrics(evaluations: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One flat row per (model, set); comparison columns stay null without a document."""
    metrics, best = "d.evaluation.metrics", "d.evaluation.best_fold"
    pos, neg = F.col(f"{metrics}.support_pos"), F.col(f"{metrics}.support_neg")
    left = evaluations.select(
        "model",
        "set_index",
        F.col("d.n_members").alias("n_members"),
        F.col(f"{best}.fold_index").alias("best_fold_index"),
        *[F.col(f"d.evaluation.{c}").alias(c) for c in ("valid_residues", "pos_residues", "neg_residues")],
        ratio_or_nan(pos, pos + neg).alias("prevalence"),
        *[F.col(f"{metrics}.{c}").alias(f"overall_{c}")
          for c in ("auc", "pr_auc", "pr_auc_trapz", "precision", "recall", "f1", "mcc")],
        prevalence_lift(F.col(f"{metrics}.pr_auc"), pos, neg).alias("overall_pr_lift"),
        *[F.col(f"{best}.metrics.{c}").alias(f"best_fold_{c}") for c in ("auc", "pr_auc", "pr_auc_trapz")],
        prevalence_lift(F.col(f"{best}.metrics.pr_auc"), pos, neg).alias("best_fold_pr_lift"),
    )
    c = "d.confusion_peptide_any_positive"
    right = comparisons.select(
        "model",
        "set_index",
        F.col("d.n_rows_compared").alias("peptide_n_rows"),
        F.col("d.n_reactive").alias("peptide_reactive"),
        F.col("d.n_nonreactive").alias("peptide_nonreactive"),
        *[F.col(f"{c}.{n}").alias(f"peptide_{n}") for n in ("tp", "fp", "tn", "fn", "precision", "recall", "accuracy")],
        f1_from_rates(F.col(f"{c}.precision"), F.col(f"{c}.recall")).alias("peptide_f1"),
        F.col("d.exact_match_rate").alias("peptide_exact_match_rate"),
        F.col("d.mean_pred_ones_overall").alias("peptide_mean_pred_ones"),
    )
    return left.join(right, ["model", "set_index"], "left")


def fold_metrics(evaluations: DataFrame) -> DataFrame:
    """One flat row per (model, set, fold)."""
    folds = evaluations.select("model", "set_index", F.explode("d.evaluation.folds").alias("f"))
    names = ("auc", "pr_auc", "pr_auc_trapz", "precision", "recall", "f1", "mcc")
    return folds.select("model", "set_index", F.col("f.fold_index").alias("fold_index"),
                        *[F.col(f"f.metrics.{n}").alias(n) for n in names])


def expected_grid(spark: SparkSession, models: Sequence[str], first: int, last: int) -> DataFrame:
    """Every (model, set_index) that should have documents."""
    if first < 1 or last < first:
        raise ValueError("invalid set range")
    return spark.createDataFrame([(m,) for m in models], "model string").select(
        "model", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("set_index")
    )


def missing_documents(grid: DataFrame, evaluations: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Warning rows: sets without an evaluation, and evaluated sets without a comparison."""
    keys = ["model", "set_index"]
    no_eval = grid.join(evaluations.select(*keys), keys, "left_anti").withColumn("missing", F.lit("evaluation"))
    have = grid.join(evaluations.select(*keys), keys, "left_semi")
    no_cmp = have.join(comparisons.select(*keys), keys, "left_anti").withColumn("missing", F.lit("comparison"))
    return no_eval.unionByName(no_cmp)


def analyse(
    spark: SparkSession, base: str, models: Sequence[str], *, evaluation_file: str, comparison_file: str,
    first: int = 1, last: int = 10, n_bootstrap: int = 10_000, seed: int = 42,
) -> dict[str, DataFrame]:
    """Seed metrics, fold metrics, warnings and paired statistics of a result folder.

    Documents lie at ``base/<model>/set_NN/<file>``; the two file paths below a
    set's folder are given by the caller.
    """
    grid = expected_grid(spark, models, first, last)
    keys = ["model", "set_index"]
    evaluations = _documents(spark, base, evaluation_file, _EVALUATION).join(grid, keys, "left_semi")
    comparisons = _documents(spark, base, comparison_file, _COMPARISON).join(grid, keys, "left_semi")
    seeds = seed_metrics(evaluations, comparisons)
    out = {
        "seed_metrics": seeds,
        "fold_metrics": fold_metrics(evaluations),
        "warnings": missing_documents(grid, evaluations, comparisons),
    }
    if len(models) >= 2:
        long = long_metrics(seeds, PAIRED_METRICS, *keys)
        out["paired_stats"] = paired_summary(long, models[0], models[1], n_bootstrap=n_bootstrap, seed=seed)
    return out
