"""Paired statistics of two models over shared run sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.stats import finite_or_null, sign_test_p


def long_metrics(rows: DataFrame, metrics: Sequence[str], *keys: str) -> DataFrame:
    """Wide metric columns to ``(keys, metric, value)`` with finite values only."""
    picked = rows.select(*keys, *[finite_or_null(F.col(m)).alias(m) for m in metrics])
    return picked.unpivot(list(keys), list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def model_summary(long: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one run) by model and metric."""
    return long.groupBy("model", "metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(0.0).alias("std"),
    )


def paired_differences(long: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """``(metric, set_index, diff)`` with diff = B - A for sets both models have.

    One aggregate pairs the sides; a self join would read the table twice.
    """
    sides = long.filter(F.col("model").isin(model_a, model_b)).groupBy("metric", "set_index").agg(
        F.max(F.when(F.col("model") == model_a, F.col("value"))).alias("a"),
        F.max(F.when(F.col("model") == model_b, F.col("value"))).alias("b"),
    )
    return sides.filter("a is not null and b is not null").select(
        "metric", "set_index", (F.col("b") - F.col("a")).alias("diff")
    )


def bootstrap_interval(
    diffs: DataFrame, *, n_bootstrap: int = 10_000, seed: int = 42, alpha: float = 0.05, key: str = "metric"
) -> DataFrame:
    """Percentile interval of the resampled mean per key.

    Draw (replicate, slot) picks row ``md5(seed:key:replicate:slot) mod n``, so
    every draw is a pure function of its address: replicates run in parallel and
    any engine can repeat them. A single pair gives its own value twice.
    """
    # Each key's pairs, in set order, as one array: as long as the run sets.
    packed = diffs.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("set_index", "diff"))), lambda s: s["diff"]).alias("v")
    )
    # Replicates are cut into blocks of 100 that spread over tasks.
    n, last = F.size("v"), n_bootstrap - 1
    blocks = packed.select(key, "v", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(100))).alias("at"))
    draws = blocks.repartition(key, "at").select(
        key, "v", F.explode(F.sequence("at", F.least(F.col("at") + 99, F.lit(last)))).alias("rep")
    )

    def pick(slot):
        address = F.concat_ws(":", F.lit(str(seed)), F.col(key), F.col("rep").cast("string"), slot.cast("string"))
        draw = F.conv(F.substring(F.md5(address), 1, 8), 16, 10).cast("bigint")
        return F.get(F.col("v"), F.pmod(draw, n).cast("int"))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, slot: acc + pick(slot))
    means = draws.select(key, (total / n).alias("mean"))
    return means.groupBy(key).agg(
        F.percentile("mean", F.lit(alpha / 2.0)).alias("ci_low"),
        F.percentile("mean", F.lit(1.0 - alpha / 2.0)).alias("ci_high"),
    )


def paired_summary(
    long: DataFrame, model_a: str, model_b: str, *, n_bootstrap: int = 10_000, seed: int = 42
) -> DataFrame:
    """Pairs, mean and median difference, bootstrap interval and sign test per metric."""
    diffs = paired_differences(long, model_a, model_b)
    wins, losses = F.count_if(F.col("diff") > 0), F.count_if(F.col("diff") < 0)
    base = diffs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("diff").alias("mean_diff_b_minus_a"),
        F.median("diff").alias("median_diff_b_minus_a"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.array_sort(F.collect_list("set_index")).alias("paired_sets"),
    )
    interval = bootstrap_interval(diffs, n_bootstrap=n_bootstrap, seed=seed)
    return base.join(interval, "metric").select(
        "metric",
        F.lit(model_a).alias("model_a"),
        F.lit(model_b).alias("model_b"),
        "n_pairs",
        "mean_diff_b_minus_a",
        "median_diff_b_minus_a",
        F.col("ci_low").alias("bootstrap_ci95_low"),
        F.col("ci_high").alias("bootstrap_ci95_high"),
        sign_test_p(F.col("wins"), F.col("losses")).alias("sign_test_pvalue"),
        "paired_sets",
    )
