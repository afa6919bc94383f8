"""Threshold search, curves and evaluation over line items as scored positions.

Mapping: y = the item was returned, p = the price's fraction of a thousand,
fold = line status.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import metrics as M
from spanforge.operators.ensemble import mean_baseline, rank_folds
from workload.registry import query, table


def scored(spark, d, fold=False):
    items = table(spark, d, "lineitem")
    p = (F.col("l_extendedprice") % 1000) / 1000
    columns = [(F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p")]
    return items.select(*([F.col("l_linestatus").alias("fold")] if fold else []), *columns)


def sql_points(fold: str = "'all'") -> str:
    return f"""
    scored AS (SELECT {fold} AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
                      (l_extendedprice % 1000) / 1000 AS p FROM lineitem),
    counts AS (SELECT fold, p AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
               FROM scored GROUP BY fold, p),
    points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
                      sum(pos) OVER (PARTITION BY fold) AS n_pos, sum(neg) OVER (PARTITION BY fold) AS n_neg,
                      lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
               FROM counts WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC))"""


SQL_ROW = """threshold, tp, fp, tn, fn,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2.0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE))
         / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) ELSE 0 END AS f1,
    CASE WHEN CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) > 0
         THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
              / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc"""

SQL_CANDIDATES = f"""
    raw_candidates AS (
        SELECT fold, threshold, tp, fp, n_neg - fp AS tn, n_pos - tp AS fn FROM points
        UNION ALL
        SELECT fold, CAST(0.9999999999999999 AS DOUBLE), 0, 0, max(n_neg), max(n_pos) FROM points GROUP BY fold
        HAVING max(threshold) < 0.9999999999999999),
    candidates AS (SELECT fold, {SQL_ROW} FROM raw_candidates)"""

ROW_SPEC = "threshold:d tp:i fp:i tn:i fn:i precision:d recall:d f1:d mcc:d"


@query("threshold_candidates", ROW_SPEC, f"WITH {sql_points()}, {SQL_CANDIDATES} SELECT * FROM candidates")
def threshold_candidates(spark, d):
    return M.candidate_rows(M.operating_points(scored(spark, d)))


def _pick(policy: str, order: str, status: str = "'ok'") -> str:
    return f"""SELECT * FROM (SELECT '{policy}' AS policy, *, {status} AS status,
        row_number() OVER (PARTITION BY fold ORDER BY {order}) AS rn FROM candidates) WHERE rn = 1"""


def _sql_policies(fold: str = "'all'") -> str:
    met = "CASE WHEN precision >= 0.25 THEN 1 ELSE 0 END"
    met_recall = "CASE WHEN recall >= 0.80 THEN 1 ELSE 0 END"
    parts = [
        _pick(
            "max-recall-min-precision",
            f"{met} DESC, CASE WHEN precision >= 0.25 THEN recall ELSE precision END DESC, "
            "CASE WHEN precision >= 0.25 THEN precision ELSE threshold END DESC, threshold DESC",
            "CASE WHEN precision >= 0.25 THEN 'ok' ELSE 'min_precision_unreachable' END",
        ),
        _pick("best-f1", "f1 DESC, precision DESC, recall DESC, threshold DESC"),
        _pick("best-mcc", "mcc DESC, f1 DESC, precision DESC, recall DESC, threshold DESC"),
        _pick(
            "min-recall-max-precision",
            f"{met_recall} DESC, CASE WHEN recall >= 0.80 THEN precision ELSE recall END DESC, "
            "CASE WHEN recall >= 0.80 THEN recall ELSE precision END DESC, threshold DESC",
            "CASE WHEN recall >= 0.80 THEN 'ok' ELSE 'min_recall_unreachable' END",
        ),
    ]
    fixed = f"""SELECT 'fixed' AS policy, fold, {SQL_ROW}, 'ok' AS status, 1 AS rn FROM (
        SELECT fold, 0.5 AS threshold, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
               count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
               count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM scored GROUP BY fold)"""
    union = " UNION ALL BY NAME ".join(f"({p})" for p in [*parts, fixed])
    return f"WITH {sql_points(fold)}, {SQL_CANDIDATES} {union}"


@query("threshold_policies", f"policy:s {ROW_SPEC} status:s", _sql_policies())
def threshold_policies(spark, d):
    return M.select_thresholds(scored(spark, d))


@query("threshold_policies_by_fold", f"fold:s policy:s {ROW_SPEC} status:s", _sql_policies("l_linestatus"))
def threshold_policies_by_fold(spark, d):
    return M.select_thresholds(scored(spark, d, fold=True), keys=["fold"])


_GRID = ", ".join(f"({t})" for t in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95))
_SQL_GRID = f"""WITH {sql_points()}, grid(threshold) AS (VALUES {_GRID})
    SELECT {SQL_ROW} FROM (
        SELECT threshold, count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp,
               count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp,
               count(*) FILTER (WHERE y = 0 AND p < threshold) AS tn,
               count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn
        FROM scored CROSS JOIN (SELECT CAST(threshold AS DOUBLE) AS threshold FROM grid) GROUP BY threshold)"""


@query("threshold_grid", ROW_SPEC, _SQL_GRID)
def threshold_grid(spark, d):
    return M.threshold_grid(scored(spark, d))


def _sql_ranking(fold: str) -> str:
    return f"""WITH {sql_points(fold)},
    flagged AS (SELECT *, fp / CAST(n_neg AS DOUBLE) <= 0.1 AS low,
        (next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR tp + fp = pos + neg) AS corner FROM points),
    kept AS (SELECT fold, fp, tp, lag(fp, 1, 0) OVER w AS fp0, lag(tp, 1, 0) OVER w AS tp0, n_pos, n_neg
             FROM flagged WHERE low AND corner WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
    low AS (SELECT fold, sum((fp - fp0) * (tp + tp0) / 2.0) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) / 0.1 AS auc10
            FROM kept GROUP BY fold)
    SELECT fold, max(n_pos) AS n_pos, max(n_neg) AS n_neg,
        sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) AS auc,
        sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(n_pos) AS pr_auc, any_value(auc10) AS auc10,
        sum(pos * (tp / CAST(tp + fp AS DOUBLE) + CASE WHEN tp + fp > pos + neg
            THEN (tp - pos) / CAST(tp + fp - pos - neg AS DOUBLE) ELSE 1.0 END) / 2.0) / max(n_pos) AS pr_auc_trapz
    FROM points LEFT JOIN low USING (fold) GROUP BY fold"""


@query("ranking_metrics", "n_pos:i n_neg:i auc:d pr_auc:d auc10:d pr_auc_trapz:d", _sql_ranking("'all'"))
def ranking_metrics(spark, d):
    return M.ranking_metrics(scored(spark, d))


@query("ranking_metrics_by_fold", "fold:s n_pos:i n_neg:i auc:d pr_auc:d auc10:d pr_auc_trapz:d",
       _sql_ranking("l_linestatus"))
def ranking_metrics_by_fold(spark, d):
    return M.ranking_metrics(scored(spark, d, fold=True), ["fold"])


_SQL_CONFUSION = """cm AS (SELECT fold, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
        count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
        count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM scored GROUP BY fold)"""


@query("evaluation_by_fold",
       "fold:s tp:i fp:i tn:i fn:i valid_residues:i pred_pos_residues:i accuracy:d precision:d recall:d f1:d mcc:d "
       "specificity:d fpr:d npv:d neg_acc:d pos_acc:d res_balanced_acc:d has_both_classes:b auc:d pr_auc:d",
       f"""WITH ranked AS ({_sql_ranking("l_linestatus")}), {sql_points("l_linestatus")}, {_SQL_CONFUSION}
       SELECT cm.fold, {SQL_ROW.replace("threshold, ", "")}, tp + fp + tn + fn AS valid_residues,
         tp + fp AS pred_pos_residues, (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) AS accuracy,
         tn / CAST(tn + fp AS DOUBLE) AS specificity, fp / CAST(tn + fp AS DOUBLE) AS fpr,
         tn / CAST(tn + fn AS DOUBLE) AS npv, tn / CAST(tn + fp AS DOUBLE) AS neg_acc,
         tp / CAST(tp + fn AS DOUBLE) AS pos_acc,
         (tn / CAST(tn + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) / 2 AS res_balanced_acc,
         (tn + fp > 0 AND tp + fn > 0) AS has_both_classes, auc, pr_auc FROM cm JOIN ranked USING (fold)""")
def evaluation_by_fold(spark, d):
    rows = scored(spark, d, fold=True).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return M.evaluate(rows, ["fold"])


_SQL_ROC = f"""{sql_points("l_linestatus")},
    roc AS (SELECT fold, threshold, fp, tp, n_pos, n_neg FROM points
            WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR tp + fp = pos + neg
            UNION ALL SELECT DISTINCT fold, CAST('Infinity' AS DOUBLE), 0, 0, n_pos, n_neg FROM points),
    curve AS (SELECT fold, threshold, fp / CAST(n_neg AS DOUBLE) AS fpr, tp / CAST(n_pos AS DOUBLE) AS tpr FROM roc)"""
_SQL_THIN = """ranked AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY fold) AS n FROM curve
                WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
    grid AS (SELECT DISTINCT fold, CASE WHEN i = 99 THEN n - 1
                ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 99.0)) AS BIGINT) END AS idx
             FROM (SELECT DISTINCT fold, n FROM ranked) CROSS JOIN range(100) AS r(i))"""


@query("roc_curve", "fold:s fpr:d tpr:d", f"WITH {_SQL_ROC} SELECT fold, fpr, tpr FROM curve")
def roc_curve(spark, d):
    return M.roc_points(scored(spark, d, fold=True), ["fold"])


_SQL_PR = f"""{sql_points("l_linestatus")},
    curve AS (SELECT fold, threshold, tp / CAST(n_pos AS DOUBLE) AS recall, tp / CAST(tp + fp AS DOUBLE) AS precision
              FROM points UNION ALL SELECT DISTINCT fold, CAST('Infinity' AS DOUBLE), 0.0, 1.0 FROM points)"""


@query("pr_curve", "fold:s recall:d precision:d", f"WITH {_SQL_PR} SELECT fold, recall, precision FROM curve")
def pr_curve(spark, d):
    return M.pr_points(scored(spark, d, fold=True), ["fold"])


@query("roc_curve_downsampled", "fold:s idx:i fpr:d tpr:d",
       f"WITH {_SQL_ROC}, {_SQL_THIN} SELECT fold, idx, fpr, tpr FROM ranked JOIN grid USING (fold, idx)")
def roc_curve_downsampled(spark, d):
    rows = scored(spark, d, fold=True)
    bounds = M.score_bounds(rows)
    return M.downsample_curve(M.roc_points(rows, ["fold"], bounds=bounds), ["fold"], 100, bounds)


@query("pr_curve_downsampled", "fold:s idx:i recall:d precision:d",
       f"WITH {_SQL_PR}, {_SQL_THIN} SELECT fold, idx, recall, precision FROM ranked JOIN grid USING (fold, idx)")
def pr_curve_downsampled(spark, d):
    rows = scored(spark, d, fold=True)
    bounds = M.score_bounds(rows)
    return M.downsample_curve(M.pr_points(rows, ["fold"], bounds=bounds), ["fold"], 100, bounds)


def _distinct(spark, d):
    """One score per line item: 48 bits of a digest of its key."""
    digest = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber"))
    p = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / float(1 << 48)
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"))


@query("ranking_metrics_distinct", "n_pos:i n_neg:i auc:d pr_auc:d pr_auc_trapz:d",
       """WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
              CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 12) AS BIGINT) AS p FROM lineitem),
          c AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM s GROUP BY p),
          r AS (SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
                FROM c WINDOW w AS (ORDER BY p DESC))
          SELECT n_pos, n_neg, sum(neg * (tp - pos / 2)) / (n_pos * n_neg) AS auc, sum(pos * tp / (tp + fp)) / n_pos AS pr_auc,
            sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp > pos + neg THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2) / n_pos AS pr_auc_trapz
          FROM r GROUP BY n_pos, n_neg""")
def ranking_metrics_distinct(spark, d):
    return M.ranking_metrics(_distinct(spark, d))


@query("weighted_log_loss", "fold:s loss:d n_valid:i",
       """WITH rows AS (SELECT l_linestatus AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
             (l_discount * 100 - 5) / 2 AS x FROM lineitem)
          SELECT fold, avg(CASE WHEN y = 1 THEN 2.0 * (greatest(-x, 0) + ln(1 + exp(-abs(x))))
                           ELSE greatest(x, 0) + ln(1 + exp(-abs(x))) END) AS loss, count(*) AS n_valid
          FROM rows GROUP BY fold""")
def weighted_log_loss(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_discount") * 100 - 5) / 2).alias("logit"),
    )
    return M.log_loss(rows, ["fold"], pos_weight=2.0)


@query("best_fold_by_average_precision", "fold_index:s metric_value:d rank:i direction:s",
       f"""SELECT fold AS fold_index, pr_auc AS metric_value, row_number() OVER (ORDER BY pr_auc DESC, fold) AS rank,
           'max' AS direction FROM ({_sql_ranking("l_linestatus")})""")
def best_fold_by_average_precision(spark, d):
    return rank_folds(M.ranking_metrics(scored(spark, d, fold=True), ["fold"]), "PR AUC", fold_col="fold")


@query("curve_summary_by_fold",
       "fold:s roc_available:b pr_available:b baseline_positive_rate:d ap:d auprc_trapz:d pr_baseline_mean:d",
       f"""SELECT fold, true AS roc_available, true AS pr_available, n_pos / CAST(n_pos + n_neg AS DOUBLE)
             AS baseline_positive_rate, pr_auc AS ap, pr_auc_trapz AS auprc_trapz,
             avg(n_pos / CAST(n_pos + n_neg AS DOUBLE)) OVER () AS pr_baseline_mean
           FROM ({_sql_ranking("l_linestatus")})""")
def curve_summary_by_fold(spark, d):
    summary = M.curve_summary(scored(spark, d, fold=True), ["fold"])
    return summary.crossJoin(mean_baseline(summary))  # the mean is one row
