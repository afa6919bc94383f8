"""Votes, payloads, member resolution, selection, and paired model statistics.

Mapping: users are sequences, their events positions, and five members score
every position by a fixed mixing rule; purchases are positives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.stats import prevalence_lift
from spanforge.operators import ensemble as E
from spanforge.operators import metrics as M
from spanforge.operators import paired as P
from spanforge.plans.analyse import fold_metrics, seed_metrics
from spanforge.plans.evaluate import protein_counters, scored_rows
from workload import score_queries as SQ
from workload.registry import query, table

THRESHOLDS = {"1": 0.5, "2": 0.45, "3": 0.55, "4": 0.6, "5": 0.4}


def member_scores(spark, d, n=5):
    mix = (F.col("event_id") * 7919 + F.col("user_id") * 31 + F.col("m") * 104729 * (F.col("event_id") % 13 + 1)) % 512
    rows = table(spark, d, "events").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("pos"),
        F.col("m").cast("string").alias("member"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (mix / 512).alias("p"),
    )


def _sql_members(n: int) -> str:
    values = ", ".join(f"({m}, {THRESHOLDS[str(m)]})" for m in range(1, n + 1))
    return f"""members(m, t) AS (VALUES {values}),
    scores AS (SELECT user_id AS id, event_id AS pos, m, CAST(t AS DOUBLE) AS t,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
        ((event_id * 7919 + user_id * 31 + m * 104729 * (event_id % 13 + 1)) % 512) / CAST(512 AS DOUBLE) AS p
        FROM events CROSS JOIN members),
    voted AS (SELECT id, pos, max(y) AS y, avg(p) AS p, count(*) FILTER (WHERE p >= t) AS votes FROM scores GROUP BY id, pos)"""


VOTE_SPEC = "id:i pos:i p:d votes:i pred:i"


@query("ensemble_majority", VOTE_SPEC,
       f"WITH {_sql_members(5)} SELECT id, pos, p, votes, CASE WHEN votes >= 3 THEN 1 ELSE 0 END AS pred FROM voted")
def ensemble_majority(spark, d):
    return E.vote(member_scores(spark, d), THRESHOLDS)


@query("ensemble_even_tie", VOTE_SPEC,
       f"WITH {_sql_members(4)} SELECT id, pos, p, votes, CASE WHEN votes >= 3 THEN 1 ELSE 0 END AS pred FROM voted")
def ensemble_even_tie(spark, d):
    four = {k: v for k, v in THRESHOLDS.items() if k != "5"}
    return E.vote(member_scores(spark, d, 4), four)


@query("ensemble_mean_probability", VOTE_SPEC,
       f"WITH {_sql_members(4)} SELECT id, pos, p, votes, CASE WHEN p >= 0.51 THEN 1 ELSE 0 END AS pred FROM voted")
def ensemble_mean_probability(spark, d):
    four = {k: v for k, v in THRESHOLDS.items() if k != "5"}
    return E.vote(member_scores(spark, d, 4), four, aggregation="mean-prob", ensemble_threshold=0.51)


@query("prediction_payload",
       "id:i binary_mask:s length:i n_epitopes:i frac_epitope:d p_epitope_mean:d p_epitope_max:d threshold:d",
       f"""WITH {_sql_members(5)} SELECT id, string_agg(CASE WHEN votes >= 3 THEN '1' ELSE '0' END, '' ORDER BY pos)
             AS binary_mask, count(*) AS length, count(*) FILTER (WHERE votes >= 3) AS n_epitopes,
             count(*) FILTER (WHERE votes >= 3) / CAST(count(*) AS DOUBLE) AS frac_epitope, avg(p) AS p_epitope_mean,
             max(p) AS p_epitope_max, NULL AS threshold FROM voted GROUP BY id""")
def prediction_payload(spark, d):
    return E.prediction_payload(ensemble_majority(spark, d))


@query("batch_totals", "processed:i total_residues:i total_epitopes:i failed:i",
       f"""WITH {_sql_members(5)} SELECT count(DISTINCT id) AS processed, count(*) AS total_residues,
             count(*) FILTER (WHERE votes >= 3) AS total_epitopes, (SELECT count(*) FROM customer) AS failed FROM voted""")
def batch_totals(spark, d):
    return E.batch_totals(prediction_payload(spark, d), table(spark, d, "customer"))


_SQL_EVALUATION = f"""{_sql_members(5)},
    scored AS (SELECT 'ensemble' AS fold, y, p, CASE WHEN votes >= 3 THEN 1 ELSE 0 END AS pred FROM voted
               UNION ALL SELECT CAST(m AS VARCHAR), y, p, CASE WHEN p >= t THEN 1 ELSE 0 END FROM scores),
    cm AS (SELECT fold, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
           count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn
           FROM scored GROUP BY fold),
    counts AS (SELECT fold, round(p, 12) AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
               FROM scored GROUP BY fold, round(p, 12)),
    points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS n_pos,
               sum(neg) OVER (PARTITION BY fold) AS n_neg
               FROM counts WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
    ranked AS (SELECT fold, sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) AS auc,
               sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(n_pos) AS pr_auc FROM points GROUP BY fold)"""


@query("ensemble_evaluation", "member:s tp:i fp:i tn:i fn:i precision:d recall:d f1:d mcc:d auc:d pr_auc:d",
       f"""WITH {_SQL_EVALUATION} SELECT cm.fold AS member, {SQ.SQL_ROW.replace("threshold, ", "")}, auc, pr_auc
           FROM cm JOIN ranked USING (fold)""")
def ensemble_evaluation(spark, d):
    rows = scored_rows(member_scores(spark, d), THRESHOLDS)
    return M.evaluate(rows, ["member"])


@query("best_member", "fold_index:s metric_value:d rank:i",
       f"""WITH {_SQL_EVALUATION} SELECT fold AS fold_index, auc AS metric_value, row_number() OVER (ORDER BY auc DESC, fold)
             AS rank FROM ranked WHERE fold <> 'ensemble'""")
def best_member(spark, d):
    members = E.member_predictions(member_scores(spark, d), THRESHOLDS)
    return E.rank_folds(M.evaluate(members, ["member"]), "auc", fold_col="member")


@query("protein_counters", "processed_proteins:i proteins_with_valid_residues:i proteins_zero_valid_residues:i",
       """WITH s AS (SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag <> 'A') AS v FROM orders
            LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
          SELECT count(*) AS processed_proteins, count(*) FILTER (WHERE v > 0) AS proteins_with_valid_residues,
            count(*) FILTER (WHERE v = 0) AS proteins_zero_valid_residues FROM s""")
def evaluation_counters(spark, d):
    per = table(spark, d, "lineitem").filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("v")
    )
    rows = table(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    return protein_counters(rows.select(F.coalesce("v", F.lit(0)).alias("valid_residues")))


# --- members and selection -------------------------------------------------


@query("manifest_members", "path:s set_index:i member:i checkpoint:s fold_index:i member_index:i threshold:d",
       """WITH m AS (SELECT s_nationkey, s_suppkey, '/runs/n' || s_nationkey || '/manifest.json' AS path,
             CASE WHEN s_suppkey % 5 = 0 THEN '/abs/c' || s_suppkey ELSE '/runs/n' || s_nationkey || '/c' || s_suppkey END AS checkpoint,
             CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 4 END AS fold_index, s_suppkey AS member_index,
             CASE WHEN s_acctbal > 0 AND s_acctbal < 5000 THEN s_acctbal / 5000 END AS threshold
             FROM supplier WHERE s_suppkey % 7 <> 2 AND s_suppkey % 11 <> 4)
          SELECT path, 2 AS set_index, row_number() OVER (PARTITION BY path ORDER BY fold_index NULLS LAST, member_index) AS member,
            checkpoint, fold_index, member_index, threshold FROM m""")
def manifest_members(spark, d):
    k = F.col("s_suppkey")
    member = F.struct(
        F.when(k % 7 == 2, "FAILED").when(k % 2 == 0, " ok ").otherwise("OK").alias("status"),
        F.when(k % 11 != 4, F.when(k % 5 == 0, F.concat(F.lit("/abs/c"), k)).otherwise(F.concat(F.lit("c"), k)))
        .alias("checkpoint"),
        F.when(k % 3 != 0, k % 4).alias("fold_index"),
        k.alias("member_index"),
        (F.col("s_acctbal") / 5000).alias("threshold"),
    )
    other = F.array(F.struct(F.lit(1).alias("set_index"), F.array().cast(_member_array(spark)).alias("members")))
    documents = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(member).alias("members")).select(
        F.concat(F.lit("/runs/n"), F.col("s_nationkey"), F.lit("/manifest.json")).alias("path"),
        F.to_json(F.struct(
            F.lit(2).alias("schema_version"),
            F.concat(other, F.array(F.struct(F.lit(2).alias("set_index"), F.col("members").cast(_member_array(spark)).alias("members"))))
            .alias("sets"),
        )).alias("value"),
    )
    return E.resolve_members(E.parse_manifest(documents, set_index=2))


def _member_array(spark):
    return ("array<struct<status:string,checkpoint:string,fold_index:bigint,member_index:bigint,threshold:double>>")


@query("decision_thresholds", "s_suppkey:i threshold:d",
       """SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_acctbal < 5000 THEN s_acctbal / 5000
            WHEN s_nationkey > 0 AND s_nationkey < 10 THEN s_nationkey / 10.0 ELSE 0.5 END AS threshold FROM supplier""")
def decision_thresholds(spark, d):
    manifest, checkpoint = F.col("s_acctbal") / 5000, F.col("s_nationkey") / 10
    return table(spark, d, "supplier").select("s_suppkey", E.decision_threshold(None, manifest, checkpoint).alias("threshold"))


_SQL_RUNS = """runs AS (SELECT l_suppkey % 10 AS set_index, avg(l_discount) AS m FROM lineitem WHERE l_suppkey % 6 <> 1
    GROUP BY l_suppkey)"""


@query("ranked_sets", "set_index:i aggregate_metric:d rank:i direction:s",
       f"""WITH {_SQL_RUNS}, s AS (SELECT set_index, median(m) AS aggregate_metric FROM runs GROUP BY set_index)
           SELECT *, row_number() OVER (ORDER BY aggregate_metric, set_index) AS rank, 'min' AS direction FROM s""")
def ranked_sets(spark, d):
    runs = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("BestValLoss")).select(
        (F.col("l_suppkey") % 10).alias("EnsembleSetIndex"),
        "BestValLoss",
        F.when(F.col("l_suppkey") % 6 == 1, "FAIL").otherwise(" ok").alias("Status"),
    )
    return E.rank_sets(runs, "best_val_loss", agg="median")


@query("best_epochs", "run:i epoch:i score:d loss:d",
       """WITH e AS (SELECT l_suppkey AS run, l_linenumber AS epoch, floor(avg(l_discount) * 400) AS score, avg(l_tax) AS loss
            FROM lineitem GROUP BY ALL)
          SELECT run, epoch, score, loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, loss, epoch)
            AS rn FROM e) WHERE rn = 1""")
def best_epochs(spark, d):
    epochs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.floor(F.avg("l_discount") * 400).cast("double").alias("score"), F.avg("l_tax").alias("loss")
    )
    return E.best_epochs(epochs, ["run"])


@query("best_trial", "trial:i score:d",
       """SELECT c_custkey AS trial, c_acctbal AS score FROM customer WHERE c_nationkey % 3 = 0 AND c_acctbal < 9000
          ORDER BY c_acctbal DESC, c_custkey LIMIT 1""")
def best_trial(spark, d):
    trials = table(spark, d, "customer").select(
        F.col("c_custkey").alias("trial"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_acctbal")).otherwise(float("inf")).alias("score"),
        F.when(F.col("c_nationkey") % 3 == 0, "COMPLETE").otherwise("PRUNED").alias("state"),
    )
    return E.best_trial(trials)


def _fold_curves(spark, d):
    k = F.col("s_suppkey")
    runs = table(spark, d, "supplier").select(
        F.lit(1).alias("set_index"),
        (k % 20).alias("fold_index"),
        k.alias("run_index"),
        F.when(k % 9 == 5, "NO_VALID_SCORE").otherwise("OK").alias("status"),
        (F.col("s_nationkey") % 4 - 1).alias("best_epoch"),
    )
    curves = table(spark, d, "supplier").filter(k % 3 != 0).select(
        k.alias("run_index"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"),
        (F.col("s_acctbal") / 10000).alias("baseline_positive_rate"),
    )
    return E.fold_curves(runs, curves)


_SQL_FOLD_CURVES = """r AS (SELECT s_suppkey % 20 AS fold_index, s_suppkey AS run_index, s_nationkey % 4 - 1 AS best_epoch, s_acctbal,
      CASE WHEN s_suppkey % 9 = 5 THEN 'status=NO_VALID_SCORE' WHEN s_nationkey % 4 = 0 THEN 'invalid best epoch'
           WHEN s_suppkey % 3 = 0 THEN 'missing curve' END AS warning FROM supplier),
    placed AS (SELECT * EXCLUDE (warning), CASE WHEN run_index > min(run_index) FILTER (WHERE warning IS NULL)
      OVER (PARTITION BY fold_index) THEN 'fold has several runs' ELSE warning END AS warning FROM r)"""


@query("fold_curves", "fold_index:i run_index:i best_epoch:i baseline_positive_rate:d",
       f"""WITH {_SQL_FOLD_CURVES} SELECT fold_index, run_index, best_epoch, s_acctbal / 10000 AS baseline_positive_rate
           FROM placed WHERE warning IS NULL""")
def fold_curves(spark, d):
    return _fold_curves(spark, d)[0]


@query("fold_curve_warnings", "fold_index:i run_index:i warning:s",
       f"""WITH {_SQL_FOLD_CURVES} SELECT fold_index, run_index, warning FROM placed WHERE warning IS NOT NULL""")
def fold_curve_warnings(spark, d):
    return _fold_curves(spark, d)[1]


# --- paired statistics -----------------------------------------------------


def long_rows(spark, d):
    items = table(spark, d, "lineitem").join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("set_index")), "l_suppkey"
    )
    wide = items.groupBy(F.col("l_returnflag").alias("model"), "set_index").agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    return P.long_metrics(wide, ["discount", "tax"], "model", "set_index")


_SQL_LONG = """wide AS (SELECT l_returnflag AS model, s_nationkey AS set_index, avg(l_discount) AS discount, avg(l_tax) AS tax
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    long AS (SELECT model, set_index, 'discount' AS metric, discount AS value FROM wide
             UNION ALL SELECT model, set_index, 'tax', tax FROM wide)"""


@query("model_summary", "model:s metric:s n:i mean:d std:d",
       f"""WITH {_SQL_LONG} SELECT model, metric, count(*) AS n, avg(value) AS mean,
             CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS std FROM long GROUP BY model, metric""")
def model_summary(spark, d):
    return P.model_summary(long_rows(spark, d))


_B = 1000


@query("paired_model_statistics",
       "metric:s n_pairs:i mean_diff_b_minus_a:d median_diff_b_minus_a:d bootstrap_ci95_low:d bootstrap_ci95_high:d "
       "sign_test_pvalue:d sets:s",
       f"""WITH {_SQL_LONG}, diffs AS (SELECT a.metric, a.set_index, b.value - a.value AS diff FROM long a JOIN long b
             USING (metric, set_index) WHERE a.model = 'A' AND b.model = 'R'),
           packed AS (SELECT metric, list(diff ORDER BY set_index) AS v, count(*) AS n FROM diffs GROUP BY metric),
           draws AS (SELECT metric, rep, list_avg([v[1 + CAST(('0x' || substr(md5('42:' || metric || ':' || rep || ':' || s), 1, 8))
               AS BIGINT) % n] FOR s IN range(0, n)]) AS mean FROM packed CROSS JOIN range({_B}) AS r(rep)),
           ci AS (SELECT metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM draws GROUP BY metric),
           base AS (SELECT metric, count(*) AS n_pairs, avg(diff) AS mean_d, median(diff) AS median_d,
               count(*) FILTER (WHERE diff > 0) AS wins, count(*) FILTER (WHERE diff < 0) AS losses,
               string_agg(CAST(set_index AS VARCHAR), ',' ORDER BY set_index) AS sets FROM diffs GROUP BY metric)
           SELECT metric, n_pairs, mean_d AS mean_diff_b_minus_a, median_d AS median_diff_b_minus_a, lo AS bootstrap_ci95_low,
             hi AS bootstrap_ci95_high, least(1.0, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1)
               - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)) FOR i IN range(0, least(wins, losses) + 1)]))
               AS sign_test_pvalue, sets
           FROM base JOIN ci USING (metric)""")
def paired_model_statistics(spark, d):
    out = P.paired_summary(long_rows(spark, d), "A", "R", n_bootstrap=_B)
    return out.withColumn("sets", F.array_join(F.transform("paired_sets", lambda s: s.cast("string")), ","))


@query("numeric_summary", "segment:s count:i mean:d std:d min:d max:d",
       """SELECT c_mktsegment AS segment, count(*) FILTER (WHERE ok) AS count, avg(c_acctbal) FILTER (WHERE ok) AS mean,
            CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN 0 ELSE stddev_samp(c_acctbal) FILTER (WHERE ok) END AS std,
            min(c_acctbal) FILTER (WHERE ok) AS min, max(c_acctbal) FILTER (WHERE ok) AS max
          FROM (SELECT *, c_custkey % 5 > 1 AS ok FROM customer) GROUP BY c_mktsegment""")
def numeric_summary(spark, d):
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("-inf")).otherwise(F.col("c_acctbal"))
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), value.alias("v"))
    return M.numeric_summary(rows, "v", ["segment"])


@query("prevalence_lift", "source:s prevalence:d lift:d",
       """SELECT source, avg(quality) AS prevalence, CASE WHEN sum(quality) > 0 THEN 0.9 / avg(quality) END AS lift
          FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def prevalence(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        F.sum("quality").alias("pos"), F.count_if(F.col("quality") == 0).alias("neg")
    )
    return rows.select("source", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("prevalence"),
                       prevalence_lift(F.lit(0.9), F.col("pos"), F.col("neg")).alias("lift"))


def _result_documents(spark, d):
    """Per-model, per-set result documents derived from line items."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 10).alias("set_index")).agg(
        F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.count_if(F.col("l_quantity") > 25).alias("pos"),
        F.count_if(F.col("l_quantity") <= 25).alias("neg"),
    )

    def scores(x):
        names = ("auc", "pr_auc", "pr_auc_trapz", "precision", "recall", "f1", "mcc")
        return F.struct(*[x.alias(n) for n in names], F.col("pos").cast("double").alias("support_pos"),
                        F.col("neg").cast("double").alias("support_neg"))

    fold = F.struct(F.lit(2.0).alias("fold_index"), scores(F.col("b")).alias("metrics"))
    evaluation = F.struct(F.col("pos").alias("valid_residues"), F.col("pos").alias("pos_residues"), F.col("neg").alias("neg_residues"),
                          scores(F.col("a")).alias("metrics"), fold.alias("best_fold"), F.array(fold, fold).alias("folds"))
    evaluations = items.select("model", "set_index", F.struct(F.lit(5.0).alias("n_members"), evaluation.alias("evaluation")).alias("d"))
    confusion = F.struct(*[F.col("pos").alias(n) for n in ("tp", "fp", "tn", "fn")], F.col("a").alias("precision"),
                         F.col("b").alias("recall"), F.col("a").alias("accuracy"))
    comparison = F.struct(F.col("pos").alias("n_rows_compared"), F.col("pos").alias("n_reactive"), F.col("neg").alias("n_nonreactive"),
                          F.col("a").alias("exact_match_rate"), F.col("b").alias("mean_pred_ones_overall"),
                          confusion.alias("confusion_peptide_any_positive"))
    comparisons = items.filter(F.col("set_index") != 3).select("model", "set_index", comparison.alias("d"))
    return evaluations, comparisons


_SQL_DOCS = """items AS (SELECT l_returnflag AS model, l_suppkey % 10 AS set_index, avg(l_discount) AS a, avg(l_tax) AS b,
    count(*) FILTER (WHERE l_quantity > 25) AS pos, count(*) FILTER (WHERE l_quantity <= 25) AS neg FROM lineitem GROUP BY ALL)"""


@query("seed_metrics", "model:s set_index:i prevalence:d overall_pr_lift:d best_fold_pr_lift:d best_fold_index:i peptide_n_rows:i peptide_f1:d",
       f"""WITH {_SQL_DOCS} SELECT model, set_index, pos / CAST(pos + neg AS DOUBLE) AS prevalence,
             a / (pos / CAST(pos + neg AS DOUBLE)) AS overall_pr_lift, b / (pos / CAST(pos + neg AS DOUBLE)) AS best_fold_pr_lift,
             2 AS best_fold_index, CASE WHEN set_index <> 3 THEN pos END AS peptide_n_rows,
             CASE WHEN set_index <> 3 THEN 2 * a * b / (a + b) END AS peptide_f1 FROM items""")
def seed_metric_rows(spark, d):
    return seed_metrics(*_result_documents(spark, d))


@query("fold_metrics", "model:s set_index:i fold_index:i auc:d mcc:d",
       f"WITH {_SQL_DOCS} SELECT model, set_index, 2 AS fold_index, b AS auc, b AS mcc FROM items CROSS JOIN range(2)")
def fold_metric_rows(spark, d):
    return fold_metrics(_result_documents(spark, d)[0])
