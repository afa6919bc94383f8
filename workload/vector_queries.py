"""Embedding, scoring, prediction and cross-validated classifier jobs.

Mapping: embedding rows in id order form sequences of fifty positions; documents
are sequences for the text-driven jobs, with letter codes as a toy embedding.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from spanforge.functions.stats import sigmoid
from spanforge.operators import scoring as V
from spanforge.operators import splits as S
from spanforge.operators.intervals import window_spans
from spanforge.plans.embed import embed_missing, read_index, stored_blocks, stored_vectors
from spanforge.plans.predict import Predictor
from spanforge.plans.train import cross_validate, ensemble_manifest, sweep
from spanforge.session import cut_lineage, shared_folder
from spanforge.sources.models import write_models
from workload import score_queries as SQ
from workload.registry import query, table
from workload.text_queries import SQL_CLEAN, cleaned_documents

DIM = 64
WEIGHTS = [(i - 32) / 16 for i in range(DIM)]


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("id"), (F.col("vec_id") % 50).alias("pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


SQL_VEC = """vec AS (SELECT vec_id // 50 AS id, vec_id % 50 AS pos, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, label FROM embeddings)"""
_SQL_LINEAR = "(list_sum([v[i] * ((i - 33) / 16.0) FOR i IN range(1, 65)]) + 0.25)"


@query("linear_scores", "id:i pos:i p:d",
       f"WITH {SQL_VEC} SELECT id, pos, 1 / (1 + exp(-{_SQL_LINEAR})) AS p FROM vec")
def linear_scores(spark, d):
    return vectors(spark, d).select("id", "pos", sigmoid(V.linear_logit(F.col("vec"), WEIGHTS, 0.25)).alias("p"))


def _hidden(unit: int) -> dict:
    return [((unit + 1) * (i % 5) - 4) / 8 for i in range(DIM)]


DENSE_HEADS = {
    "plain": {"blocks": [{"w": [_hidden(0), _hidden(1)], "b": [0.1, -0.1]}], "w": [1.0, -0.5], "b": 0.05},
    "normed": {
        "blocks": [{"w": [_hidden(0), _hidden(1)], "b": [0.1, -0.1], "gain": [1.0, 2.0], "shift": [0.25, 0.5]},
                   {"w": [[1.0, 0.5], [-0.5, 1.0]], "b": [0.0, 0.2], "skip": "same"}],
        "w": [0.75, 0.25], "b": -0.5,
    },
}
_SQL_HEADS = f"""{SQL_VEC},
    h AS (SELECT id, pos, list_sum([v[i] * (((i - 1) % 5) - 4) / 8.0 FOR i IN range(1, 65)]) + 0.1 AS a,
                 list_sum([v[i] * (2 * ((i - 1) % 5) - 4) / 8.0 FOR i IN range(1, 65)]) - 0.1 AS b FROM vec),
    m AS (SELECT *, (a + b) / 2 AS mu FROM h),
    n AS (SELECT *, sqrt(((a - mu) * (a - mu) + (b - mu) * (b - mu)) / 2 + 0.00001) AS sd FROM m),
    x AS (SELECT id, pos, a, b, greatest(0, (a - mu) / sd + 0.25) AS u, greatest(0, 2 * (b - mu) / sd + 0.5) AS w FROM n),
    z AS (SELECT *, greatest(0, u + 0.5 * w) + u AS s, greatest(0, -0.5 * u + w + 0.2) + w AS t FROM x)"""


@query("dense_scores", "id:i pos:i member:s p:d",
       f"""WITH {_SQL_HEADS}
       SELECT id, pos, 'plain' AS member, 1 / (1 + exp(-(greatest(0, a) - 0.5 * greatest(0, b) + 0.05))) AS p FROM z
       UNION ALL SELECT id, pos, 'normed', 1 / (1 + exp(-(0.75 * s + 0.25 * t - 0.5))) FROM z""")
def dense_scores(spark, d):
    return V.score_dense(vectors(spark, d), DENSE_HEADS)


def _conv(channel: int) -> list:
    return [[(channel + 1) * (k - 1) / 10 + 0.05] * DIM for k in range(3)]


CONV_HEAD = {
    "conv": [{"w": np.array([_conv(0), _conv(1)]).transpose(0, 2, 1).tolist(), "b": [0.1, 0.2]},
             {"w": [[[0.5, 1.0, 0.25], [0.0, -0.5, 0.0]], [[0.25, 0.25, 0.25], [0.1, 0.2, 0.3]]], "b": [0.3, 0.1]}],
    "blocks": [], "w": [0.01] * DIM + [0.5, -0.25], "b": 0.0,
}


@query("conv_scores", "id:i pos:i p:d",
       f"""WITH {SQL_VEC}, s AS (SELECT id, pos, list_sum(v) AS s FROM vec),
       c1 AS (SELECT id, pos, s, greatest(0, 0.1 + (-0.05) * coalesce(lag(s) OVER w, 0) + 0.05 * s
                + 0.15 * coalesce(lead(s) OVER w, 0)) AS a,
              greatest(0, 0.2 + (-0.15) * coalesce(lag(s) OVER w, 0) + 0.05 * s + 0.25 * coalesce(lead(s) OVER w, 0)) AS b
              FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)),
       c2 AS (SELECT id, pos, s, greatest(0, 0.3 + 0.5 * coalesce(lag(a) OVER w, 0) + a + 0.25 * coalesce(lead(a) OVER w, 0)
                - 0.5 * b) AS a,
              greatest(0, 0.1 + 0.25 * (coalesce(lag(a) OVER w, 0) + a + coalesce(lead(a) OVER w, 0))
                + 0.1 * coalesce(lag(b) OVER w, 0) + 0.2 * b + 0.3 * coalesce(lead(b) OVER w, 0)) AS b
              FROM c1 WINDOW w AS (PARTITION BY id ORDER BY pos))
       SELECT id, pos, 1 / (1 + exp(-(0.01 * s + 0.5 * a - 0.25 * b))) AS p FROM c2""")
def conv_scores(spark, d):
    return V.score_conv(vectors(spark, d), {"conv": CONV_HEAD}, block=16)


@query("stitched_vectors", "id:i pos:i n_windows:i first:d total:d",
       f"""WITH {SQL_VEC}, w AS (SELECT id, pos, v, unnest([0, 15, 30]) AS start FROM vec),
       p AS (SELECT id, pos, [x * (1 + start / 100.0) FOR x IN v] AS v FROM w WHERE pos >= start AND pos < start + 20)
       SELECT id, pos, count(*) AS n_windows, avg(v[1]) AS first, avg(list_sum(v)) AS total FROM p GROUP BY id, pos""")
def stitched_vectors(spark, d):
    spans = vectors(spark, d).withColumn("w", F.explode(window_spans(F.lit(50), 20, 15)))
    inside = spans.filter((F.col("pos") >= F.col("w.start")) & (F.col("pos") < F.col("w.stop")))
    scaled = F.transform("vec", lambda x: x * (1 + F.col("w.start") / 100))
    mean = V.average_vectors(inside.select("id", "pos", scaled.alias("vec")))
    return mean.select("id", "pos", "n_windows", F.col("vec")[0].alias("first"),
                       F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


def letter_codes(batch):
    """Toy embedding: letter code and place in the window."""
    out = []
    for text in batch:
        codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(float)
        out.append(np.stack([codes, np.arange(len(codes), dtype=float)], axis=1))
    return out


def sequences(spark, d):
    return cleaned_documents(spark, d).select(F.col("doc_id").alias("id"), "sequence")


_SQL_DOCS = f"docs AS (SELECT doc_id AS id, {SQL_CLEAN} AS s FROM documents)"


@query("embedding_job", "id:i length:i codes:i places:d last_place:d",
       f"""WITH {_SQL_DOCS}, chars AS (SELECT id, length(s) AS n, unnest(range(0, length(s))) AS pos, s FROM docs),
       placed AS (SELECT id, pos, n, ascii(substr(s, pos + 1, 1)) AS code,
         CASE WHEN n <= 1022 THEN pos ELSE list_avg([pos - 900 * k FOR k IN range(0, 1 + CAST(ceil((n - 1000) / 900.0) AS BIGINT))
           IF pos >= 900 * k AND pos < 900 * k + 1000]) END AS place FROM chars)
       SELECT id, count(*) AS length, sum(code) AS codes, sum(place) AS places, arg_max(place, pos) AS last_place
       FROM placed GROUP BY id""")
def embedding_job(spark, d):
    """Vectors are embedded, written, stitched and summed as packed blocks."""
    stitched = V.stitch_blocks(cut_lineage(V.embed_windows(sequences(spark, d), letter_codes)))
    return V.block_totals(stitched).groupBy("id").agg(
        F.sum("n").alias("length"), F.sum(F.col("total")[0]).alias("codes"), F.sum(F.col("total")[1]).alias("places"),
        F.max_by(F.col("last")[1], "start").alias("last_place"),
    )


@query("embedding_index",
       "id:s protein_id:s viral_family:s key_mode:s key_delimiter:s length:i embed_dim:i original_seq_len:i seq_len_feature:s handle:s model:s storage:s file_path:s total:d",
       f"""WITH {_SQL_DOCS}, chars AS (SELECT id, length(s) AS n, unnest(range(0, length(s))) AS pos, s FROM docs),
       placed AS (SELECT id, ascii(substr(s, pos + 1, 1)) + (CASE WHEN n <= 1022 THEN pos ELSE list_avg([pos - 900 * k
           FOR k IN range(0, 1 + CAST(ceil((n - 1000) / 900.0) AS BIGINT)) IF pos >= 900 * k AND pos < 900 * k + 1000]) END) + n AS v FROM chars)
       SELECT id || '-' || (id % 13) AS id, CAST(id AS VARCHAR) AS protein_id, CAST(id % 13 AS VARCHAR) AS viral_family, 'id-family' AS key_mode,
         '-' AS key_delimiter, length(s) AS length, 3 AS embed_dim, length(s) AS original_seq_len, 'raw' AS seq_len_feature,
         CASE WHEN length(s) <= 1022 THEN 'short' ELSE 'long' END AS handle, 'letters' AS model, 'parquet' AS storage,
         CASE WHEN id % 3 = 0 THEN 'blocks/run=first' ELSE 'blocks/run=second' END AS file_path, total
       FROM docs JOIN (SELECT id, sum(v) AS total FROM placed GROUP BY id) USING (id) WHERE length(s) > 0""")
def embedding_index(spark, d):
    """A first run embeds a third of the documents, a second one, given all, the rest."""
    records = table(spark, d, "documents").select(
        F.col("doc_id").alias("protein_id"), (F.col("doc_id") % 13).alias("family"), F.col("text").alias("sequence"))
    store = f"{shared_folder(spark)}/vectors"
    for run, rows in (("first", records.filter("protein_id % 3 = 0")), ("second", records)):
        embed_missing(rows, letter_codes, store, run, feature="raw", model="letters")
    vectors = stored_vectors(stored_blocks(spark, store))
    whole = sum((F.col("vec")[i] for i in range(3)), F.lit(0.0))  # letter, place and length: plain sums, no loop in each row
    totals = vectors.groupBy("id").agg(F.sum(whole).alias("total"))
    within = F.regexp_extract("file_path", "(blocks/run=[^/]*)$", 1)
    return read_index(spark, store).withColumn("file_path", within).join(totals, "id")


def predictor() -> Predictor:
    """Three members: letters from N, from M, and from O on count as positive."""
    def head(cut):
        return {"blocks": [], "w": [1.0, 0.0], "b": -(ord(cut) - 0.5)}

    return Predictor(letter_codes, {"a": head("N"), "b": head("M"), "c": head("O")}, {"a": 0.5, "b": 0.5, "c": 0.5})


@query("batch_prediction", "id:i header:s length:i n_epitopes:i frac_epitope:d votes_needed:i mask_digest:s",
       f"""WITH {_SQL_DOCS}, m AS (SELECT id, regexp_replace(regexp_replace(s, '[A-M]', '0', 'g'), '[N-Z]', '1', 'g') AS mask
             FROM docs WHERE length(s) > 0)
           SELECT id, 'D' || id AS header, length(mask) AS length, length(replace(mask, '0', '')) AS n_epitopes,
             length(replace(mask, '0', '')) / CAST(length(mask) AS DOUBLE) AS frac_epitope, 2 AS votes_needed, md5(mask) AS mask_digest
           FROM m""")
def batch_prediction(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("D"), F.col("doc_id")).alias("header"), F.col("text").alias("sequence")
    )
    results, _ = predictor().predict(docs)
    return results.withColumn("mask_digest", F.md5("binary_mask"))


#: Members of the second set: cut letter, status, threshold in the manifest, and in the checkpoint.
MEMBERS = (("N", "OK", 0.5, 0.9), ("A", "FAILED", 0.5, 0.5), ("M", "OK", 1.5, 0.9), ("O", "OK", None, None), ("A", "OK", 0.5, 0.5))


def _artifact(spark) -> str:
    """A model store, and a manifest of two sets that names its members."""
    folder = shared_folder(spark)
    models = {f"m{i}": {"head": {"blocks": [], "w": [1.0, 0.0], "b": -(ord(cut) - 0.5)}, "threshold": own} for i, (cut, _, _, own) in enumerate(MEMBERS)}
    write_models(spark, f"{folder}/store", models)
    members = [{"fold_index": i, "member_index": 9 - i, "status": status, "threshold": given, "checkpoint": f"{folder}/store/m{i}"}
               for i, (_, status, given, _) in enumerate(MEMBERS)]
    sets = [{"set_index": 1, "members": [members[4]]}, {"set_index": 2, "members": members[::-1]}]
    text = json.dumps({"schema_version": 2, "sets": sets})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    return f"{folder}/manifest.json"


def _manifest_sql(letters: str, members: int, needed: str, limits: str) -> str:
    """Masks where the given letters are positive."""
    return f"""WITH {_SQL_DOCS}, m AS (SELECT id, regexp_replace(regexp_replace(s, '[^{letters}]', '0', 'g'), '[{letters}]', '1', 'g') AS mask
         FROM docs WHERE length(s) > 0)
       SELECT id, 'D' || id AS header, length(mask) AS length, length(replace(mask, '0', '')) AS n_epitopes, 'ensemble-manifest' AS artifact_mode,
         {members} AS n_members, {needed} AS votes_needed, '{limits}' AS member_thresholds, md5(mask) AS mask_digest FROM m"""


_MANIFEST_SPEC = "id:i header:s length:i n_epitopes:i artifact_mode:s n_members:i votes_needed:i member_thresholds:s mask_digest:s"


def _manifest_rows(spark, d, **options):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("D"), F.col("doc_id")).alias("header"), F.col("text").alias("sequence"))
    results, _ = Predictor.from_artifact(spark, _artifact(spark), letter_codes, set_index=2, **options).predict(docs)
    limits = F.array_join(F.transform("member_thresholds", lambda t: t.cast("string")), " ")
    return results.withColumns({"mask_digest": F.md5("binary_mask"), "member_thresholds": limits})


@query("manifest_prediction", _MANIFEST_SPEC, _manifest_sql("O-Z", 3, "2", "0.5 0.9 0.5"))
def manifest_prediction(spark, d):
    """The first three usable members: from N on; from M on at 0.9 (the manifest's 1.5 is none), so from O on; from O on."""
    return _manifest_rows(spark, d, k_folds=3)


@query("manifest_prediction_mean", _MANIFEST_SPEC, _manifest_sql("N-Z", 4, "NULL", "0.6 0.6 0.6 0.6"))
def manifest_prediction_mean(spark, d):
    """All four members at an override of 0.6: their mean is 0.84 at O, 0.70 at N and 0.55 at M."""
    return _manifest_rows(spark, d, aggregation="mean-prob", threshold=0.6)


def labelled_vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") < 3).cast("int").alias("y")
    )


def _folds(spark, d):
    return S.fold_plan(labelled_vectors(spark, d).select("id"), None, n_folds=3, seed=11)


def _priorities(spark, d):
    """Orders with their priority as indicators: a model of these has a closed form."""
    g = F.substring("o_orderpriority", 1, 1).cast("int")
    y = ((F.col("o_orderkey") * 7919) % 100 < 5 + 8 * g).cast("int")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(*[(g == k).cast("double") for k in range(1, 5)]).alias("features"), y.alias("y"))


def _priority_plan(spark, d):
    return S.fold_plan(_priorities(spark, d).select("id"), None, n_folds=3, seed=11)


#: Maximum likelihood of a saturated model: the weighted share of positives of each priority.
_SQL_RUNS = f"""o AS (SELECT *, CASE WHEN (id * 7919) % 100 < 5 + 8 * g THEN 1 ELSE 0 END AS y FROM (
      SELECT o_orderkey AS id, CAST(left(o_orderpriority, 1) AS INT) AS g,
        (row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) - 1) % 3 + 1 AS own FROM orders)),
    tr AS (SELECT f AS run, g, sum(y) AS pos, count(*) - sum(y) AS neg FROM o CROSS JOIN range(1, 4) AS r(f) WHERE own <> f GROUP BY f, g),
    weights AS (SELECT run, sum(pos) AS pos, sum(neg) AS neg, sum(neg) / CAST(sum(pos) AS DOUBLE) AS w FROM tr GROUP BY run),
    fit AS (SELECT run, g, w * tr.pos / (w * tr.pos + tr.neg) AS p FROM tr JOIN weights USING (run)),
    scored AS (SELECT run AS fold, y, p FROM o JOIN fit ON own = run AND o.g = fit.g),
    counts AS (SELECT fold, p AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY fold, p),
    points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS n_pos,
                 sum(neg) OVER (PARTITION BY fold) AS n_neg FROM counts WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
    {SQ.SQL_CANDIDATES},
    pick AS ({SQ._pick("max-recall-min-precision", "CASE WHEN precision >= 0.25 THEN 1 ELSE 0 END DESC, "
             "CASE WHEN precision >= 0.25 THEN recall ELSE precision END DESC, CASE WHEN precision >= 0.25 THEN precision ELSE threshold END DESC, threshold DESC",
             "CASE WHEN precision >= 0.25 THEN 'ok' ELSE 'min_precision_unreachable' END")}),
    ranked AS (SELECT fold, sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) AS auc,
                 sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(n_pos) AS pr_auc FROM points GROUP BY fold),
    loss AS (SELECT fold, avg(CASE WHEN y = 1 THEN -w * ln(p) ELSE -ln(1 - p) END) AS loss FROM scored JOIN weights ON run = fold GROUP BY fold)"""


@query("cross_validated_runs",
       "RunIndex:i TrainMode:s EnsembleSetIndex:i FoldIndex:i NFolds:i SplitSeed:i TrainProteins:i TrainPosResidues:i TrainNegResidues:i ValProteins:i "
       "ValPosResidues:i ValPositiveRate:d BestMetricKey:s BestMetricValue:d BestValLoss:d Threshold:d ThresholdStatus:s ThresholdMinPrecision:d "
       "ThresholdPredPosFrac:d PR_AUC:d F1:d MCC:d AUC:d Status:s n_columns:i",
       f"""WITH {_SQL_RUNS} SELECT pick.fold AS RunIndex, 'ensemble-kfold' AS TrainMode, 1 AS EnsembleSetIndex, pick.fold AS FoldIndex, 3 AS NFolds, 11 AS SplitSeed,
             weights.pos + weights.neg AS TrainProteins, weights.pos AS TrainPosResidues, weights.neg AS TrainNegResidues, tp + fp + tn + fn AS ValProteins,
             tp + fn AS ValPosResidues, (tp + fn) / CAST(tp + fp + tn + fn AS DOUBLE) AS ValPositiveRate, 'pr_auc' AS BestMetricKey, pr_auc AS BestMetricValue,
             loss AS BestValLoss, threshold AS Threshold, status AS ThresholdStatus, 0.25 AS ThresholdMinPrecision,
             (tp + fp) / CAST(tp + fp + tn + fn AS DOUBLE) AS ThresholdPredPosFrac, pr_auc AS PR_AUC, f1 AS F1, mcc AS MCC, auc AS AUC, 'OK' AS Status, 51 AS n_columns
           FROM pick JOIN ranked USING (fold) JOIN loss USING (fold) JOIN weights ON run = fold""")
def cross_validated_runs(spark, d):
    """Three runs fitted together, against the closed form of their model."""
    rows, _ = cross_validate(_priorities(spark, d), _priority_plan(spark, d), params={"regParam": 0.0})
    return rows.withColumn("n_columns", F.lit(len(rows.columns)))


@query("cross_validated_scores", "run_index:i y:i p:d n:i",
       f"WITH {_SQL_RUNS} SELECT fold AS run_index, y, round(p, 8) AS p, count(*) AS n FROM scored GROUP BY fold, y, round(p, 8)")
def cross_validated_scores(spark, d):
    scored = cross_validate(_priorities(spark, d), _priority_plan(spark, d), params={"regParam": 0.0})[1]
    return scored.groupBy("run_index", "y", F.round("p", 8).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("cross_validation_coverage", "n_scored:i n_ids:i n_runs:i",
       "SELECT count(*) AS n_scored, count(DISTINCT vec_id) AS n_ids, 3 AS n_runs FROM embeddings")
def cross_validation_coverage(spark, d):
    scored = cross_validate(labelled_vectors(spark, d), _folds(spark, d))[1]
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.count_distinct("id").alias("n_ids"),
                      F.count_distinct("run_index").alias("n_runs"))


@query("ensemble_manifest", "schema_version:i n_folds:i n_members:i n_valid_members:i metric:s member:i checkpoint:s fold_index:i threshold:d best:d status:s",
       f"""WITH {_SQL_RUNS} SELECT 1 AS schema_version, 3 AS n_folds, 3 AS n_members, 3 AS n_valid_members, 'pr_auc' AS metric, fold AS member,
             'run_00' || fold AS checkpoint, fold AS fold_index, threshold, pr_auc AS best, 'OK' AS status FROM pick JOIN ranked USING (fold)""")
def manifest(spark, d):
    """The manifest document of the runs, taken apart again."""
    rows, _ = cross_validate(_priorities(spark, d), _priority_plan(spark, d), params={"regParam": 0.0})
    document = ensemble_manifest(rows, n_folds=3, policy="max-recall-min-precision", metric="pr_auc")
    member = "struct<member_index:int,fold_index:int,checkpoint:string,threshold:double,best_metric_value:double,status:string>"
    schema = f"struct<schema_version:int,n_folds:int,n_members:int,n_valid_members:int,best_model_metric:string,members:array<{member}>>"
    parsed = document.select(F.from_json("value", schema).alias("m")).select("m.*")
    return parsed.select("schema_version", "n_folds", "n_members", "n_valid_members", F.col("best_model_metric").alias("metric"), F.explode("members").alias("x")).select(
        "*", F.col("x.member_index").alias("member"), "x.checkpoint", "x.fold_index", "x.threshold", F.col("x.best_metric_value").alias("best"), "x.status")


@query("parameter_sweep", "trial:i score:d state:s rung:i rivals:i n_params:i",
       f"""WITH {_SQL_RUNS}, m AS (SELECT avg(pr_auc) AS score FROM ranked)
           SELECT trial, score, CASE WHEN trial < 2 THEN 'COMPLETE' ELSE 'PRUNED' END AS state, CASE WHEN trial < 2 THEN 2 ELSE 1 END AS rung,
             CASE WHEN trial < 2 THEN 2 ELSE 6 END AS rivals, 1 AS n_params FROM m CROSS JOIN range(6) AS r(trial)""")
def parameter_sweep(spark, d):
    """Six drawn penalties, all too small to change the order of five priorities: all tie, two go on by their number."""
    rows, _ = sweep(_priorities(spark, d), _priority_plan(spark, d), {"regParam": ("log", 1e-8, 1e-6)}, n_trials=6, rungs=(4, 20))
    return rows.withColumn("n_params", F.size(F.from_json("params", "map<string,double>")))
