"""Whole jobs: what they write is read back, with the order it stands in."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.text import build_fullname
from spanforge.operators import quality as Q
from spanforge.operators.ranking import ordered_rank
from spanforge.plans.analyse import analyse
from spanforge.plans.evaluate import evaluate_ensemble
from spanforge.plans.label import LABEL_COLUMNS, build_labels
from spanforge.session import cut_lineage, shared_folder
from spanforge.sources.fasta import read_fasta
from spanforge.sources.sinks import strict_json
from workload import assay_queries as AQ
from workload import ensemble_queries as EQ
from workload import interval_queries as IQ
from workload.registry import query, table


def _in_file_order(rows, order):
    """0-based place of rows that were read from the sorted parts of one folder."""
    placed = ordered_rank(cut_lineage(rows), order, out="place")
    return placed.withColumn("place", F.col("place") - 1)


@query("prepared_files", "kind:s ProteinID:s AlignStart:i CodeName:s digest:s place:i",
       f"""WITH {AQ.SQL_LISTED}, {AQ.SQL_CONTRACT}, t AS (SELECT DISTINCT ProteinID, FullName, md5(s) AS digest FROM contract JOIN docs ON ProteinID = 'D' || doc_id)
           SELECT 'labels' AS kind, ProteinID, AlignStart, CodeName, NULL AS digest,
             row_number() OVER (ORDER BY ProteinID, AlignStart, CodeName) - 1 AS place FROM contract
           UNION ALL SELECT 'targets', FullName, NULL, NULL, digest, row_number() OVER (ORDER BY ProteinID) - 1 FROM t""")
def prepared_files(spark, d):
    """The contract's tables and its FASTA file, written and read in the order of their lines."""
    path = f"{shared_folder(spark)}/prepared"
    AQ.prepared(spark, d).write(path)
    lines = spark.read.option("header", True).option("sep", "\t").csv(f"{path}/prepared_labels_metadata.tsv").select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    labels = _in_file_order(lines, [F.col("file"), F.col("block"), F.col("row")]).select(
        F.lit("labels").alias("kind"), "ProteinID", F.col("AlignStart").cast("bigint").alias("AlignStart"), "CodeName",
        F.lit(None).cast("string").alias("digest"), "place")
    records = read_fasta(spark, f"{path}/prepared_targets.fasta")
    order = [F.col(f"source_order.{c}") for c in ("file", "block", "row")]
    targets = _in_file_order(records, order).select(
        F.lit("targets").alias("kind"), F.col("header").alias("ProteinID"), F.lit(None).cast("bigint").alias("AlignStart"),
        F.lit(None).cast("string").alias("CodeName"), F.md5("sequence").alias("digest"), "place")
    return labels.unionByName(targets)


def _contract(spark, d):
    """The line items as a prepared contract over orders of known length."""
    rows = IQ.intervals(spark, d)
    pid = F.col("id").cast("string")
    return rows.select(
        F.concat(F.lit("P"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber"), F.lit("_"), F.col("id")).alias("CodeName"),
        build_fullname(pid, F.col("id") % 11).alias("FullName"),
        F.lit("ACD").alias("Peptide"), F.col("start").alias("AlignStart"), F.col("stop").alias("AlignStop"),
        *[(F.col("label") == label).cast("int").alias(c) for c, label in zip(LABEL_COLUMNS, ("def", "uncertain", "not"))])


@query("label_store", "kind:s id:s label:s n:i",
       f"""WITH {IQ.SQL_POS}, own AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
           SELECT 'positions' AS kind, CAST(id AS VARCHAR) AS id, label, count(*) AS n FROM positions JOIN own USING (id) GROUP BY id, label
           UNION ALL SELECT 'peptides', CAST(l_orderkey AS VARCHAR), CAST(l_orderkey % 11 AS VARCHAR), count(*) FROM lineitem GROUP BY l_orderkey
           UNION ALL SELECT 'stats', NULL, label, count(*) FROM positions JOIN own USING (id) WHERE label <> 'uncertain' GROUP BY label""")
def label_store(spark, d):
    """A label build, written and read back: positions by id and class, peptides and family by id, class counts."""
    path = f"{shared_folder(spark)}/labels"
    lengths = IQ.lengths(spark, d).select(F.col("id").cast("string").alias("id"), "length")
    build_labels(_contract(spark, d), lengths).write(path)
    size = F.col("stop") - F.col("start")
    positions = spark.read.parquet(f"{path}/labels").groupBy("id", "label").agg(F.sum(size).alias("n")).select(F.lit("positions").alias("kind"), "*")
    peptides = spark.read.parquet(f"{path}/proteins").select(
        F.lit("peptides").alias("kind"), "id", F.col("tax_info.family").alias("label"), F.size("peptides").alias("n"))
    stats = spark.read.parquet(f"{path}/class_stats").select(F.inline(F.array(
        F.struct(F.lit("stats").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("def").alias("label"), F.col("pos_count").alias("n")),
        F.struct(F.lit("stats").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("not").alias("label"), F.col("neg_count").alias("n")))))
    return positions.unionByName(peptides).unionByName(stats)


@query("one_hot_labels", "code:s label:s",
       f"""WITH {IQ.SQL_ITEMS} SELECT 'P' || l_partkey || '_' || l_linenumber || '_' || id AS code, label FROM items""")
def one_hot_labels(spark, d):
    """Every row of the contract is checked to be one-hot on its way to a class."""
    rows = Q.check_one_hot(_contract(spark, d), LABEL_COLUMNS, "CodeName")
    return rows.select(F.col("CodeName").alias("code"), Q.label_class(F.col("`Def epitope`"), F.col("`Not epitope`")).alias("label"))


@query("analysed_documents", "kind:s model:s set_index:i fold_index:i a:d b:d missing:s",
       f"""WITH {EQ._SQL_DOCS}, i AS (SELECT * FROM items WHERE set_index BETWEEN 1 AND 4)
           SELECT 'seed' AS kind, model, set_index, 2 AS fold_index, a, CASE WHEN set_index <> 3 THEN 2 * a * b / (a + b) END AS b, NULL AS missing FROM i
           UNION ALL SELECT 'fold', model, set_index, 2, b, b, NULL FROM i CROSS JOIN range(2)
           UNION ALL SELECT 'warning', model, 3, NULL, NULL, NULL, 'comparison' FROM i WHERE set_index = 3
           UNION ALL SELECT DISTINCT 'warning', model, 5, NULL, NULL, NULL, 'evaluation' FROM i""")
def analysed_documents(spark, d):
    """Result documents as JSON files per model and set, read back by the analysis job; sets 3 and 5 lack one."""
    base = shared_folder(spark)
    evaluations, comparisons = (cut_lineage(rows) for rows in EQ._result_documents(spark, d))
    models = sorted(r["model"] for r in evaluations.select("model").distinct().collect())
    for rows, name in ((evaluations, "evaluation.json"), (comparisons, "comparison.json")):
        for model in models:
            for number in range(1, 5):
                document = rows.filter((F.col("model") == model) & (F.col("set_index") == number)).select("d.*")
                if (name, number) != ("comparison.json", 3):
                    strict_json(document).coalesce(1).write.text(f"{base}/{model}/set_{number:02d}/{name}")
    out = analyse(spark, base, models, evaluation_file="evaluation.json", comparison_file="comparison.json", first=1, last=5)
    null = lambda kind: F.lit(None).cast(kind)
    seeds = out["seed_metrics"].select(
        F.lit("seed").alias("kind"), "model", "set_index", F.col("best_fold_index").cast("int").alias("fold_index"),
        F.col("overall_auc").alias("a"), F.col("peptide_f1").alias("b"), null("string").alias("missing"))
    folds = out["fold_metrics"].select(
        F.lit("fold").alias("kind"), "model", "set_index", F.col("fold_index").cast("int").alias("fold_index"), F.col("auc").alias("a"),
        F.col("mcc").alias("b"), null("string").alias("missing"))
    warnings = out["warnings"].select(
        F.lit("warning").alias("kind"), "model", "set_index", null("int").alias("fold_index"), null("double").alias("a"), null("double").alias("b"), "missing")
    return seeds.unionByName(folds).unionByName(warnings)


_SQL_GRID = "(SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) AS threshold)"


@query("evaluated_ensemble", "kind:s member:s spot:d x:d y:d",
       f"""WITH {EQ._SQL_EVALUATION}, grid AS {_SQL_GRID},
           pts AS (SELECT fold, threshold, tp / CAST(n_pos AS DOUBLE) AS recall, tp / CAST(tp + fp AS DOUBLE) AS precision, n_pos, n_neg FROM points),
           pr AS (SELECT fold, threshold, recall AS x, precision AS y FROM pts UNION ALL SELECT DISTINCT fold, CAST('Infinity' AS DOUBLE), 0.0, 1.0 FROM pts),
           idx AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY threshold DESC) - 1 AS spot FROM pr)
           SELECT 'grid' AS kind, fold AS member, threshold AS spot, count(*) FILTER (WHERE y = 1 AND p >= threshold) AS x,
             count(*) FILTER (WHERE y = 0 AND p >= threshold) AS y FROM scored, grid GROUP BY fold, threshold
           UNION ALL SELECT 'pr', fold, spot, x, y FROM idx
           UNION ALL SELECT 'result', fold, NULL, auc, pr_auc FROM ranked""")
def evaluated_ensemble(spark, d):
    """The evaluation job over an ensemble and its members: grid, PR curve and ranking metrics."""
    support = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("valid_residues"))
    out = evaluate_ensemble(EQ.member_scores(spark, d), support, EQ.THRESHOLDS, max_points=1 << 20)
    d_ = lambda c: F.col(c).cast("double")
    grid = out.grid.select(F.lit("grid").alias("kind"), "member", F.col("threshold").alias("spot"), d_("tp").alias("x"), d_("fp").alias("y"))
    curve = out.curves.filter("curve = 'pr'").select(F.lit("pr").alias("kind"), "member", d_("idx").alias("spot"), "x", "y")
    result = out.results.select(F.lit("result").alias("kind"), "member", F.lit(None).cast("double").alias("spot"), F.col("auc").alias("x"), F.col("pr_auc").alias("y"))
    return grid.unionByName(curve).unionByName(result)
