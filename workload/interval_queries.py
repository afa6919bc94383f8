"""Interval painting, label support, windows and peptide comparison.

Mapping: orders are sequences of length 200, line items are intervals on them;
returned lines are def, none-flagged lines not, the others uncertain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.stats import TAIL_TERMS
from spanforge.functions.text import mask_from_flags, ones_between
from spanforge.operators import compare as C
from spanforge.operators import intervals as I
from spanforge.operators import quality as Q
from spanforge.session import cut_lineage
from workload.registry import query, table
from workload.text_queries import SQL_CLEAN, cleaned_documents

LENGTH = 200


def intervals(spark, d):
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 150
    label = F.when(F.col("l_returnflag") == "R", "def").when(F.col("l_returnflag") == "N", "not").otherwise("uncertain")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("bigint")).alias("stop"),
        label.alias("label"),
        "l_partkey",
        "l_linenumber",
    )


def lengths(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(LENGTH).alias("length"))


def segments(spark, d):
    return I.paint(intervals(spark, d), lengths(spark, d))


SQL_ITEMS = """items AS (SELECT l_orderkey AS id, start0 AS start, start0 + CAST(trunc(l_quantity) AS BIGINT) AS stop,
        CASE l_returnflag WHEN 'R' THEN 'def' WHEN 'N' THEN 'not' ELSE 'uncertain' END AS label, l_partkey, l_linenumber
        FROM (SELECT *, (l_partkey * 7 + l_linenumber * 13) % 150 AS start0 FROM lineitem))"""
SQL_POS = f"""{SQL_ITEMS},
    marks AS (SELECT id, pos, max(CASE label WHEN 'def' THEN 2 WHEN 'not' THEN 1 ELSE 0 END) AS m
              FROM (SELECT id, label, unnest(range(start, stop)) AS pos FROM items) GROUP BY id, pos),
    grid AS (SELECT o_orderkey AS id, unnest(range(0, {LENGTH})) AS pos FROM orders),
    positions AS (SELECT id, pos, CASE coalesce(m, 0) WHEN 2 THEN 'def' WHEN 1 THEN 'not' ELSE 'uncertain' END AS label
                  FROM grid LEFT JOIN marks USING (id, pos))"""


@query("painted_segments", "id:i start:i stop:i label:s",
       f"""WITH {SQL_POS}, fresh AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS f
             FROM positions WINDOW w AS (PARTITION BY id ORDER BY pos)),
           runs AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY pos) AS run FROM fresh)
           SELECT id, min(pos) AS start, max(pos) + 1 AS stop, label FROM runs GROUP BY id, run, label""")
def painted_segments(spark, d):
    return I.merge_segments(I.paint(intervals(spark, d), lengths(spark, d), blocks=True))


@query("painted_segments_small_blocks", "label:s n_positions:i",
       f"WITH {SQL_POS} SELECT label, count(*) AS n_positions FROM positions GROUP BY label")
def painted_segments_small_blocks(spark, d):
    cut = I.paint(intervals(spark, d), lengths(spark, d), block=64)
    return cut.groupBy("label").agg(F.sum(F.col("stop") - F.col("start")).alias("n_positions"))


@query("class_counts_by_shard", "shard:i pos_count:i neg_count:i pos_weight:d",
       f"""WITH {SQL_POS} SELECT id % 8 AS shard, count(*) FILTER (WHERE label = 'def') AS pos_count,
             count(*) FILTER (WHERE label = 'not') AS neg_count, count(*) FILTER (WHERE label = 'not')
             / CAST(greatest(count(*) FILTER (WHERE label = 'def'), 1) AS DOUBLE) AS pos_weight
           FROM positions GROUP BY id % 8""")
def class_counts_by_shard(spark, d):
    return I.class_stats(segments(spark, d).withColumn("shard", F.col("id") % 8), "shard")


@query("class_counts_total", "pos_count:i neg_count:i pos_weight:d",
       f"""WITH {SQL_POS} SELECT count(*) FILTER (WHERE label = 'def') AS pos_count,
             count(*) FILTER (WHERE label = 'not') AS neg_count, count(*) FILTER (WHERE label = 'not')
             / CAST(count(*) FILTER (WHERE label = 'def') AS DOUBLE) AS pos_weight FROM positions""")
def class_counts_total(spark, d):
    return I.combine_class_stats(class_counts_by_shard(spark, d))


@query("label_support", "id:i valid_residues:i positive_residues:i negative_residues:i label_shard:s status:s",
       f"""WITH {SQL_POS}, per AS (SELECT id, count(*) FILTER (WHERE label <> 'uncertain') AS v,
             count(*) FILTER (WHERE label = 'def') AS p, count(*) FILTER (WHERE label = 'not') AS n
             FROM positions WHERE id % 9 <> 4 GROUP BY id),
           asked AS (SELECT o_orderkey + 40 AS id FROM orders),
           shards AS (SELECT o_orderkey AS id, 'shard_' || (o_orderkey % 8) AS shard FROM orders WHERE o_orderkey % 5 <> 3)
           SELECT id, CASE WHEN v IS NULL THEN 0 ELSE v END AS valid_residues, coalesce(p, 0) AS positive_residues,
             coalesce(n, 0) AS negative_residues, shard AS label_shard,
             CASE WHEN shard IS NULL THEN 'missing_label' WHEN v IS NULL THEN 'missing_label_tensor' ELSE 'ok' END AS status
           FROM asked LEFT JOIN shards USING (id) LEFT JOIN per USING (id)""")
def label_support(spark, d):
    asked = table(spark, d, "orders").select((F.col("o_orderkey") + 40).alias("id"))
    key = F.col("o_orderkey")
    shards = table(spark, d, "orders").filter(key % 5 != 3).select(
        key.alias("id"), F.concat(F.lit("shard_"), key % 8).alias("shard")
    )
    return I.label_support(asked, segments(spark, d).filter(F.col("id") % 9 != 4), shards)


@query("sequence_windows", "id:i start:i stop:i",
       f"""WITH docs AS (SELECT doc_id AS id, length({SQL_CLEAN}) AS n FROM documents)
           SELECT id, s AS start, least(s + 1000, n) AS stop FROM (SELECT id, n, unnest(range(0, n, 900)) AS s FROM docs)
           WHERE s = 0 OR s - 900 + 1000 < n""")
def sequence_windows(spark, d):
    docs = cleaned_documents(spark, d).select(F.col("doc_id").alias("id"), F.length("sequence").alias("length"))
    return I.sequence_windows(docs, 1000, 900)


@query("window_support", "id:i start:i stop:i n_valid:i",
       f"""WITH {SQL_POS}, w AS (SELECT o_orderkey AS id, unnest(range(0, {LENGTH}, 40)) AS start FROM orders),
             spans AS (SELECT id, start, least(start + 50, {LENGTH}) AS stop FROM w WHERE start = 0 OR start + 10 < {LENGTH})
           SELECT id, start, stop, count(*) FILTER (WHERE label <> 'uncertain') AS n_valid
           FROM spans JOIN positions USING (id) WHERE pos >= start AND pos < stop GROUP BY id, start, stop""")
def window_support(spark, d):
    return I.window_support(I.sequence_windows(lengths(spark, d), 50, 40), segments(spark, d))


@query("zero_valid_windows", "split:i n_windows:i n_zero:i",
       f"""WITH {SQL_POS}, w AS (SELECT o_orderkey AS id, unnest(range(0, {LENGTH}, 40)) AS start FROM orders),
             spans AS (SELECT id, start, least(start + 50, {LENGTH}) AS stop FROM w WHERE start = 0 OR start + 10 < {LENGTH}),
             s AS (SELECT id, start, count(*) FILTER (WHERE label <> 'uncertain') AS n_valid
                   FROM spans JOIN positions USING (id) WHERE pos >= start AND pos < stop GROUP BY id, start)
           SELECT id % 5 AS split, count(*) AS n_windows, count(*) FILTER (WHERE n_valid = 0) AS n_zero FROM s GROUP BY id % 5""")
def zero_valid_windows(spark, d):
    return window_support(spark, d).groupBy((F.col("id") % 5).alias("split")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("n_valid") == 0).alias("n_zero")
    )


_SQL_STRINGS = f"""{SQL_POS}, strings AS (SELECT id, string_agg(left(label, 1), '' ORDER BY pos) AS labels
    FROM positions GROUP BY id)"""


@query("label_strings", "id:i labels:s", f"WITH {_SQL_STRINGS} SELECT id, labels FROM strings")
def label_strings(spark, d):
    return I.label_strings(segments(spark, d))


@query("label_string_chunks", "id:i chunk:i labels:s",
       f"""WITH {SQL_POS} SELECT id, pos // 64 AS chunk, string_agg(left(label, 1), '' ORDER BY pos) AS labels
           FROM positions GROUP BY id, pos // 64""")
def label_string_chunks(spark, d):
    return I.label_strings(segments(spark, d), chunk=64)


@query("training_windows", "id:i start:i stop:i y:s mask:s",
       f"""WITH {_SQL_STRINGS}, spans AS (SELECT id, labels, unnest([0, 50, 100, 150]) AS start FROM strings),
             cut AS (SELECT id, start, least(start + 64, {LENGTH}) AS stop, substr(labels, start + 1, 64) AS c FROM spans)
           SELECT id, start, stop, rpad(regexp_replace(regexp_replace(c, '[nu]', '0', 'g'), 'd', '1', 'g'), 64, '0') AS y,
             rpad(regexp_replace(regexp_replace(c, '[nd]', '1', 'g'), 'u', '0', 'g'), 64, '0') AS mask FROM cut""")
def training_windows(spark, d):
    rows = I.training_windows(I.label_strings(segments(spark, d)), window=64, stride=50)
    return rows.withColumn("y", F.array_join("y", "")).withColumn("mask", F.array_join("mask", ""))


def masks(spark, d):
    """A made-up prediction mask for nine of ten orders; it repeats every seven positions."""
    bit = F.transform(F.sequence(F.lit(0), F.lit(6)),
                      lambda i: ((F.col("o_orderkey") * 31 + i * 17) % 7 < 3).cast("int"))
    whole = F.substring(F.repeat(mask_from_flags(bit), LENGTH // 7 + 1), 1, LENGTH)
    return table(spark, d, "orders").filter(F.col("o_orderkey") % 10 != 0).select(
        F.col("o_orderkey").alias("ProteinID"), whole.alias("mask")
    )


SQL_BITS = f"""bits AS (SELECT id, pos, ((id * 31 + pos * 17) % 7 < 3) AS bit FROM (
    SELECT o_orderkey AS id, unnest(range(0, {LENGTH})) AS pos FROM orders WHERE o_orderkey % 10 <> 0))"""


@query("binary_label_segments", "label:s n_segments:i n_positions:i",
       f"""WITH {SQL_BITS}, fresh AS (SELECT *, CASE WHEN lag(bit) OVER (PARTITION BY id ORDER BY pos)
             IS DISTINCT FROM bit THEN 1 ELSE 0 END AS f FROM bits)
           SELECT CASE WHEN bit THEN 'def' ELSE 'not' END AS label, sum(f) AS n_segments, count(*) AS n_positions
           FROM fresh GROUP BY bit""")
def binary_label_segments(spark, d):
    bits = F.split("mask", "").cast("array<int>")
    rows = I.segments_from_labels(masks(spark, d).select(F.col("ProteinID").alias("id"), bits.alias("y")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_segments"),
                                     F.sum(F.col("stop") - F.col("start")).alias("n_positions"))


@query("mask_strings", "ProteinID:i mask:s n_ones:i",
       f"""WITH {SQL_BITS} SELECT id AS ProteinID, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask,
             count(*) FILTER (WHERE bit) AS n_ones FROM bits GROUP BY id""")
def mask_strings(spark, d):
    rows = masks(spark, d)
    return rows.withColumn("n_ones", ones_between(F.col("mask"), F.lit(0), F.lit(LENGTH)))


@query("masks_by_id", "ProteinID:s mask:s",
       """WITH n AS (SELECT count(*) // 2 + 1 AS ids FROM customer)
          SELECT 'C' || (c_custkey % ids) AS ProteinID, CASE WHEN max(c_custkey) % 2 = 0 THEN '0101' ELSE '111' END AS mask
          FROM customer CROSS JOIN n GROUP BY c_custkey % ids""")
def masks_by_id(spark, d):
    k, n = F.col("c_custkey"), table(spark, d, "customer").count() // 2 + 1
    plain = F.concat(F.lit("C"), k % n, F.lit(" x"))
    strict = F.concat(F.lit("ID=C"), k % n, F.lit(" AC=C OXX=1"))
    rows = table(spark, d, "customer").select(
        F.when(k % 3 == 0, strict).otherwise(plain).alias("header"),
        F.when(k % 2 == 0, " 0101").otherwise("111").alias("sequence"),
        k.alias("source_order"),
    )
    return C.masks_by_id(rows)


def peptides(spark, d):
    rows = intervals(spark, d).filter(F.col("label") != "uncertain")
    # row numbers are keys of later joins, so they are fixed in a written table
    return cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.concat(F.lit("P"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber")).alias("CodeName"),
        F.col("id").alias("ProteinID"),
        F.col("start").alias("AlignStart"),
        F.col("stop").alias("AlignStop"),
        (F.col("label") == "def").cast("int").alias("Def epitope"),
        (F.col("label") == "not").cast("int").alias("Not epitope"),
    ))


def comparison(spark, d, labelled=True):
    known = None
    if labelled:
        known = segments(spark, d).filter(F.col("id") % 4 != 1).withColumnRenamed("id", "ProteinID")
    return C.compare_peptides(peptides(spark, d), masks(spark, d), known)


def _sql_comparison(labelled: bool) -> str:
    label_ones = "CASE WHEN id % 4 <> 1 THEN lab END" if labelled else "NULL"
    return f"""{SQL_POS}, {SQL_BITS}, numbered AS (SELECT *, row_number() OVER () AS rid FROM items WHERE label <> 'uncertain'),
    hits AS (SELECT rid, count(*) FILTER (WHERE bit) AS ones, count(*) FILTER (WHERE p.label = 'def') AS lab
             FROM (SELECT rid, id, unnest(range(start, stop)) AS pos FROM numbered) x JOIN bits USING (id, pos)
             JOIN positions p USING (id, pos) GROUP BY rid),
    base AS (SELECT 'P' || l_partkey || '_' || l_linenumber AS CodeName, id AS ProteinID, start AS AlignStart,
        stop AS AlignStop, stop - start AS PeptideLen, CASE label WHEN 'def' THEN 'reactive' ELSE 'nonreactive' END AS TrueClass,
        ones AS PredOnes, CASE label WHEN 'def' THEN stop - start ELSE 0 END AS ExpectedOnesRule, {label_ones} AS LabelOnes
        FROM numbered JOIN hits USING (rid)),
    compared AS (SELECT *, CASE WHEN PredOnes > 0 THEN 'reactive' ELSE 'nonreactive' END AS PredClass,
        PeptideLen - PredOnes AS PredZeros, coalesce(LabelOnes, ExpectedOnesRule) AS ExpectedOnes,
        PredOnes - coalesce(LabelOnes, ExpectedOnesRule) AS DeltaPredMinusExpected,
        abs(PredOnes - coalesce(LabelOnes, ExpectedOnesRule)) AS AbsDelta,
        CASE WHEN PredOnes = coalesce(LabelOnes, ExpectedOnesRule) THEN 1 ELSE 0 END AS ExactMatch FROM base)"""


_COMPARE_SPEC = ("CodeName:s ProteinID:i AlignStart:i AlignStop:i PeptideLen:i TrueClass:s PredClass:s PredOnes:i PredZeros:i "
                 "ExpectedOnesRule:i LabelOnes:i ExpectedOnes:i DeltaPredMinusExpected:i AbsDelta:i ExactMatch:i")


@query("peptide_comparison", _COMPARE_SPEC, f"WITH {_sql_comparison(False)} SELECT * FROM compared")
def peptide_comparison(spark, d):
    return comparison(spark, d, labelled=False)


@query("peptide_comparison_with_labels", _COMPARE_SPEC, f"WITH {_sql_comparison(True)} SELECT * FROM compared")
def peptide_comparison_with_labels(spark, d):
    return comparison(spark, d)


@query("comparison_summary",
       "n_rows_compared:i n_reactive:i n_nonreactive:i exact_match_rate:d mean_abs_delta:d mean_pred_ones_overall:d "
       "mean_pred_ones_reactive:d mean_pred_ones_nonreactive:d tp:i fp:i tn:i fn:i accuracy:d precision:d recall:d",
       f"""WITH {_sql_comparison(True)}, s AS (SELECT count(*) AS n_rows_compared,
             count(*) FILTER (WHERE TrueClass = 'reactive') AS n_reactive,
             count(*) FILTER (WHERE TrueClass = 'nonreactive') AS n_nonreactive, avg(ExactMatch) AS exact_match_rate,
             avg(AbsDelta) AS mean_abs_delta, avg(PredOnes) AS mean_pred_ones_overall,
             avg(PredOnes) FILTER (WHERE TrueClass = 'reactive') AS mean_pred_ones_reactive,
             avg(PredOnes) FILTER (WHERE TrueClass = 'nonreactive') AS mean_pred_ones_nonreactive,
             count(*) FILTER (WHERE TrueClass = 'reactive' AND PredClass = 'reactive') AS tp,
             count(*) FILTER (WHERE TrueClass = 'nonreactive' AND PredClass = 'reactive') AS fp,
             count(*) FILTER (WHERE TrueClass = 'nonreactive' AND PredClass = 'nonreactive') AS tn,
             count(*) FILTER (WHERE TrueClass = 'reactive' AND PredClass = 'nonreactive') AS fn FROM compared)
           SELECT *, (tp + tn) / CAST(n_rows_compared AS DOUBLE) AS accuracy, tp / CAST(greatest(tp + fp, 1) AS DOUBLE)
             AS precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS recall FROM s""")
def comparison_summary(spark, d):
    return C.comparison_summary(comparison(spark, d))


@query("missing_predictions", "n_missing:i examples:s",
       """WITH gone AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag IN ('R', 'N') AND l_orderkey % 10 = 0)
          SELECT count(*) AS n_missing, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM
            (SELECT k FROM gone ORDER BY k LIMIT 20)) AS examples FROM gone""")
def missing_predictions(spark, d):
    report = Q.missing_report(peptides(spark, d), masks(spark, d), "ProteinID")
    return report.withColumn("examples", F.array_join("examples", ","))


@query("out_of_bounds_intervals", "id:i start:i stop:i length:i",
       f"""WITH {SQL_ITEMS} SELECT id, start, stop, 20 + id % 150 AS length FROM items
           WHERE start < 0 OR stop <= start OR stop > 20 + id % 150""")
def out_of_bounds_intervals(spark, d):
    rows = intervals(spark, d).withColumn("length", 20 + F.col("id") % 150)
    return rows.filter(Q.bad_bounds(F.col("start"), F.col("stop"), F.col("length")))


@query("nested_peptide_lists", "id:i n_peptides:i first_id:s family:s codes:s n_def:i",
       """WITH r AS (SELECT *, l_partkey * 10 + l_linenumber AS o FROM lineitem),
            u AS (SELECT DISTINCT l_orderkey, o, l_partkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS is_def FROM r)
          SELECT l_orderkey AS id, count(*) AS n_peptides, 'O' || l_orderkey AS first_id,
            CAST(arg_min(l_linenumber, o) AS VARCHAR) AS family, string_agg('P' || l_partkey, ',' ORDER BY o) AS codes,
            sum(is_def) AS n_def FROM u GROUP BY l_orderkey""")
def nested_peptide_lists(spark, d):
    lists = I.peptide_lists(peptide_rows(spark, d))
    return lists.select(
        "id",
        F.size("peptides").alias("n_peptides"),
        F.col("tax_info.protein_id").alias("first_id"),
        F.col("tax_info.family").alias("family"),
        F.array_join(F.transform("peptides", lambda p: p["code_name"]), ",").alias("codes"),
        F.aggregate("peptides", F.lit(0), lambda a, p: a + p["label_onehot"][0]).alias("n_def"),
    )


@query("nested_peptide_list_parts", "id:i n_peptides:i families:i family:s n_def:i",
       """WITH r AS (SELECT *, l_partkey * 10 + l_linenumber AS o FROM lineitem),
            u AS (SELECT DISTINCT l_orderkey, o, l_partkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS is_def FROM r)
          SELECT l_orderkey AS id, count(*) AS n_peptides, 1 AS families, CAST(arg_min(l_linenumber, o) AS VARCHAR) AS family,
            sum(is_def) AS n_def FROM u GROUP BY l_orderkey""")
def nested_peptide_list_parts(spark, d):
    """All parts of an id together: nothing is lost, and the id's first row names each part."""
    lists = I.peptide_lists(peptide_rows(spark, d), parts=3)
    return lists.groupBy("id").agg(
        F.sum(F.size("peptides")).alias("n_peptides"),
        F.count_distinct("tax_info").alias("families"),
        F.min("tax_info.family").alias("family"),
        F.sum(F.aggregate("peptides", F.lit(0), lambda a, p: a + p["label_onehot"][0])).alias("n_def"),
    )


def peptide_rows(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("code_name"),
        F.lit("PEP").alias("peptide"),
        F.lit(0).alias("start"),
        F.lit(3).alias("stop"),
        F.when(F.col("l_partkey") % 2 == 0, "def").otherwise("not").alias("label"),
        F.concat(F.lit("ID=O"), F.col("l_orderkey"), F.lit(" AC=A OXX=1,"), F.col("l_linenumber")).alias("fullname"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("source_order"),
    ).distinct()


# --- top-K enrichment ------------------------------------------------------

_TOPK_SPEC = ("k_selected:i reactive_topk:i prop_topk:d prop_topk_ci_lo:d prop_topk_ci_hi:d reactive_total:i n_total:i "
              "prop_full:d enrichment_ratio:d z_stat_one_sided:d pvalue_note:s")
_Z = "1.959963984540054"
_SQL_TOPK = f"""ranked AS (SELECT row_number() OVER w AS k, sum(hit) OVER w AS x, count(*) OVER () AS n, sum(hit) OVER () AS t
        FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS hit, floor(c_acctbal / 500) AS s, c_name FROM customer)
        WINDOW w AS (ORDER BY s DESC, c_name)),
    kept AS (SELECT *, x / CAST(k AS DOUBLE) AS p, t / CAST(n AS DOUBLE) AS f, (x + t) / CAST(k + n AS DOUBLE) AS pool
             FROM ranked WHERE (k >= 50 AND (k - 50) % 10 = 0) OR k = n),
    wilson AS (SELECT *, (p + {_Z} * {_Z} / (2 * k)) / (1 + {_Z} * {_Z} / k) AS mid,
        {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * k)) / k) / (1 + {_Z} * {_Z} / k) AS half,
        pool * (1 - pool) * (1.0 / k + 1.0 / n) AS v FROM kept),
    topk AS (SELECT k AS k_selected, x AS reactive_topk, p AS prop_topk, greatest(0, mid - half) AS prop_topk_ci_lo,
        least(1, mid + half) AS prop_topk_ci_hi, t AS reactive_total, n AS n_total, f AS prop_full, p / f AS enrichment_ratio,
        CASE WHEN k < n AND v > 0 THEN (p - f) / sqrt(v) END AS z_stat_one_sided,
        CASE WHEN k = n THEN 'non-computable: k equals full library size' ELSE 'ok' END AS pvalue_note FROM wilson)"""


def enrichment(spark, d, p_values=False):
    rows = table(spark, d, "customer").select(
        F.floor(F.col("c_acctbal") / 500).alias("s"), "c_name", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("hit")
    )
    return C.topk_enrichment(rows, score="s", name="c_name", positive="hit", k_start=50, p_values=p_values)


@query("topk_enrichment", _TOPK_SPEC, f"WITH {_SQL_TOPK} SELECT * FROM topk")
def topk_enrichment(spark, d):
    return enrichment(spark, d)


def _sql_tail(z: str) -> str:
    """1 - Phi of a column as SQL text: the series up to 3, the continued fraction beyond."""
    series, fraction = "1.0", "u"
    for k in range(TAIL_TERMS, 0, -1):
        series, fraction = f"(1.0 + u * u / {2 * k + 1} * {series})", f"(u + {k} / {fraction})"
    upper = f"CASE WHEN u <= 3 THEN 0.5 - f * u * {series} ELSE f / {fraction} END"
    return f"""SELECT * EXCLUDE (u, f), CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0 - ({upper}) END AS pvalue_one_sided
        FROM (SELECT *, abs({z}) AS u, exp(-{z} * {z} / 2) / sqrt(2 * pi()) AS f FROM topk)"""


@query("topk_enrichment_p_values", f"{_TOPK_SPEC} pvalue_one_sided:d", f"WITH {_SQL_TOPK} {_sql_tail('z_stat_one_sided')}")
def topk_enrichment_p_values(spark, d):
    return enrichment(spark, d, p_values=True)


@query("enrichment_checkpoints", _TOPK_SPEC,
       f"""WITH {_SQL_TOPK} SELECT * FROM topk WHERE k_selected IN (500, 1000, 2500, 5000, 10000)
           OR (k_selected >= 20000 AND k_selected % 10000 = 0) OR k_selected = n_total""")
def enrichment_checkpoints(spark, d):
    return C.enrichment_checkpoints(enrichment(spark, d))


@query("table_fingerprint", "n_rows:i fingerprint:s",
       """SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(c_custkey || '|' || c_name || '|' || c_nationkey || '|'
            || format('{:.11e}', c_acctbal) || '|' || c_mktsegment), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM customer""")
def table_fingerprint(spark, d):
    return C.table_fingerprint(table(spark, d, "customer"))
