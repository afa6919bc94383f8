"""Peptide intervals against predicted masks, and top-K enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.stats import (
    normal_upper_tail,
    ratio_or_nan,
    two_proportion_z,
    wilson_high,
    wilson_low,
)
from spanforge.functions.text import is_binary_mask, prediction_id, strip
from spanforge.operators.intervals import overlap_totals
from spanforge.operators.ranking import is_grid_rank, prefix_sums

# The named K checkpoints, then every 10 000 from 20 000.
K_CHECKPOINTS = (500, 1000, 2500, 5000, 10000)

#: Positions of a chunk of the mask directory.
MASK_CHUNK = 256


def masks_by_id(records: DataFrame) -> DataFrame:
    """``(ProteinID, mask)`` of a prediction FASTA; the last record of an id wins,
    and a character other than 0/1 fails the job."""
    mask = strip(F.col("sequence"))
    bad = F.raise_error(F.concat(F.lit("mask with non-binary characters: "), F.col("header"))).cast("string")
    checked = F.when(is_binary_mask(mask), mask).otherwise(bad)
    rows = records.select(prediction_id(F.col("header")).alias("ProteinID"), checked.alias("mask"), "source_order")
    return rows.groupBy("ProteinID").agg(F.max(F.struct("source_order", "mask")).alias("m")).select(
        "ProteinID", "m.mask"
    )


def mask_directory(masks: DataFrame) -> DataFrame:
    """Rank directory of masks: ``(ProteinID, chunk, bits, before, length)``.

    A chunk has ``MASK_CHUNK`` positions and the ones ahead of it, so the ones of any interval
    are the difference of two look-ups. A mask whose length is a whole number of chunks
    ends with an empty one, for intervals that stop there.
    """
    size = F.length("mask").cast("bigint")
    pieces = F.transform(
        F.sequence(F.lit(0).cast("int"), F.floor(size / MASK_CHUNK).cast("int")),
        lambda i: F.substring(F.col("mask"), i * MASK_CHUNK + 1, F.lit(MASK_CHUNK)))
    running = F.aggregate(
        "pieces", F.array(F.lit(0).cast("bigint")), lambda sums, p: F.concat(sums, F.array(F.element_at(sums, -1) + _ones(p))))
    rows = masks.select("ProteinID", size.alias("length"), pieces.alias("pieces")).withColumn("running", running)
    chunk = F.transform("pieces", lambda p, i: F.struct(
        i.cast("bigint").alias("chunk"), p.alias("bits"), F.get("running", i).alias("before")))
    return rows.select("ProteinID", "length", F.inline(chunk))


def _ones(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("bigint")


def ones_before(places: DataFrame, directory: DataFrame) -> DataFrame:
    """``(ProteinID, pos, rank)``: the ones of the mask ahead of each distinct place ``(ProteinID, pos)``."""
    wanted = places.distinct().withColumn("chunk", F.floor(F.col("pos") / MASK_CHUNK).cast("bigint"))
    found = wanted.join(directory.select("ProteinID", "chunk", "bits", "before"), ["ProteinID", "chunk"])
    ahead = F.substring(F.col("bits"), F.lit(1), F.pmod("pos", F.lit(MASK_CHUNK)).cast("int"))
    return found.select("ProteinID", "pos", (F.col("before") + _ones(ahead)).alias("rank"))


def compare_peptides(peptides: DataFrame, masks: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Predicted against expected positives per peptide.

    ``peptides`` is ``(row_id, CodeName, ProteinID, AlignStart, AlignStop, "Def
    epitope", "Not epitope")``. Peptides without a mask drop out (see
    ``missing_ids`` for their report). Predicted ones come from the rank directory of the
    masks, two look-ups per distinct place, so no mask meets a peptide. With label ``segments`` (one row set per
    ``ProteinID``) the expectation is the labelled positives of the interval;
    proteins without labels fall back to the rule "all if def, else none".
    """
    start, stop = F.col("AlignStart").cast("bigint"), F.col("AlignStop").cast("bigint")
    is_def, is_not = F.col("Def epitope").cast("int") == 1, F.col("Not epitope").cast("int") == 1
    directory = mask_directory(masks)
    sizes = directory.filter("chunk = 0").select("ProteinID", "length")
    ends = peptides.select("ProteinID", F.explode(F.array(start, stop)).alias("pos"))
    ranks = ones_before(ends, directory)
    first = ranks.select("ProteinID", F.col("pos").alias("_from"), F.col("rank").alias("_low"))
    last = ranks.select("ProteinID", F.col("pos").alias("_to"), F.col("rank").alias("_high"))
    # Places outside a mask have no rank; the bounds are judged before it is used.
    joined = (
        peptides.withColumns({"_from": start, "_to": stop}).join(sizes, "ProteinID")
        .join(first, ["ProteinID", "_from"], "left").join(last, ["ProteinID", "_to"], "left"))
    wrong = (start < 0) | (stop <= start) | (stop > F.col("length"))
    both = is_def & is_not
    fail = F.raise_error(F.concat_ws(" ", F.lit("invalid bounds or label:"), F.col("CodeName"), start, stop))
    ones = F.when(wrong | both, fail.cast("bigint")).otherwise(F.col("_high") - F.col("_low"))
    rows = joined.select(
        "row_id",
        "CodeName",
        "ProteinID",
        start.alias("AlignStart"),
        stop.alias("AlignStop"),
        (stop - start).alias("PeptideLen"),
        F.when(is_def, "reactive").otherwise("nonreactive").alias("TrueClass"),
        ones.alias("PredOnes"),
        F.when(is_def, stop - start).otherwise(0).cast("bigint").alias("ExpectedOnesRule"),
    )
    if segments is None:
        rows = rows.withColumn("LabelOnes", F.lit(None).cast("bigint"))
    else:
        # Painted labels cover whole sequences, so a peptide that meets no segment
        # at all belongs to a sequence without labels.
        spans = peptides.select("row_id", F.col("ProteinID").alias("id"), start.alias("start"), stop.alias("stop"))
        named = segments.withColumnRenamed("ProteinID", "id")
        totals = overlap_totals(spans, named, row_key="row_id", counted=F.col("label") == "def", out="LabelOnes")
        rows = rows.join(totals, "row_id", "left")
    expected = F.coalesce("LabelOnes", "ExpectedOnesRule")
    delta = F.col("PredOnes") - expected
    return rows.select(
        "CodeName",
        "ProteinID",
        "AlignStart",
        "AlignStop",
        "PeptideLen",
        "TrueClass",
        F.when(F.col("PredOnes") > 0, "reactive").otherwise("nonreactive").alias("PredClass"),
        "PredOnes",
        (F.col("PeptideLen") - F.col("PredOnes")).alias("PredZeros"),
        "ExpectedOnesRule",
        "LabelOnes",
        expected.alias("ExpectedOnes"),
        delta.alias("DeltaPredMinusExpected"),
        F.abs(delta).alias("AbsDelta"),
        (F.col("PredOnes") == expected).cast("int").alias("ExactMatch"),
    )


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Counts, match rates and the any-positive confusion of a comparison, in one pass.
    A comparison without rows is an error."""
    true_r, pred_r = F.col("TrueClass") == "reactive", F.col("PredClass") == "reactive"
    nothing = F.raise_error(F.lit("no comparable rows")).cast("bigint")
    sums = rows.agg(
        F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))).otherwise(nothing).alias("n_rows_compared"),
        F.count_if(true_r).alias("n_reactive"),
        F.count_if(~true_r).alias("n_nonreactive"),
        F.avg("ExactMatch").alias("exact_match_rate"),
        F.avg("AbsDelta").alias("mean_abs_delta"),
        F.avg("PredOnes").alias("mean_pred_ones_overall"),
        F.avg(F.when(true_r, F.col("PredOnes"))).alias("mean_pred_ones_reactive"),
        F.avg(F.when(~true_r, F.col("PredOnes"))).alias("mean_pred_ones_nonreactive"),
        F.count_if(true_r & pred_r).alias("tp"),
        F.count_if(~true_r & pred_r).alias("fp"),
        F.count_if(~true_r & ~pred_r).alias("tn"),
        F.count_if(true_r & ~pred_r).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def over(n, d):
        return n.cast("double") / F.greatest(d, F.lit(1)).cast("double")

    return sums.select(
        "*",
        over(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        over(tp, tp + fp).alias("precision"),
        over(tp, tp + fn).alias("recall"),
    )


def topk_enrichment(
    rows: DataFrame, *, score: str, name: str, positive: str, k_start: int = 500, k_step: int = 10,
    n_blocks: int | None = None, p_values: bool = True,
) -> DataFrame:
    """Enrichment of positives among the top K by score, for a grid of K.

    Rank is score descending, then name ascending; names must be unique. The grid
    is a test on the rank, so no grid table is joined, and a score shared by many
    rows is divided by its names.
    """
    if k_step <= 0:
        raise ValueError("k_step must be positive")
    base = rows.select(F.col(score).cast("double").alias("s"), F.col(name).cast("string").alias("n"),
                       F.col(positive).cast("bigint").alias("hit"))
    ranked = prefix_sums(base, [-F.col("s"), F.col("n")], {"one": F.lit(1), "hit": F.col("hit")}, n_blocks=n_blocks)
    k, total = F.col("cum_one"), F.col("total_one")
    small = F.raise_error(F.lit(f"fewer rows than k_start={k_start}")).cast("boolean")
    kept = ranked.filter(F.when(total < k_start, small).otherwise(is_grid_rank(k, total, k_start, k_step)))
    hits, all_hits = F.col("cum_hit"), F.col("total_hit")
    full = ratio_or_nan(all_hits, total)
    whole = k == total
    z = F.when(whole, F.lit(float("nan"))).otherwise(two_proportion_z(hits, k, all_hits, total))
    out = kept.select(
        k.alias("k_selected"),
        hits.alias("reactive_topk"),
        (hits / k).alias("prop_topk"),
        wilson_low(hits, k).alias("prop_topk_ci_lo"),
        wilson_high(hits, k).alias("prop_topk_ci_hi"),
        all_hits.alias("reactive_total"),
        total.alias("n_total"),
        full.alias("prop_full"),
        F.when(full > 0, hits / k / full).otherwise(F.lit(float("nan"))).alias("enrichment_ratio"),
        z.alias("z_stat_one_sided"),
        F.when(whole, "non-computable: k equals full library size")
        .when(F.isnan(z), "non-computable: invalid variance or counts")
        .otherwise("ok")
        .alias("pvalue_note"),
    )
    return out.withColumn("pvalue_one_sided", normal_upper_tail(F.col("z_stat_one_sided"))) if p_values else out


def enrichment_checkpoints(curve: DataFrame) -> DataFrame:
    """Named K values, every 10 000 from 20 000, and the full size."""
    k = F.col("k_selected")
    return curve.filter(
        k.isin(*K_CHECKPOINTS) | ((k >= 20000) & (F.pmod(k, F.lit(10000)) == 0)) | (k == F.col("n_total"))
    )


def table_fingerprint(df: DataFrame, digits: int = 12) -> DataFrame:
    """Order-insensitive content hash: numbers at ``digits`` significant digits,
    rows hashed one by one (md5) and summed, so no row order or single task is needed."""
    cells = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("double", "float"):
            c = F.format_string(f"%.{digits - 1}e", c)
        cells.append(F.coalesce(c.cast("string"), F.lit("null")))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("fingerprint"))
