"""Prepare jobs: three assay kinds to one contract, and the evaluation subset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import build_fullname, build_fullname_oxx, first_numeric, first_token, strip
from spanforge.operators.assay import (
    classify_reactivity,
    group_ids,
    labelled_codes,
    listed_sequences,
    quarantine_listed,
    quarantine_scored,
    scored_sequences,
    whole_number,
)
from spanforge.operators.quality import (
    bad_bounds,
    drop_report,
    first_reason,
    guard_empty,
    guard_single_group,
    resolve_sequences,
)
from spanforge.session import cut_lineage
from spanforge.sources.fasta import read_fasta
from spanforge.sources.sinks import write_prepared
from spanforge.sources.tables import (
    all_present,
    first_present,
    read_assay_metadata,
    read_codes,
    read_tsv,
    read_zscores,
)

# The column order of the prepared contract.
CONTRACT_COLUMNS = (
    "CodeName", "FullName", "Peptide", "AlignStart", "AlignStop",
    "Def epitope", "Uncertain", "Not epitope", "ProteinID", "GroupToken", "GroupID",
)


@dataclass(frozen=True)
class Prepared:
    """Outputs of a prepare job; every table is lazy."""

    contract: DataFrame
    embedding_names: DataFrame
    targets: DataFrame
    dropped: DataFrame
    summary: DataFrame

    def write(self, path: str) -> None:
        write_prepared(self.contract, self.embedding_names, self.targets, self.summary, path)


def finalize(rows: DataFrame, sequences: DataFrame, kind: str, offset: int = 0) -> Prepared:
    """Turn quarantined rows into the contract, its FASTA targets and its summary.

    The rows feed several checks and outputs, so their joins are run once and
    cut off at a checkpoint.
    """
    rows = cut_lineage(rows)
    kept = rows.filter(F.col("reason").isNull())
    if kept.isEmpty():
        raise ValueError(f"no rows left after normalisation for {kind}")
    if kind == "pv1":
        kept = kept.withColumn("GroupID", F.col("GroupToken").cast("bigint"))
    else:
        kept = kept.join(group_ids(kept, "GroupToken", offset), "GroupToken")
    guard_single_group(kept, "ProteinID", "GroupID")
    kept = kept.withColumn("FullName", build_fullname(F.col("ProteinID"), F.col("GroupID")))
    contract = kept.select(*[F.col(f"`{c}`") for c in CONTRACT_COLUMNS])
    names = contract.select(
        "ProteinID", F.col("FullName").alias("Name"), F.col("GroupID").alias("Family")
    ).distinct()
    targets = names.select("ProteinID", F.col("Name").alias("header")).join(
        sequences.select("ProteinID", "sequence"), "ProteinID"
    )
    dropped = drop_report(rows)
    per_protein = contract.groupBy("ProteinID").agg(F.count(F.lit(1)).alias("n"))
    counts = per_protein.agg(
        F.sum("n").alias("n_label_rows"),
        F.count(F.lit(1)).alias("n_label_proteins"),
        F.count(F.lit(1)).alias("n_targets"),
    )
    reasons = dropped.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n_rows")))).alias("drop_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "examples")))).alias("drop_examples"),
    )
    summary = counts.crossJoin(reasons).select(F.lit(kind).alias("dataset_kind"), "*")  # one row each
    return Prepared(contract, names, targets, dropped, summary)


def prepare_scored(
    metadata: DataFrame,
    zscores: DataFrame,
    records: DataFrame,
    *,
    reactive_min: float = 20.0,
    min_subjects: int = 4,
    nonreactive_max: float = 10.0,
    max_subjects: int | None = None,
) -> Prepared:
    """Designed-library source: classes from z-scores, family from the full name."""
    classes = classify_reactivity(
        zscores,
        reactive_min=reactive_min,
        min_subjects=min_subjects,
        nonreactive_max=nonreactive_max,
        max_subjects=max_subjects or None,
    )
    sequences = scored_sequences(records)
    return finalize(quarantine_scored(metadata, classes, sequences), sequences, "pv1")


def prepare_listed(
    metadata: DataFrame, reactive: DataFrame, nonreactive: DataFrame, records: DataFrame, kind: str, offset: int = 0
) -> Prepared:
    """Code-list source: labels from two lists, group ids from cluster tokens."""
    sequences = listed_sequences(records)
    return finalize(quarantine_listed(metadata, reactive, nonreactive, sequences, kind), sequences, kind, offset)


def prepare_dataset(
    spark: SparkSession,
    kind: str,
    *,
    meta: str,
    fasta: str,
    z_scores: str | None = None,
    reactive_codes: str | None = None,
    nonreactive_codes: str | None = None,
    group_id_offset: int = 0,
    subject_prefix: str = "VW_",
    **thresholds,
) -> Prepared:
    """Read the files of one source kind (pv1, cwp, bkp) and prepare them."""
    kind = str(kind).strip().lower()
    if kind == "pv1":
        if z_scores is None:
            raise ValueError("z_scores is required for pv1")
        records = read_fasta(spark, fasta)
        return prepare_scored(
            read_assay_metadata(spark, meta), read_zscores(spark, z_scores, prefix=subject_prefix), records, **thresholds
        )
    if kind not in ("cwp", "bkp"):
        raise ValueError(f"unsupported dataset kind {kind!r}; expected pv1, cwp or bkp")
    if reactive_codes is None or nonreactive_codes is None:
        raise ValueError("reactive_codes and nonreactive_codes are required for cwp and bkp")
    return prepare_listed(
        read_tsv(spark, meta),
        read_codes(spark, reactive_codes),
        read_codes(spark, nonreactive_codes),
        read_fasta(spark, fasta),
        kind,
        group_id_offset,
    )


@dataclass(frozen=True)
class EvaluationSubset:
    """Outputs of the evaluation prepare job."""

    metadata: DataFrame
    targets: DataFrame
    dropped: DataFrame
    summary: DataFrame


def prepare_evaluation(
    metadata: DataFrame,
    records: DataFrame,
    reactive: DataFrame,
    nonreactive: DataFrame,
    *,
    mode: str = "combined",
    oxx: str = "0,0,0,0",
) -> EvaluationSubset:
    """Labelled subset for evaluation, with a staged drop report.

    Stages in order: missing bounds (rows), missing protein and ambiguous protein
    (distinct proteins), out-of-bounds (distinct codes; every row of such a code
    goes). A non-positive peptide length fails the job, and so does the first stage
    that leaves no row.
    """
    code_col = first_present(metadata, ["CodeName", "Code", "Sequence name"], "code")
    protein_col = first_present(metadata, ["SequenceAccession", "ProteinID", "ProteinAccession"], "protein id")
    starts = all_present(metadata, ["StartIndex", "AlignStart", "Start"], "start")
    stops = all_present(metadata, ["StopIndex", "AlignStop", "Stop"], "stop")
    peptide_col = first_present(metadata, ["PeptideSequence", "Peptide"], "peptide")

    codes = labelled_codes(reactive, nonreactive, mode)
    rows = metadata.withColumn("CodeName", F.col(f"`{code_col}`")).join(codes, "CodeName").select(
        "CodeName",
        "LabelSource",
        strip(F.col(protein_col)).alias("ProteinID"),
        F.col(peptide_col).alias("Peptide"),
        whole_number(first_numeric(starts)).alias("AlignStart"),
        whole_number(first_numeric(stops)).alias("AlignStop"),
        "source_order",
    )
    sequences = resolve_sequences(records.select(first_token(F.col("header")).alias("ProteinID"), "sequence"),
                                  "ProteinID")
    rows = rows.join(sequences, "ProteinID", "left")
    start, stop, length = F.col("AlignStart"), F.col("AlignStop"), F.col("length")
    reason, example = first_reason([
        ("missing_align", start.isNull() | stop.isNull(), F.col("CodeName")),
        ("missing_protein", F.col("sequence").isNull(), F.col("ProteinID")),
        ("ambiguous_protein", F.col("ambiguous"), F.col("ProteinID")),
        ("out_of_bounds_align", bad_bounds(start, stop, length), F.col("CodeName")),
    ])
    judged = cut_lineage(rows.withColumn("reason", reason).withColumn("example", example).drop("sequence", "ambiguous", "length"))
    flat = judged.filter(F.col("AlignStop") - F.col("AlignStart") <= 0)  # of what is written, so the rows are made once
    guard_empty(flat, "non-positive peptide lengths", "CodeName")
    bad_codes = judged.filter(F.col("reason") == "out_of_bounds_align").select("CodeName").distinct()
    bad_codes = bad_codes.withColumn("_bad", F.lit(True))
    judged = judged.join(bad_codes, "CodeName", "left")
    spread = F.col("reason").isNull() & F.coalesce(F.col("_bad"), F.lit(False))
    judged = judged.withColumn("example", F.when(spread, F.col("CodeName")).otherwise(F.col("example")))
    judged = judged.withColumn("reason", F.when(spread, "out_of_bounds_align").otherwise(F.col("reason")))
    guard_stages(judged, ("missing_align", "missing_protein", "ambiguous_protein", "out_of_bounds_align"))

    kept = judged.filter(F.col("reason").isNull())
    meta = kept.select(
        "CodeName",
        build_fullname_oxx(F.col("ProteinID"), F.lit(oxx)).alias("FullName"),
        "Peptide",
        "AlignStart",
        "AlignStop",
        (F.col("LabelSource") == "reactive").cast("int").alias("Def epitope"),
        F.lit(0).alias("Uncertain"),
        (F.col("LabelSource") == "nonreactive").cast("int").alias("Not epitope"),
        "LabelSource",
        "ProteinID",
        (F.col("AlignStop") - F.col("AlignStart")).alias("PeptideLen"),
    )
    targets = kept.select("ProteinID").distinct().join(sequences.select("ProteinID", "sequence"), "ProteinID").withColumn(
        "header", build_fullname_oxx(F.col("ProteinID"), F.lit(oxx))
    )
    # Rows are reduced to (reason, example) before distinct examples are counted.
    per_example = judged.filter(F.col("reason").isNotNull()).groupBy("reason", "example").agg(
        F.count(F.lit(1)).alias("n"), F.min("source_order").alias("source_order")
    )
    counts = per_example.groupBy("reason").agg(
        F.when(F.col("reason") == "missing_align", F.sum("n")).otherwise(F.count(F.lit(1))).alias("n_dropped")
    )
    examples = drop_report(per_example).select("reason", "examples")
    return EvaluationSubset(meta, targets, counts.join(examples, "reason"), length_summary(meta))


def guard_stages(judged: DataFrame, stages: tuple[str, ...]) -> None:
    """Raise at the first stage (reason) after which no row is left; one row of counts reaches the driver."""
    counts = judged.agg(F.count(F.lit(1)).alias("left"), *[F.count_if(F.col("reason") == s).alias(s) for s in stages]).first()
    left = counts["left"]
    if not left:
        raise ValueError("no rows match the selected codes")
    for stage in stages:
        left -= counts[stage]
        if not left:
            raise ValueError(f"no rows left after {stage}")


def length_summary(meta: DataFrame) -> DataFrame:
    """Selection counts and peptide-length statistics."""
    return meta.agg(
        F.count(F.lit(1)).alias("n_selected_rows"),
        F.count_if(F.col("Def epitope") == 1).alias("n_selected_reactive_rows"),
        F.count_if(F.col("Not epitope") == 1).alias("n_selected_nonreactive_rows"),
        F.min("PeptideLen").alias("peptide_len_min"),
        F.max("PeptideLen").alias("peptide_len_max"),
        F.avg("PeptideLen").alias("peptide_len_mean"),
    )
