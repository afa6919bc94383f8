"""Assay tables: reactivity classes from z-scores, code-list labels, group ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import (
    accession_of,
    clean_text,
    family_of,
    first_numeric,
    fullname_part,
    is_digits,
)
from spanforge.operators.quality import bad_bounds, first_reason, guard_disjoint, resolve_sequences
from spanforge.operators.ranking import ordered_rank
from spanforge.sources.tables import all_present, require_columns

# Bound columns per source kind, in order of preference, and the
# grouping column of each kind.
START_COLUMNS = {
    "cwp": ("StartIndex", "AlignStart", "Start", "alignStart"),
    "bkp": ("alignStart", "StartIndex", "AlignStart", "Start"),
}
STOP_COLUMNS = {
    "cwp": ("StopIndex", "AlignStop", "Stop", "alignStop"),
    "bkp": ("alignStop", "StopIndex", "AlignStop", "Stop"),
}
GROUP_COLUMNS = {"cwp": "Cluster50ID", "bkp": "reClusterID_70"}


def classify_reactivity(
    scores: DataFrame,
    *,
    id_col: str = "CodeName",
    reactive_min: float = 20.0,
    min_subjects: int = 4,
    nonreactive_max: float = 10.0,
    max_subjects: int | None = None,
) -> DataFrame:
    """Three-way class per id from long z-scores ``(id, subject, z, n_subjects)``.

    A missing score is neither reactive nor nonreactive, and since every subject
    must be nonreactive for ``not`` (unless ``max_subjects`` is set), it blocks
    that class. ``Def epitope`` and ``Not epitope`` are judged independently.
    """
    counts = scores.groupBy(id_col).agg(
        F.count_if(F.col("z") >= reactive_min).alias("n_reactive"),
        F.count_if(F.col("z") < nonreactive_max).alias("n_nonreactive"),
        F.max("n_subjects").alias("n_subjects"),
    )
    is_def = F.col("n_reactive") >= min_subjects
    if max_subjects is None:
        is_not = F.col("n_nonreactive") == F.col("n_subjects")
    else:
        is_not = (F.col("n_nonreactive") >= max_subjects) & (F.col("n_reactive") == 0)
    return counts.select(
        id_col,
        "n_reactive",
        "n_nonreactive",
        is_def.cast("byte").alias("Def epitope"),
        (~is_def & ~is_not).cast("byte").alias("Uncertain"),
        is_not.cast("byte").alias("Not epitope"),
    )


def attach_classes(metadata: DataFrame, classes: DataFrame, *, id_col: str = "CodeName") -> DataFrame:
    """Left merge of metadata with class columns; unmatched rows keep nulls."""
    return metadata.join(classes.select(id_col, "Def epitope", "Uncertain", "Not epitope"), id_col, "left")


def labelled_codes(reactive: DataFrame, nonreactive: DataFrame, mode: str = "combined") -> DataFrame:
    """``(CodeName, LabelSource)`` of two disjoint code sets, or of one of them."""
    mode = str(mode).strip().lower()
    if mode not in ("reactive", "nonreactive", "combined"):
        raise ValueError("mode must be reactive, nonreactive or combined")
    guard_disjoint(reactive, nonreactive, "CodeName", "reactive and nonreactive codes overlap")
    sides = {"reactive": reactive, "nonreactive": nonreactive}
    wanted = list(sides) if mode == "combined" else [mode]
    parts = [sides[n].select("CodeName").distinct().withColumn("LabelSource", F.lit(n)) for n in wanted]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def whole_number(c):
    """A double without fraction as bigint, else null."""
    return F.when(c == F.floor(c), c.cast("bigint"))


def group_ids(df: DataFrame, token: str, offset: int = 0, out: str = "GroupID") -> DataFrame:
    """Number the distinct non-empty tokens in lexical order from ``offset + 1``."""
    tokens = df.select(F.trim(token).alias(token)).filter(F.col(token) != "").distinct()
    ranked = ordered_rank(tokens, [F.col(token)])
    return ranked.select(token, (F.col("rank") + F.lit(offset)).cast("bigint").alias(out))


def listed_sequences(records: DataFrame) -> DataFrame:
    """Unique and ambiguous sequences of a permissive FASTA table, by accession."""
    named = records.select(accession_of(F.col("header")).alias("ProteinID"), "sequence")
    return resolve_sequences(named, "ProteinID")


def scored_sequences(records: DataFrame) -> DataFrame:
    """Unique and ambiguous sequences of a strict FASTA table, by header id."""
    named = records.select(fullname_part(F.col("header"), 1).alias("ProteinID"), "sequence")
    return resolve_sequences(named, "ProteinID")


def quarantine_listed(
    metadata: DataFrame,
    reactive: DataFrame,
    nonreactive: DataFrame,
    sequences: DataFrame,
    kind: str,
) -> DataFrame:
    """Selected code-list rows with their label and, if unusable, a ``reason``.

    The sequence is read where it is joined (length and derived peptide) and not
    carried on, so later shuffles move no sequence text.
    """
    if kind not in GROUP_COLUMNS:
        raise ValueError(f"unsupported kind {kind!r}; expected one of {sorted(GROUP_COLUMNS)}")
    group = GROUP_COLUMNS[kind]
    require_columns(metadata, ["CodeName", "SequenceAccession", group])
    starts = all_present(metadata, START_COLUMNS[kind], "start")
    stops = all_present(metadata, STOP_COLUMNS[kind], "stop")
    peptide = next((c for c in ("PeptideSequence", "Peptide") if c in metadata.columns), None)

    # Membership is tested on the raw code; cleaning comes after.
    rows = metadata.join(labelled_codes(reactive, nonreactive), "CodeName").select(
        clean_text(F.col("CodeName")).alias("CodeName"),
        clean_text(F.col("SequenceAccession")).alias("ProteinID"),
        clean_text(F.col(group)).alias("GroupToken"),
        first_numeric(starts).alias("_start"),
        first_numeric(stops).alias("_stop"),
        (clean_text(F.col(peptide)) if peptide else F.lit("")).alias("_peptide"),
        "LabelSource",
        "source_order",
    )
    rows = rows.join(sequences, "ProteinID", "left")
    start, stop = whole_number(F.col("_start")), whole_number(F.col("_stop"))
    length = F.col("length")
    derived = F.when(
        F.col("_peptide") == "", F.substring("sequence", (start + 1).cast("int"), (stop - start).cast("int"))
    ).otherwise(F.col("_peptide"))
    code, protein = F.col("CodeName"), F.col("ProteinID")
    reason, example = first_reason([
        ("missing_protein_id", protein == "", code),
        ("ambiguous_protein_sequence", F.col("ambiguous"), protein),
        ("missing_protein_sequence", F.col("sequence").isNull(), protein),
        ("missing_group_token", F.col("GroupToken") == "", code),
        ("missing_align_bounds", F.col("_start").isNull() | F.col("_stop").isNull(), code),
        ("invalid_align_bounds", start.isNull() | stop.isNull(), code),
        ("out_of_bounds_align", bad_bounds(start, stop, length), F.concat_ws(":", code, start, stop, length)),
        ("missing_peptide_sequence", derived == "", code),
    ])
    return rows.select(
        "CodeName",
        "ProteinID",
        "GroupToken",
        start.alias("AlignStart"),
        stop.alias("AlignStop"),
        derived.alias("Peptide"),
        (F.col("LabelSource") == "reactive").cast("byte").alias("Def epitope"),
        F.lit(0).cast("byte").alias("Uncertain"),
        (F.col("LabelSource") == "nonreactive").cast("byte").alias("Not epitope"),
        "source_order",
        reason.alias("reason"),
        example.alias("example"),
    )


def quarantine_scored(metadata: DataFrame, classes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Designed-library rows with their class and, if unusable, a ``reason``.

    The first usable row of a protein (in source order) fixes its family; later
    rows of another family are quarantined.
    """
    merged = attach_classes(metadata, classes)
    named = merged.select(
        clean_text(F.col("CodeName")).alias("CodeName"),
        fullname_part(F.col("FullName"), 1).alias("_id"),
        family_of(fullname_part(F.col("FullName"), 3)).alias("_family"),
        F.col("AlignStart").cast("bigint").alias("AlignStart"),
        F.col("AlignStop").cast("bigint").alias("AlignStop"),
        clean_text(F.col("Peptide")).alias("Peptide"),
        "Def epitope",
        "Uncertain",
        "Not epitope",
        "source_order",
    )
    named = named.withColumn("ProteinID", F.coalesce(clean_text(F.col("_id")), F.lit("")))
    named = named.withColumn("GroupToken", F.coalesce(clean_text(F.col("_family")), F.lit("")))
    rows = named.join(sequences, "ProteinID", "left")
    code, protein, family = F.col("CodeName"), F.col("ProteinID"), F.col("GroupToken")
    start, stop, length = F.col("AlignStart"), F.col("AlignStop"), F.col("length")
    reason, example = first_reason([
        ("invalid_fullname", F.col("_family").isNull(), code),
        ("invalid_family", ~is_digits(family), F.concat_ws(":", protein, family)),
        ("ambiguous_protein_sequence", F.col("ambiguous"), protein),
        ("missing_protein_sequence", F.col("sequence").isNull(), protein),
        ("missing_align_bounds", start.isNull() | stop.isNull(), code),
        ("out_of_bounds_align", bad_bounds(start, stop, length), F.concat_ws(":", code, start, stop, length)),
        ("missing_zscore", F.col("Def epitope").isNull(), code),
    ])
    rows = rows.withColumn("reason", reason).withColumn("example", example)
    return first_family_wins(rows.drop("_id", "_family", "ambiguous", "sequence", "length"))


def first_family_wins(
    rows: DataFrame, *, id_col: str = "ProteinID", family: str = "GroupToken", order: str = "source_order"
) -> DataFrame:
    """Quarantine rows whose family differs from their protein's first usable row.

    The first family is an aggregate joined back, not a per-protein window, so a
    protein holding a third of the rows is combined before it shuffles.
    """
    usable = rows.filter(F.col("reason").isNull())
    firsts = usable.groupBy(id_col).agg(F.min(F.struct(order, family)).alias("_first"))
    firsts = firsts.select(id_col, F.col(f"_first.{family}").alias("_fixed"))
    joined = rows.join(firsts, id_col, "left")
    clash = F.col("reason").isNull() & (F.col(family) != F.col("_fixed"))
    example = F.concat_ws(":", F.col(id_col), F.col("_fixed"), F.col(family))
    return (
        joined.withColumn("example", F.when(clash, example).otherwise(F.col("example")))
        .withColumn("reason", F.when(clash, "conflicting_family_for_protein").otherwise(F.col("reason")))
        .drop("_fixed")
    )


def union_sources(*contracts: DataFrame) -> DataFrame:
    """Concatenate prepared contracts of several sources."""
    out = contracts[0]
    for more in contracts[1:]:
        out = out.unionByName(more)
    return out


def distinct_names(names: DataFrame, columns: Sequence[str] = ("Name", "Family")) -> DataFrame:
    """Embedding metadata of several sources without repeats."""
    return names.dropDuplicates(list(columns))
