"""Label job: prepared contract and sequence lengths to painted labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import fullname_part
from spanforge.operators.intervals import checked_bounds, class_stats, paint, peptide_lists
from spanforge.operators.quality import check_one_hot, label_class
from spanforge.sources.sinks import write_labels

LABEL_COLUMNS = ("Def epitope", "Uncertain", "Not epitope")


@dataclass(frozen=True)
class Labels:
    """Outputs of a label build; every table is lazy."""

    segments: DataFrame
    proteins: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        """Write all three; labels are painted once, and counted from what was written."""
        self.segments.write.mode("overwrite").parquet(f"{path}/labels")
        painted = self.segments.sparkSession.read.parquet(f"{path}/labels")
        write_labels(None, self.proteins, class_stats(painted), path)


def build_labels(
    contract: DataFrame, lengths: DataFrame, *, restrict_to_lengths: bool = False, list_parts: int = 1
) -> Labels:
    """Paint the contract's peptides onto sequences of known ``(id, length)``.

    A label row that is not one-hot, an interval outside its sequence or, unless
    restricted, a peptide of an unknown sequence fails the job.
    """
    order = F.struct("AlignStart", "CodeName") if "source_order" not in contract.columns else F.col("source_order")
    rows = check_one_hot(contract, LABEL_COLUMNS, "CodeName").select(
        fullname_part(F.col("FullName"), 1).alias("id"),
        F.col("AlignStart").cast("bigint").alias("start"),
        F.col("AlignStop").cast("bigint").alias("stop"),
        label_class(F.col("`Def epitope`"), F.col("`Not epitope`")).alias("label"),
        F.col("CodeName").alias("code_name"),
        F.col("Peptide").alias("peptide"),
        F.col("FullName").alias("fullname"),
        order.alias("source_order"),
    )
    if restrict_to_lengths:
        rows = rows.join(lengths.select("id"), "id", "left_semi")
        if rows.isEmpty():
            raise ValueError("no peptide belongs to an embedded sequence")
    rows = checked_bounds(rows, lengths, name="code_name")
    labelled = lengths.join(rows.select("id").distinct(), "id", "left_semi")
    segments = paint(rows, labelled, rows=contract.count())  # at most so many: nothing joined is counted
    return Labels(segments, peptide_lists(rows, parts=list_parts), class_stats(segments))
