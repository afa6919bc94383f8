"""FASTA reader and writer on Spark's text source.

Records are split by the reader itself (line separator ``\\n>``), so one large
file is read by many tasks and no record is assembled in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import FULLNAME_PATTERN, strip
from spanforge.operators.ranking import ordered_rank
from spanforge.session import cut_lineage


def source_order() -> Column:
    """Position of a row in its files. Rows compare alike however files are packed into
    tasks; the ``row`` itself differs between scans, so it is a key in one written table
    only (see :func:`record_numbers`)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_fasta(
    spark: SparkSession,
    path: str | list[str],
    *,
    mode: str = "permissive",
    preamble: bool = True,
) -> DataFrame:
    """One row per record, with its ``source_order``.

    ``permissive`` gives ``(header, sequence)`` for any header; ``fullname``
    gives the header up to a second ``>``; ``strict`` gives ``(id, ac, oxx,
    sequence)`` and fails the job on a header that is not ``ID= AC= OXX=``.
    White space and blank lines inside a record vanish. Text before a file's
    first header is dropped, which takes a scan that keeps one row per file;
    ``preamble=False`` saves it for files known to start with ``>``.
    """
    if mode not in ("permissive", "fullname", "strict"):
        raise ValueError(f"unknown FASTA mode {mode!r}")
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", source_order().alias("source_order"))
    if preamble:
        raw = _without_preamble(raw)
    text = F.regexp_replace("value", r"^\s*>", "")
    header = strip(F.substring_index(text, "\n", 1))
    rest = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n"), F.length(text))).otherwise("")
    out = raw.filter(strip(F.col("value")) != "").select(
        header.alias("header"), F.regexp_replace(rest, r"\s", "").alias("sequence"), "source_order"
    )
    if mode == "permissive":
        return out
    if mode == "fullname":
        return out.withColumn("header", strip(F.substring_index("header", ">", 1)))
    bad = F.raise_error(F.concat(F.lit("FASTA header is not ID= AC= OXX=: "), F.col("header"))).cast("string")
    checked = F.when(F.col("header").rlike(FULLNAME_PATTERN), F.col("header")).otherwise(bad)
    parts = [F.regexp_extract(checked, FULLNAME_PATTERN, g).alias(n) for g, n in ((1, "id"), (2, "ac"), (3, "oxx"))]
    return out.select(*parts, "sequence", "source_order")


def _without_preamble(raw: DataFrame) -> DataFrame:
    """Drop each file's first record unless it starts with ``>``.

    Only a file's first record keeps its marker. The usual file has no such text, so
    this costs one scan that keeps a row per file. If there is any, the numbered records
    are written once and the stray ones are taken out of that table, where row numbers
    are the same for every reader.
    """
    row = F.col("source_order.row")

    def stray(records: DataFrame) -> DataFrame:
        marked = F.col("value").rlike(r"^\s*>")
        heads = records.filter(F.col("source_order.block") == 0).groupBy("source_order.file").agg(
            F.min(row).alias("head"), F.min_by(marked, row).alias("marked")
        )
        return heads.filter(~F.col("marked")).select("head")

    if stray(raw).isEmpty():
        return raw
    written = cut_lineage(raw)
    return written.join(stray(written), row == F.col("head"), "left_anti")


def record_numbers(records: DataFrame, out: str = "id") -> DataFrame:
    """Number written records from 1 in the order of their files, whatever the packing.

    The rows of one file block are read one after another, so a record's number is its
    distance from the block's first row plus the rows of all blocks before. The running
    total is over one row per block. Records dropped by the reader leave gaps.
    """
    records = cut_lineage(records)
    row = F.col("source_order.row")
    blocks = records.groupBy("source_order.file", "source_order.block").agg(
        F.min(row).alias("_first"), (F.max(row) - F.min(row) + 1).alias("_rows")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.struct("file", "block").alias("_at"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    at = F.struct("source_order.file", "source_order.block")
    return records.join(blocks, at == F.col("_at")).withColumn(
        out, F.col("_before") + row - F.col("_first") + 1
    ).drop("_at", "_first", "_before")


def fasta_lines(df: DataFrame, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """One ``value`` per record, ready for the text sink."""
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value"))


def number_missing_headers(df: DataFrame, order: Sequence[Column], header: str = "header") -> DataFrame:
    """Rows without a header get ``sequence_00001``-style names by position."""
    ranked = ordered_rank(df, order, out="_position")
    named = F.coalesce(F.col(header), F.format_string("sequence_%05d", F.col("_position")))
    return ranked.withColumn(header, named).drop("_position", "total_n")


def write_fasta(
    df: DataFrame, path: str, *, header: str = "header", sequence: str = "sequence", order: Sequence[Column] = ()
) -> None:
    """Write records as a folder of FASTA parts, globally sorted when an order is given."""
    ordered = df.orderBy(*order) if order else df
    fasta_lines(ordered, header, sequence).write.mode("overwrite").text(path)
