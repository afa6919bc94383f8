"""Tabular sources: peptide metadata, wide z-score matrices, code lists, indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import (
    CODE_HEADER_WORDS,
    align_suffix,
    null_tokens_to_null,
    numeric,
    strip,
    strip_align_suffix,
)
from spanforge.sources.fasta import source_order


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str], what: str) -> str:
    """First candidate column that exists."""
    return all_present(df, candidates, what)[0]


def all_present(df: DataFrame, candidates: Sequence[str], what: str) -> list[str]:
    """Existing candidate columns, in candidate order."""
    found = [c for c in candidates if c in df.columns]
    if not found:
        raise ValueError(f"no {what} column among {list(candidates)}; available: {df.columns}")
    return found


def read_tsv(spark: SparkSession, path: str | list[str], required: Sequence[str] = ()) -> DataFrame:
    """All-string TSV with missing-value tokens as null and the rows' ``source_order``."""
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, required)
    cells = [null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    return raw.select(*cells, source_order().alias("source_order"))


def read_assay_metadata(
    spark: SparkSession,
    path: str | list[str],
    *,
    id_col: str = "FullName",
    category: str = "Category",
    start_col: str = "AlignStart",
    stop_col: str = "AlignStop",
    drop_cols: Sequence[str] = (),
) -> DataFrame:
    """Peptide metadata of the designed-library kind: only ``SetCover`` rows,
    bounds read off the OXX suffix, the suffix removed from the full name."""
    table = read_tsv(spark, path, [id_col, category]).filter(F.col(category) == "SetCover")
    return (
        table.withColumn(start_col, align_suffix(F.col(id_col), 1))
        .withColumn(stop_col, align_suffix(F.col(id_col), 2))
        .withColumn(id_col, strip_align_suffix(F.col(id_col)))
        .drop(*drop_cols)
    )


def read_zscores(
    spark: SparkSession,
    path: str | list[str],
    *,
    z_id_col: str = "Sequence name",
    id_col: str = "CodeName",
    prefix: str = "VW_",
) -> DataFrame:
    """Long ``(id, subject, z, n_subjects)`` view of a wide z-score table."""
    wide = read_tsv(spark, path, [z_id_col]).withColumnRenamed(z_id_col, id_col)
    return unpivot_scores(wide, id_col, [c for c in wide.columns if c.startswith(prefix)])


def unpivot_scores(wide: DataFrame, id_col: str, subjects: Sequence[str]) -> DataFrame:
    """Unpivot subject columns; the subject count is the header's, so a missing
    value still counts as a subject."""
    if not subjects:
        raise ValueError("no subject columns")
    narrow = wide.select(F.col(id_col), *[numeric(F.col(f"`{c}`")).alias(c) for c in subjects])
    return narrow.unpivot([id_col], list(subjects), "subject", "z").withColumn("n_subjects", F.lit(len(subjects)))


def read_codes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct ``CodeName`` values of a list's first column, header words skipped."""
    lines = spark.read.text(path)
    code = strip(F.regexp_replace(F.split("value", "\t")[0], '^"|"$', ""))
    codes = lines.select(code.alias("CodeName"))
    return codes.filter((F.col("CodeName") != "") & ~F.lower("CodeName").isin(*CODE_HEADER_WORDS)).distinct()


def embedding_index(vectors: DataFrame, *, id_col: str = "protein_id", family: str = "family") -> DataFrame:
    """One row per embedded id; an id under two keys or families fails the job."""
    keys = vectors.groupBy(id_col).agg(
        F.count_distinct("key").alias("n_keys"),
        F.min("key").alias("key"),
        F.min(family).alias(family),
        F.max(F.coalesce(F.col(family), F.lit(""))).alias("_hi"),
        F.min(F.coalesce(F.col(family), F.lit(""))).alias("_lo"),
        F.max("length").alias("length"),
    )
    clash = (F.col("n_keys") > 1) | (F.col("_hi") != F.col("_lo"))
    error = F.raise_error(F.concat(F.lit("id with several embeddings or families: "), F.col(id_col).cast("string")))
    return keys.withColumn("key", F.when(clash, error.cast("string")).otherwise(F.col("key"))).drop(
        "n_keys", "_hi", "_lo"
    )


def label_index(labels: DataFrame, *, id_col: str = "protein_id", shard: str = "shard") -> DataFrame:
    """Where each id's labels live; the last shard in name order wins."""
    return labels.groupBy(id_col).agg(F.max(shard).alias(shard))


def keep_last_shard(labels: DataFrame, *, id_col: str = "protein_id", shard: str = "shard") -> DataFrame:
    """Only the label rows of each id's winning shard."""
    return labels.join(label_index(labels, id_col=id_col, shard=shard), [id_col, shard], "left_semi")
