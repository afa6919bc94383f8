"""Sinks: prepared contract, label and vector tables, run log, strict JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_columns(df: DataFrame) -> DataFrame:
    """Non-finite floats, also inside structs and arrays, become null (strict JSON)."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    return c


def strict_json(df: DataFrame, out: str = "value") -> DataFrame:
    """One strict JSON document per row; nulls are written, not left out."""
    safe = finite_columns(df)
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    strict_json(df).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, *, sep: str = ",", order: Sequence[str] = ()) -> None:
    """CSV/TSV folder with a header in every part, sorted when an order is given."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Append run rows to the run log, one table with one schema."""
    df.write.mode("append").parquet(path)


def union_by_keys(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns."""
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first


def write_vectors(df: DataFrame, path: str, *, id_col: str = "protein_id", buckets: int = 64) -> None:
    """Per-position vectors, partitioned by a hash bucket of the id."""
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("bucket")
    salted = df.select("*", bucket)
    # Position ranges spread one very long sequence over several writers.
    salted.repartition("bucket", id_col, F.floor(F.col("pos") / 65536)).write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(path)


def write_labels(segments: DataFrame | None, peptides: DataFrame, stats: DataFrame, path: str) -> None:
    """Label store of one build: run-length labels (None: written already), peptide lists and class counts."""
    if segments is not None:
        segments.write.mode("overwrite").parquet(f"{path}/labels")
    peptides.write.mode("overwrite").parquet(f"{path}/proteins")
    stats.write.mode("overwrite").parquet(f"{path}/class_stats")


def write_prepared(contract: DataFrame, embedding_names: DataFrame, targets: DataFrame, summary: DataFrame,
                   path: str) -> None:
    """The prepared-dataset contract: FASTA, two TSVs and a summary, all sorted."""
    from spanforge.sources.fasta import write_fasta

    write_fasta(targets, f"{path}/prepared_targets.fasta", order=[F.col("ProteinID")])
    write_table(contract, f"{path}/prepared_labels_metadata.tsv", sep="\t",
                order=["ProteinID", "AlignStart", "CodeName"])
    names = embedding_names.orderBy("ProteinID").select("Name", "Family")
    names.write.mode("overwrite").option("header", True).option("sep", "\t").csv(
        f"{path}/prepared_embedding_metadata.tsv"
    )
    write_json(summary, f"{path}/prepare_summary.json")
