"""Data-quality gates: quarantine with reasons, consistency guards, set reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """``(reason, example)`` of the first rule that matches a row, null if none.
    A rule is ``(name, condition, example value)``; a null condition does not match."""
    # One expression for both: each condition stands once in the generated code, which else outgrows what the JVM compiles.
    found = F.lit(None).cast("struct<reason:string,example:string>")
    for name, condition, value in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        found = F.when(hit, F.struct(F.lit(name).alias("reason"), value.cast("string").alias("example"))).otherwise(found)
    return found["reason"], found["example"]


def drop_report(quarantined: DataFrame, *, order: str = "source_order", max_examples: int = 20) -> DataFrame:
    """Row count and first-seen distinct examples per reason.

    Examples are reduced to one row each before they are ranked, and the rank
    filter lets every task keep its own top ``max_examples`` before the shuffle.
    """
    rows = quarantined.filter(F.col("reason").isNotNull())
    # Sub-counts per example first: one reason may hold most of the table.
    per_example = rows.groupBy("reason", "example").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")
    )
    counts = per_example.groupBy("reason").agg(F.sum("n").alias("n_rows"))
    by_age = Window.partitionBy("reason").orderBy("first_seen", "example")
    examples = (
        per_example.withColumn("at", F.row_number().over(by_age))
        .filter(F.col("at") <= max_examples)
        .groupBy("reason")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "example"))), lambda s: s["example"])
             .alias("examples"))
    )
    return counts.join(examples, "reason")


def bad_bounds(start: Column, stop: Column, length: Column) -> Column:
    return (start < 0) | (stop <= start) | (stop > length)


def resolve_sequences(records: DataFrame, id_col: str, sequence: str = "sequence") -> DataFrame:
    """``(id, sequence, ambiguous, length)``: an id with differing sequences is ambiguous.
    Comparing the smallest and largest sequence decides it in one combinable pass;
    the length is counted here once, not on every row that joins."""
    low, high = F.min(sequence), F.max(sequence)
    return (
        records.filter(F.col(id_col).isNotNull() & (F.col(id_col) != ""))
        .groupBy(id_col)
        .agg(low.alias(sequence), (low != high).alias("ambiguous"))
        .withColumn("length", F.length(sequence).cast("bigint"))
    )


def guard_empty(violations: DataFrame, message: str, show: str, limit: int = 10) -> None:
    """Raise with the first few examples if the violations table has any row. Sorted, so that
    all partitions are looked at in one job; a bare limit tries them few by few until it is full."""
    found = [str(r[0]) for r in violations.select(show).orderBy(show).limit(limit).collect()]
    if found:
        raise ValueError(f"{message}, examples: {found}")


def guard_disjoint(left: DataFrame, right: DataFrame, column: str, message: str) -> None:
    """Two code sets must not overlap."""
    guard_empty(left.select(column).intersect(right.select(column)), message, column)


def guard_single_group(df: DataFrame, id_col: str, group: str) -> None:
    """Every id must carry one group; null counts as a group."""
    tagged = F.coalesce(F.col(group).cast("string"), F.lit("\u0000"))
    mixed = df.groupBy(id_col).agg(F.min(tagged).alias("a"), F.max(tagged).alias("b")).filter("a <> b")
    guard_empty(mixed, "ids assigned to multiple groups", id_col)


def family_map(df: DataFrame, id_col: str, family: str) -> DataFrame:
    """``(id, family, n_duplicates, conflict)`` of an id -> family table."""
    low, high = F.min(family), F.max(family)
    return df.groupBy(id_col).agg(
        low.alias(family), (F.count(F.lit(1)) - 1).alias("n_duplicates"), (low != high).alias("conflict")
    )


def guarded_family_map(df: DataFrame, id_col: str, family: str) -> DataFrame:
    """The id -> family map; conflicting families raise."""
    mapped = family_map(df, id_col, family)
    guard_empty(mapped.filter("conflict"), "conflicting families", id_col)
    return mapped.drop("conflict")


def dedupe_keys(df: DataFrame, key: str, sequence: str = "sequence", order: str | None = None) -> DataFrame:
    """One row per key; ``conflict`` marks keys that stand for differing sequences."""
    low, high = F.min(sequence), F.max(sequence)
    extra = [F.min(order).alias(order)] if order else []
    return df.groupBy(key).agg(
        low.alias(sequence), (F.count(F.lit(1)) - 1).alias("n_dropped"), (low != high).alias("conflict"), *extra
    )


def shared_across(df: DataFrame, id_col: str, shard: str) -> DataFrame:
    """Ids found in more than one shard, with their shard count."""
    # Distinct pairs first, so a hot id is one row per shard when it shuffles.
    pairs = df.select(id_col, shard).distinct()
    return pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_shards")).filter("n_shards > 1")


def missing_ids(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of ``left`` that ``right`` does not have."""
    return left.select(id_col).distinct().join(right.select(id_col).distinct(), id_col, "left_anti")


def missing_report(left: DataFrame, right: DataFrame, id_col: str, max_examples: int = 20) -> DataFrame:
    """Number of missing ids and the first sorted examples."""
    gone = missing_ids(left, right, id_col)
    examples = gone.orderBy(id_col).limit(max_examples).agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    return gone.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(examples)  # one row each


def check_one_hot(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The job fails on a row whose label columns do not sum to one."""
    total = sum((F.col(f"`{c}`").cast("int") for c in columns), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("invalid one-hot label: "), F.col(name).cast("string"))).cast("string")
    return df.withColumn(name, F.when(total == 1, F.col(name).cast("string")).otherwise(bad))


def label_class(define: Column, negate: Column) -> Column:
    """One-hot pair to label: def, not or uncertain."""
    return F.when(define.cast("int") == 1, "def").when(negate.cast("int") == 1, "not").otherwise("uncertain")


def is_ok(status: Column) -> Column:
    """Status text equals OK, whatever its case or padding."""
    return F.coalesce(F.upper(F.trim(status)) == "OK", F.lit(False))


def run_status(best_epoch: Column, metric: Column) -> Column:
    """OK when an epoch was chosen and its target metric is finite."""
    from spanforge.functions.stats import finite_or_null

    return F.when((best_epoch >= 0) & finite_or_null(metric).isNotNull(), "OK").otherwise("NO_VALID_SCORE")


def rekey_outcome(keys: DataFrame, families: DataFrame, *, delimiter: str = "-") -> DataFrame:
    """Old key -> ``id-family`` key with what a rename would do: renamed, already,
    collision (the new key exists in the same shard) or missing_id."""
    from spanforge.functions.text import parse_key

    parsed = keys.withColumn("_p", parse_key(F.col("key"), delimiter))
    direct = families.select(F.col("id").alias("key"), F.col("family").alias("_direct"))
    named = families.select(F.col("id").alias("_id"), F.col("family").alias("_named"))
    joined = parsed.join(direct, "key", "left").withColumn("_id", F.col("_p.id")).join(named, "_id", "left")
    new_key = F.when(
        F.col("_direct").isNotNull(), F.concat_ws(delimiter, F.col("key"), F.col("_direct"))
    )
    joined = joined.withColumn("new_key", new_key)
    taken = keys.select("shard", F.col("key").alias("new_key"), F.lit(True).alias("_taken")).distinct()
    joined = joined.join(taken, ["shard", "new_key"], "left")
    settled = (F.col("_p.scheme") == "id-family") & (F.col("_named") == F.col("_p.family"))
    outcome = (
        F.when(F.col("_direct").isNotNull(), F.when(F.col("_taken"), "collision").otherwise("renamed"))
        .when(settled, "already")
        .otherwise("missing_id")
    )
    return joined.select("shard", "key", "new_key", outcome.alias("outcome"))


def attach_families(sequences: DataFrame, families: DataFrame, *, id_col: str = "id", required: bool = True) -> DataFrame:
    """Left join of sequences with their normalised family. An unmapped id, or with
    ``required`` an empty family, raises with examples."""
    from spanforge.functions.text import normalize_family

    known = families.select(id_col, F.col("family").cast("string").alias("_raw"), F.lit(True).alias("_mapped"))
    joined = sequences.join(known, id_col, "left").withColumn("family", normalize_family(F.col("_raw")))
    ids = joined.select(id_col, "family", "_mapped")
    guard_empty(ids.filter(F.col("_mapped").isNull()).select(id_col).distinct(), "ids without a family entry", id_col)
    if required:
        guard_empty(ids.filter("family = ''").select(id_col).distinct(), "ids with an empty family", id_col)
    return joined.drop("_raw", "_mapped")


def trainable_ids(vectors: DataFrame, labels: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Ids that have both vectors and labels, with their common length; the job
    fails on an id whose two lengths differ."""
    both = vectors.select(id_col, F.col("length").alias("_v")).join(
        labels.select(id_col, F.col("length").alias("_l")), id_col
    )
    text = F.concat_ws(" ", F.lit("vector and label lengths differ:"), F.col(id_col).cast("string"), F.col("_v"), F.col("_l"))
    same = F.when(F.col("_v") == F.col("_l"), F.col("_v").cast("bigint")).otherwise(F.raise_error(text).cast("bigint"))
    return both.select(id_col, same.alias("length"))
