"""Resumable embedding job: a store of packed vectors and its index of 13 columns.

The index is the commit record. A run embeds the keys that the index does not have, writes
their blocks below ``blocks/run=<name>`` and, last, appends their index rows in one commit.
Beside the blocks a run's folder keeps border strips and errors, in columns that readers skip.
A run that failed before that leaves blocks that no index row names: readers do not see
them, and the same run may be started again. Failed sequences are reported and stay missing,
so the next run tries them again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import build_key, clean_sequence, strip
from spanforge.operators.blocks import STORED, finish_borders, finish_windows, pieces_schema, store as store_block
from spanforge.operators.quality import guard_empty
from spanforge.operators.scoring import MAX_TOKENS, spans_of, unpack_blocks
from spanforge.session import cut_lineage

# The columns of the index, the kinds of keys, and how blocks are stored.
INDEX = (
    "id string, protein_id string, viral_family string, key_mode string, key_delimiter string, length bigint, embed_dim int, "
    "original_seq_len bigint, seq_len_feature string, handle string, model string, storage string, file_path string")
KEY_MODES = ("id", "id-family")
STORAGE = "parquet"
PIECES = pieces_schema("string", STORED)
CODEC = "zstd"
#: Keys that are sent to all tasks at most.
BROADCAST_KEYS = 500_000


def read_index(spark: SparkSession, store: str) -> DataFrame:
    """The index of a store; empty where there is none yet."""
    try:
        return spark.read.schema(INDEX).parquet(f"{store}/index")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def keyed_sequences(records: DataFrame, key_mode: str = "id-family", delimiter: str = "-") -> DataFrame:
    """``(id, protein_id, viral_family, sequence)`` of records ``(protein_id, family, sequence)``; id is the key."""
    if key_mode not in KEY_MODES:
        raise ValueError(f"key_mode must be one of {KEY_MODES}")
    pid, family = strip(F.col("protein_id").cast("string")), F.col("family").cast("string")
    key = pid if key_mode == "id" else build_key(F.col("protein_id"), F.col("family"), delimiter)
    return records.select(
        key.alias("id"), pid.alias("protein_id"), F.coalesce(strip(family), F.lit("")).alias("viral_family"),
        clean_sequence(F.col("sequence")).alias("sequence"))


def key_table(keyed: DataFrame) -> DataFrame:
    """One row per key: ``(id, protein_id, viral_family, n, n_records, conflict)``. Digests are compared, not texts."""
    sizes = keyed.select(
        "id", F.struct("protein_id", "viral_family").alias("who"), F.unhex(F.sha2("sequence", 256)).alias("d"),
        F.length("sequence").cast("bigint").alias("n"))
    return sizes.groupBy("id").agg(
        F.min("who").alias("who"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_records"), (F.min("d") != F.max("d")).alias("conflict"),
    ).select("id", "who.*", "n", "n_records", "conflict")


def guard_keys(keys: DataFrame, index: DataFrame) -> None:
    """A key must stand for one sequence, here and in the store."""
    guard_empty(keys.filter("conflict"), "conflicting sequences for one embedding key", "id")
    stored = index.select("id", "original_seq_len")
    guard_empty(keys.join(stored, "id").filter("n <> original_seq_len"), "stored embedding keys with another sequence", "id")


def wanted(texts: DataFrame, keys: DataFrame, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(texts, keep)``: of the texts ``(id, sequence)`` and their windows those of the keys ``(id, n, n_records)``,
    one where several records have a key. No text is shuffled for that: a few keys go to all tasks, and of many
    the windows are matched in the exchange that deals them (never by a broadcast: Spark would judge the size of
    their list by the packed file)."""
    starts = keys.select("id", F.explode(spans_of(F.col("n"), max_tokens)).alias("w")).select("id", "w.start")
    few, repeated = keys.count() <= BROADCAST_KEYS, not keys.filter("n_records > 1").isEmpty()

    def keep(windows: DataFrame) -> DataFrame:
        kept = windows if few else windows.join(starts.hint("merge"), ["id", "start"], "left_semi")
        return kept.dropDuplicates(["id", "start"]) if repeated else kept

    return texts.join(F.broadcast(keys.select("id")), "id", "left_semi") if few else texts, keep


def embed_missing(
    records: DataFrame,
    embed: Callable[[Sequence[str]], Sequence[np.ndarray]],
    store: str,
    run: str,
    *,
    key_mode: str = "id-family",
    delimiter: str = "-",
    feature: str = "none",
    model: str = "",
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Embed what the store lacks and commit it; returns the failures ``(id, error)`` of this run.

    Texts are not written: ``records`` are read for their digests and lengths, and once more to be
    cut, so they must give the same rows both times. Vectors are written once, straight into the
    store, beside the strips that meet at the windows' borders.
    """
    spark = records.sparkSession
    index = read_index(spark, store)
    keyed = keyed_sequences(records, key_mode, delimiter)
    keys = cut_lineage(key_table(keyed))
    guard_keys(keys, index)
    missing = cut_lineage(keys.join(index.select("id"), "id", "left_anti"))
    blank = missing.filter("n = 0").select("id", F.lit("empty after cleaning").alias("error"))
    todo = missing.filter("n > 0")
    if todo.isEmpty():
        return blank
    path = f"{store}/blocks/run={run}"
    if not index.filter(F.col("file_path") == path).isEmpty():
        raise ValueError(f"run {run!r} is committed already; a new run needs a new name")

    def finish():
        return store_block

    texts, keep = wanted(keyed.select("id", "sequence"), todo, max_tokens)
    pieces = finish_windows(texts, embed, finish, STORED, feature=feature, max_tokens=max_tokens, keep=keep)
    pieces.write.option("compression", CODEC).mode("overwrite").parquet(path)
    written = spark.read.schema(PIECES).parquet(path)
    finish_borders(written, finish, STORED, feature=feature).write.option("compression", CODEC).mode("append").parquet(path)
    # Written on their own: a run of which nothing was committed may be started again, over its folder.
    failures = cut_lineage(written.filter(F.col("error").isNotNull()).groupBy("id").agg(F.min("error").alias("error")))
    sizes = _run_blocks(spark, path).groupBy("id").agg(F.sum("n").alias("length"), F.max("dim").alias("embed_dim"))
    text = lambda value: F.lit(value)
    n = F.col("n")
    rows = todo.join(failures, "id", "left_anti").join(sizes, "id").select(
        "id", "protein_id", "viral_family", text(key_mode).alias("key_mode"), text(delimiter if key_mode == "id-family" else "").alias("key_delimiter"),
        "length", "embed_dim", n.alias("original_seq_len"), text(feature).alias("seq_len_feature"),
        F.when(n <= max_tokens, "short").otherwise("long").alias("handle"), text(model).alias("model"), text(STORAGE).alias("storage"),
        text(path).alias("file_path"))
    rows.write.mode("append").parquet(f"{store}/index")
    return failures.unionByName(blank)


def _run_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n, dim, block)`` of a run's folder, those of its failed sequences too."""
    rows = spark.read.schema(PIECES).parquet(path).filter(F.col("start").isNotNull())
    older = F.raise_error(F.concat(F.lit("blocks of an older layout, embed them anew: "), F.lit(path))).cast("int")
    return rows.select("id", "start", "n", F.coalesce("dim_out", older).alias("dim"), "block")


def stored_blocks(spark: SparkSession, store: str) -> DataFrame:
    """``(id, start, n, dim, block)`` of all committed runs; runs that are not in the index are not read."""
    index = read_index(spark, store)
    paths = sorted(r["file_path"] for r in index.select("file_path").distinct().collect())  # one per run
    found = None
    for path in paths:
        rows = _run_blocks(spark, path).withColumn("of", F.lit(path))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "id string, start bigint, n bigint, dim int, block binary")
    # A run's folder has blocks of ids that failed in another window. Ids are compared alone, so that no block is
    # shuffled where there are none.
    kept = index.select("id", F.col("file_path").alias("of"))
    failed = cut_lineage(found.select("id", "of").distinct().join(kept, ["id", "of"], "left_anti"))
    return (found if failed.isEmpty() else found.join(failed, ["id", "of"], "left_anti")).drop("of")


def stored_vectors(blocks: DataFrame) -> DataFrame:
    """``(id, pos, vec)`` of packed blocks, for what works on positions."""
    return unpack_blocks(blocks, "float")
