"""Sharding by a two-pass external shuffle.

Pass one scatters rows over memory-sized buckets by a seeded hash of the whole row. Pass
two puts each bucket into a fixed order, shuffles it by Fisher-Yates with a generator
seeded by the bucket, and hands it on. With the sizes of the buckets before it, a row
knows its place in the whole order; places are dealt to the shards in turn, so shard
sizes differ by one row at most (law ``rows``).

Cases: a null text has size 1; rows that are equal in every column are interchangeable
and share a bucket; nulls hash like any value; an empty table gives an empty result;
columns with the names of output columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 16 << 20
SEED = 20_011


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n rows by swapping each, from the last on, with one at or before it."""
    generator = np.random.Generator(np.random.Philox(key=[seed, bucket]))
    picks = generator.integers(0, np.arange(n, 0, -1)).tolist()
    order = list(range(n))
    for step, pick in enumerate(picks):
        last = n - 1 - step
        order[last], order[pick] = order[pick], order[last]
    return np.array(order, np.int64)


def shuffle_shards(docs: DataFrame, shards: int = 8, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with shard (int) and slot (long, gapless from 0 in each shard)."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    total = docs.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    line = F.xxhash64(F.lit(seed), *(v for c in names for v in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))
    bucket = F.pmod(F.xxhash64(line, F.lit(seed)), F.lit(buckets)).cast("int")
    counts = docs.select(*(F.col(f"`{c}`") for c in names)).select(bucket.alias("__b")).groupBy("__b").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    scattered = rows.withColumns({"__line": line, "__b": bucket}).join(offsets, "__b")

    def shuffle(table: pa.Table) -> pa.Table:
        keys = [("__line", "ascending")] + [(c, "ascending") for c in names if pa.types.is_integer(table.schema.field(c).type)]
        table = table.take(pa.compute.sort_indices(table.select(dict.fromkeys(k for k, _ in keys)), sort_keys=keys))
        order = fisher_yates(table.num_rows, seed, table.column("__b")[0].as_py())
        place = table.column("__before")[0].as_py() + np.arange(table.num_rows)
        out = table.select(names).take(pa.array(order))
        return out.append_column("shard", pa.array(place % shards, pa.int32())).append_column("slot", pa.array(place // shards, pa.int64()))

    schema = rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
    return scattered.groupBy("__b").applyInArrow(shuffle, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each bucket's task writes its rows in slot order."""
    sharded.write.partitionBy("shard").parquet(path)
