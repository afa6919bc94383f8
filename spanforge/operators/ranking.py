"""Running totals and ranks over a total order, without a one-task window.

Rows are cut into ordered blocks, each block is summed, and the (small) block
table is accumulated; every row then needs only its own block plus the block's
offset. Blocks are found in two steps: a few outer bounds stand in the plan as
literals, the bounds inside an outer block come from a written table that is joined
on the outer number, so the number of blocks has no ceiling. A block number is a
pure function of the row's sort values and of those fixed bounds, so a recomputed
partition (lost executor) lands in the same block as before.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.session import cut_lineage, shuffle_width

_SAMPLES_PER_BLOCK = 40
#: Blocks up to which all bounds are literals; beyond, outer blocks have sub-blocks.
FLAT = 256
#: Accuracy of a quantile sketch (its rank error is about 2.3 / SKETCH), and sketches merged first.
SKETCH, MERGED = 4096, 64


@dataclass(frozen=True)
class Bounds:
    """Ascending outer bounds and, for many blocks, a table ``(outer, cuts)`` of the bounds inside."""

    outer: tuple[Column, ...] = ()
    inner: DataFrame | None = None
    most: int = 0

    def blocked(self, df: DataFrame, key: Column, out: str = "_block") -> DataFrame:
        """``df`` with the block number of ``key``; a null key is in the first block."""
        outer = F.coalesce(search_block(key, self.outer), F.lit(0))
        if self.inner is None:
            return df.withColumn(out, outer)
        # One row per outer block, at most the square root of the blocks.
        joined = df.withColumn("_outer", outer).join(F.broadcast(self.inner), "_outer", "left")
        inside = F.coalesce(_search(key, F.col("_cuts"), self.most), F.lit(0))
        return joined.withColumn(out, F.col("_outer") * (self.most + 1) + inside).drop("_outer", "_cuts")


def search_block(key: Column, bounds: Sequence[Column]) -> Column:
    """How many of the ascending ``bounds`` are <= ``key``, by binary search."""
    return _search(key, F.array(*bounds), len(bounds)) if bounds else F.lit(0)


def _search(key: Column, table: Column, size: int) -> Column:
    steps = [1 << b for b in reversed(range(size.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at),
    )


def _sketched(keyed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quantile sketch of ``k`` per ``by``: made in groups of tasks, then merged, so no task merges them all."""
    grouped = keyed.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    parts = grouped.groupBy(*by, "_part").agg(F.kll_sketch_agg_double("k", F.lit(SKETCH)).alias("s"))
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("s").alias("s"))


def _even(n: int) -> Column:
    return F.array(*[F.lit(i / n) for i in range(1, n)])


def _levels(n_blocks: int) -> tuple[int, int]:
    """(outer blocks, sub-blocks of each)."""
    if n_blocks <= FLAT:
        return n_blocks, 1
    outer = math.isqrt(n_blocks - 1) + 1
    return outer, -(-n_blocks // outer)


def numeric_bounds(df: DataFrame, key: Column, n_blocks: int | None = None) -> Bounds:
    """Block bounds of one numeric key: a pass that reads that key alone, a second one for many blocks."""
    outer_blocks, inner_blocks = _levels(n_blocks or shuffle_width(df))
    if outer_blocks < 2:
        return Bounds()
    keyed = df.select(key.cast("double").alias("k")).filter(F.col("k").isNotNull() & ~F.isnan("k"))
    filled = _sketched(keyed).filter(F.kll_sketch_get_n_double("s") > 0)
    found = filled.select(F.kll_sketch_get_quantile_double("s", _even(outer_blocks)).alias("b")).first()
    cuts = sorted(set(found["b"])) if found else []
    outer = tuple(F.lit(c) for c in cuts)
    if inner_blocks < 2 or not cuts:
        return Bounds(outer)
    inside = _sketched(keyed.withColumn("_outer", search_block(F.col("k"), outer)), ["_outer"])
    # Sketches draw at random: what they say is fixed by writing it.
    table = cut_lineage(inside.select("_outer", F.array_sort(F.array_distinct(
        F.kll_sketch_get_quantile_double("s", _even(inner_blocks)))).alias("_cuts")))
    return Bounds(outer, table, inner_blocks - 1)


def composite_bounds(df: DataFrame, order: Sequence[Column], n_blocks: int | None = None) -> Bounds:
    """Block bounds for several sort keys, from a bounded row sample per level.

    Needed when the first key repeats: a third of all rows may share one score,
    and only the tie-breaking keys can divide them.
    """
    outer_blocks, inner_blocks = _levels(n_blocks or shuffle_width(df))
    if outer_blocks < 2:
        return Bounds()
    keyed = df.select(_composite(order).alias("k"))
    drawn = keyed.orderBy(F.rand(17)).limit(_SAMPLES_PER_BLOCK * outer_blocks)
    ordered = drawn.orderBy("k").collect()
    fields = keyed.schema["k"].dataType.fields
    picks = sorted({i * len(ordered) // outer_blocks for i in range(1, outer_blocks)} - {0}) if ordered else []
    outer = tuple(
        F.struct(*[F.lit(ordered[i]["k"][j]).cast(f.dataType).alias(f.name) for j, f in enumerate(fields)]) for i in picks)
    if inner_blocks < 2 or not outer:
        return Bounds(outer)
    placed = keyed.withColumn("_outer", search_block(F.col("k"), outer))
    counts = placed.groupBy("_outer").agg(F.count(F.lit(1)).alias("n"))
    wanted = _SAMPLES_PER_BLOCK * inner_blocks
    # One row per outer block says which share of its rows is drawn.
    sample = placed.join(F.broadcast(counts), "_outer").filter(F.rand(18) * F.col("n") < wanted)
    drawn = sample.groupBy("_outer").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    at = F.transform(F.sequence(F.lit(1), F.lit(inner_blocks - 1)), lambda i: F.floor(i * F.size("ks") / inner_blocks).cast("int"))
    cuts = F.transform(F.array_distinct(at), lambda i: F.get("ks", i))
    return Bounds(outer, cut_lineage(drawn.select("_outer", cuts.alias("_cuts"))), inner_blocks - 1)


def _composite(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])


def hash_block(hex_digest: Column, n_blocks: int) -> Column:
    """Block column for an md5 sort key: digests are uniform, so no pass is needed."""
    head = F.conv(F.substring(hex_digest, 1, 6), 16, 10).cast("bigint")
    return F.floor(head * F.lit(n_blocks) / F.lit(1 << 24)).cast("int")


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    measures: Mapping[str, Column],
    keys: Sequence[str] = (),
    *,
    block: Column | None = None,
    bounds: Bounds | None = None,
    n_blocks: int | None = None,
    peek: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``measures`` in ascending ``order`` within ``keys``.

    Each measure ``m`` adds ``cum_m`` (up to and including the row) and
    ``total_m`` (over the key). Each column ``c`` in ``peek`` adds ``next_c``,
    its value on the following row, also across block borders. Null
    ``keys`` are one key more. The block table has at most blocks x keys rows. ``bounds``
    of the (single, numeric) order spare the pass that finds them, ``block`` is a column
    that already numbers the blocks.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(order))]
    sorted_by = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    if block is not None:
        # A null-free block keeps the join from pushing a null test on it to the scan.
        blocked = sorted_by.withColumn("_block", F.coalesce(block, F.lit(0)))
    elif bounds is not None or (len(order) == 1 and _is_numeric(df, order[0])):
        bounds = numeric_bounds(df, order[0], n_blocks) if bounds is None else bounds
        blocked = bounds.blocked(sorted_by, F.col(names[0]).cast("double"))
    else:
        blocked = composite_bounds(df, order, n_blocks).blocked(sorted_by, _composite([F.col(n) for n in names]))
    sums = [F.sum(c).alias(f"_sum_{m}") for m, c in measures.items()]
    lowest = names[0] if len(names) == 1 else F.struct(*names)
    first = [F.min_by(c, lowest).alias(f"_first_{c}") for c in peek]
    per_block = blocked.groupBy(*keys, "_block").agg(*sums, *first)

    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*keys, "_block"]
    for m in measures:
        columns.append(F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_off_{m}"))
        columns.append(F.sum(f"_sum_{m}").over(whole).alias(f"total_{m}"))
    columns += [F.lead(f"_first_{c}").over(whole.orderBy("_block")).alias(f"_next_{c}") for c in peek]
    offsets = per_block.select(*columns)
    if not keys:
        offsets = F.broadcast(offsets)  # one narrow row per block

    local = Window.partitionBy(*keys, "_block").orderBy(*names)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = [(F.sum(c).over(running) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m, c in measures.items()]
    added += [F.coalesce(F.lead(c).over(local), F.col(f"_next_{c}")).alias(f"next_{c}") for c in peek]
    totals = [f"total_{m}" for m in measures]
    return join_keys(blocked, offsets, [*keys, "_block"]).select(*df.columns, *totals, *added)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which a null equals a null; ``right``'s keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(renamed, on).drop(*(f"_on_{k}" for k in keys))


def _is_numeric(df: DataFrame, column: Column) -> bool:
    return isinstance(df.select(column.alias("c")).schema["c"].dataType, T.NumericType)


def ordered_rank(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    *,
    out: str = "rank",
    block: Column | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """1-based rank ``out`` and group size ``total_n`` within ``keys``; order must be total."""
    ranked = prefix_sums(df, order, {"n": F.lit(1)}, keys, block=block, n_blocks=n_blocks)
    return ranked.withColumnRenamed("cum_n", out)


def seeded_digest(seed: int, *parts: Column) -> Column:
    """md5 of ``seed:part[:part...]``: a seeded order any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_rank(
    df: DataFrame, seed: int, id_col: str, keys: Sequence[str] = (), *, out: str = "rank", n_blocks: int | None = None
) -> DataFrame:
    """Rank of every id in the seeded order; ids are unique, digests decide, ids break ties."""
    tagged = df.withColumn("_digest", seeded_digest(seed, F.col(id_col)))
    block = hash_block(F.col("_digest"), n_blocks or shuffle_width(df))
    return ordered_rank(tagged, [F.col("_digest"), F.col(id_col)], keys, out=out, block=block).drop("_digest")


def keep_downsampled(df: DataFrame, index: str, total: str, max_points: int) -> DataFrame:
    """Keep the rows whose 0-based ``index`` survives downsampling of ``total`` points.

    The test is local to the row: an index is kept when some grid slot floors to
    it, so no index list is joined.
    """
    if max_points < 2:
        raise ValueError("max_points must be >= 2")
    n, i = F.col(total), F.col(index)
    step = (n - 1).cast("double") / F.lit(float(max_points - 1))
    slot = F.floor(i / step)
    hits = [F.floor((slot + d) * step) == i for d in (-1, 0, 1, 2)]
    inside = [(slot + d >= 0) & (slot + d < max_points - 1) for d in (-1, 0, 1, 2)]
    kept = F.lit(False)
    for hit, ok in zip(hits, inside):
        kept = kept | (hit & ok)
    return df.filter((n <= max_points) | (i == n - 1) | kept)


def round_robin_shards(df: DataFrame, order: Sequence[Column], n_shards: int, out: str = "shard") -> DataFrame:
    """Every n-th row of the sorted order goes to the same shard."""
    if n_shards < 1:
        raise ValueError("n_shards must be >= 1")
    return ordered_rank(df, order).withColumn(out, F.pmod(F.col("rank") - 1, F.lit(n_shards)))


def contiguous_chunks(df: DataFrame, order: Sequence[Column], n_chunks: int, out: str = "chunk") -> DataFrame:
    """Cut the sorted order into ``n_chunks`` runs; the first (N mod n) runs get one row more."""
    if n_chunks < 1:
        raise ValueError("n_chunks must be >= 1")
    ranked = ordered_rank(df, order)
    position, total = F.col("rank") - 1, F.col("total_n")
    base, extra = F.floor(total / n_chunks), F.pmod(total, F.lit(n_chunks))
    head = extra * (base + 1)
    chunk = F.when(position < head, F.floor(position / (base + 1))).otherwise(
        extra + F.floor((position - head) / F.greatest(base, F.lit(1)))
    )
    return ranked.withColumn(out, chunk.cast("bigint"))


def is_grid_rank(rank: Column, total: Column, start: int, step: int) -> Column:
    """Whether a rank is on the K grid: a row-local test, so the grid is never joined."""
    return ((rank >= start) & (F.pmod(rank - start, F.lit(step)) == 0)) | (rank == total)


def first_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order (the subset option); top-k per partition, then merge."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return df.orderBy(*order).limit(k)

