"""Mixing sources to target weights by whole copies and one hash-seeded draw.

Sizes are summed per source (combined before the shuffle), targets are poured over the
sources by weight up to ``most`` times each source's size, and every document is
repeated floor(rate) times and once more with the probability left over. The draw is a
hash of seed, key and text, so reruns and other partitionings agree.

Cases: a null text has size 0; null sources are one source, ordered last; a source of
size 0 has target 0; rows that are equal in key and text draw alike; an empty table
gives an empty result; columns with the names of output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

WORDS = "[^\\x20\\x09-\\x0D]+"
SEED = "mixing-1"
#: Sources up to which their targets are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def text_size(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Weights repeat over the sources by code point, null last. Pouring ``share`` of all
    sizes by weight fills the source with the smallest room per weight first: in that
    order a source is full while what is left, dealt to it and all behind it by weight,
    exceeds its room. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("room", most * F.col("source_size"))
    by_room = Window.orderBy((F.col("room") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    everywhere = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everywhere) * F.lit(share)
    per = per.withColumns({
        "left": total - F.coalesce(F.sum("room").over(before), F.lit(0)),
        "sharing": F.sum("weight").over(onward),
    })
    open_level = F.when(F.col("left") * F.col("weight") <= F.col("room") * F.col("sharing"), F.col("left") / F.col("sharing"))
    level = F.first(open_level, ignorenulls=True).over(everywhere)
    target = F.when(F.col("source_size") > 0, F.least(F.col("room").cast("double"), F.coalesce(level * F.col("weight"), F.col("room").cast("double"))))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(seed: str, key: Column, text: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def repetitions(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0, most: int = 3, seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` with the struct ``mix``: size, source_size, target, copies."""
    sizes = docs.select(F.col(source).alias("source"), text_size(F.col(text)).alias("size"))
    targets = source_targets(sizes, weights, share, most).withColumnsRenamed({"source": "__source", "source_size": "__size", "target": "__target"})
    # one row per source, written so that it is counted; only a small table goes to all tasks
    targets = cut_lineage(targets)
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rated = docs.drop("mix").join(targets, docs[source].eqNullSafe(targets["__source"]), "left")
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(seed, F.col(key), F.col(text)) < rate - F.floor(rate)).cast("long")
    mixed = F.struct(text_size(F.col(text)).alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))
    return rated.withColumn("mix", mixed).drop("__source", "__size", "__target")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    names = docs.columns
    carried = docs.select("*") if "mix" not in names else docs.withColumnRenamed("mix", "__mix")
    taken = repetitions(carried, **options).filter("mix.copies > 0").withColumn("mix", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))))
    if "mix" in names:
        taken = taken.drop("mix").withColumnRenamed("__mix", "mix")
    return taken.select(*(F.col(f"`{c}`") for c in names))
