"""Merkle manifest of a table: one tree per group, the groups' roots joined by one more tree.

A row's leaf is the SHA-256 of its fields, each written as byte count and value. Leaves of
a group stand in ascending order; every ``RUN`` consecutive nodes become their parent until
one node is left. The range-sorted rows are written with a row number, so a leaf's place
needs only the rows before its part of its group (one small row per part and group).

Every aligned block of ``BLOCK`` leaves climbs ``LEVELS`` levels alone: a level is one
string of hex digests, a parent is the hash of a fixed-width substring of it, and the
siblings of a node are the substrings to its left and right. The blocks' roots are the
leaves of the next round, so a round has ``BLOCK`` times fewer rows than the one before,
and no block or group is ever larger than ``BLOCK`` nodes. Proofs are handed down from the
last round to the first, block by block, so a group that holds most rows is no hot key.
All of it is built-in functions.

Cases: a null field is written ``-``; empty and very long texts are hashed whole; null
groups form one group, the first; null orders come first; rows that tie are ordered by
their leaf, so repeated rows are interchangeable; an empty table gives an empty result;
columns that are not named are not read, and those named may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

from .components import counted

RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
#: Hex characters of a digest.
HEX = 64
#: Bits of a generated row number below the number of its part.
PART_BITS = 33


def encoded(field: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    value = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (tree, at, digest, carry) with pos (0-based in the tree) and n (rows of the tree)."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", "at", "digest")]
    numbered = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("part", F.shiftright("number", PART_BITS))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    parts = counted(parts.select(
        F.col("tree").alias("t"), F.col("part").alias("p"),
        (F.col("first") - F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("shift"), F.sum("rows").over(tree).alias("n")))
    placed = numbered.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return placed.select("tree", (F.col("number") - F.col("shift")).alias("pos"), "n", "digest", "carry")


def _parents(level: str) -> Column:
    last = F.floor((F.length(level) - 1) / (RUN * HEX)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.col(level).substr(i * (RUN * HEX) + 1, F.lit(RUN * HEX)))
    return F.array_join(F.transform(runs, lambda run: F.sha2(run, 256)), "")


def _climb(nodes: DataFrame) -> DataFrame:
    """One row per block: tree, n, block, items in order, level0.. (strings of digests), top."""
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    rows = nodes.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "carry"))).alias("items"))
    rows = rows.withColumn("level0", F.array_join(F.transform("items", lambda i: i["digest"]), ""))
    for k in range(LEVELS):  # a level ends where the tree has one node left
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("n") > RUN**k, _parents(f"level{k}")))
    top = F.coalesce(*(F.col(f"level{k}") for k in range(LEVELS, -1, -1)))
    return rows.withColumn("top", top).drop(f"level{LEVELS}")


def _siblings(i: Column) -> Column:
    """The flanks (left, right) of node ``i`` of a block in its run, level by level."""
    flanks = []
    for k in range(LEVELS):
        node = F.shiftright(i, 3 * k)
        inside = F.pmod(node, F.lit(RUN))
        left = F.col(f"level{k}").substr((node - inside) * HEX + 1, inside * HEX)
        right = F.col(f"level{k}").substr((node + 1) * HEX + 1, (F.lit(RUN - 1) - inside) * HEX)
        flanks.append(F.struct(left.alias("left"), right.alias("right")))
    climbed = sum(F.when(F.col("n") > RUN**k, 1).otherwise(0) for k in range(LEVELS))
    return F.slice(F.array(*flanks), F.lit(1), climbed)


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and tree, top: the root of every tree."""
    rounds = [cut_lineage(_climb(nodes))]
    while not rounds[-1].filter(F.col("n") > BLOCK).isEmpty():
        up = rounds[-1].filter(F.col("n") > BLOCK)
        rounds.append(cut_lineage(_climb(up.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"), F.lit(0).alias("carry")))))
    tops = [blocks.filter(F.col("n") <= BLOCK).select("tree", "top") for blocks in rounds]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionAll(top)
    return rounds, roots


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, pos, digest, carry, path, subroot, root of every node of the first round.

    ``above`` has one row per tree: tree, path (from the tree's root on), subroot, root.
    """
    ready = None
    for blocks in reversed(rounds):
        first = above.withColumn("block", F.lit(0).cast("long"))
        done = blocks.filter(F.col("n") <= BLOCK)
        open_ = [(done, first)] + ([] if ready is None else [(blocks.filter(F.col("n") > BLOCK), ready)])
        parts = []
        for part, over in open_:
            over = over.select(F.col("tree").alias("t"), F.col("block").alias("b"), "path", "subroot", "root")
            joined = part.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
            node = F.transform("items", lambda item, i: F.struct(
                item["pos"].alias("pos"), item["digest"].alias("digest"), item["carry"].alias("carry"), _siblings(i).alias("own")))
            spread = joined.select("tree", "path", "subroot", "root", F.inline(node))
            parts.append(spread.select("tree", "pos", "digest", "carry", F.concat("own", "path").alias("path"), "subroot", "root"))
        nodes = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
        ready = nodes.withColumnRenamed("pos", "block")
    return nodes


def manifest(rows: DataFrame, leaf: str, group: str, order: str, carry: Sequence[str] = ()) -> DataFrame:
    """The columns ``carry`` with leaf, subroot, root and siblings (array of left, right) of every row.

    ``leaf`` names a column of hex digests, ``group`` the trees' key, ``order`` the order in a tree.
    """
    carried = F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, order])))
    leaves = cut_lineage(rows.select(
        F.col(f"`{group}`").alias("tree"), F.col(f"`{order}`").alias("at"), F.col(f"`{leaf}`").alias("digest"), carried.alias("carry")))
    rounds, subroots = _rounds(_placed(leaves))
    subroots = cut_lineage(subroots)
    ends = _placed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.col("top").alias("digest"), F.col("tree").alias("carry")))
    upper, root = _rounds(ends)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    above = _proofs(upper, root.select("tree", no_path.alias("path"), F.lit("").alias("subroot"), F.col("top").alias("root")))
    above = cut_lineage(above.select(F.col("carry").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    found = _proofs(rounds, above)
    return found.select(*(F.col(f"carry.`{c}`").alias(c) for c in carry), F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("siblings"))
