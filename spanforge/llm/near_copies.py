"""Near copies by exact shingle similarity: SimHash and MinHash propose, shingle sets decide.

Two texts are linked if the sets of their word shingles (A-Z lower-cased) have a Jaccard
similarity of ``similarity`` or more. Every distinct text gets a SimHash fingerprint, and
the trie join of ``simhash`` puts fingerprints that differ in few bits into one bucket. That
finds the closest pairs; most of those near the limit differ in more bits, so every text
also gets ``bands()`` keys of ``ROWS`` minima each, and a linked pair shares a key but for a
probability of ``MISS`` at most. No pair of either kind is linked unless the shingle sets
(64-bit hashes of shingles) say so.

Pairs are not enumerated where it can be spared. First each text is held against one other,
drawn text of its buckets, and what is linked becomes one group, so a group is compared in
proportion to its size. Buckets that still hold several groups are thinned by bounds that
drop no link. A shingle that no other open text has can't be shared, so a pair shares at
most the common shingles of the side that has fewer; texts for which no partner in the bucket
could be similar enough leave it. The rest is held against the text of the bucket that
shares most. What is then still open is compared pair by pair, where a link is possible at
all: either the frequent shingles alone (those of more than ``RARE`` texts) are enough on both
sides, or the two share a rare one, and those pairs follow from the rare shingles, a few for
each. So the groups are those of all pairs. Texts that share keys and enough frequent
shingles, but in ever other combinations, still cost the square of their bucket.

Cases: null, empty and blank texts have one shingle, the empty one; a text shorter than a
shingle is one shingle; very long texts are shingled whole; repeated rows, tied or null ids
share a group; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

from .components import components, counted
from .simhash import fingerprint_links, fingerprints, keep_first

WORDS, SIMILARITY = 5, 0.8
#: Minima in a band key, and the share of pairs at exactly ``similarity`` that may share no key.
ROWS, MISS = 6, 1e-3
#: Rounds against a drawn text, and against the text that shares most.
HOOKS, HUBS = 1, 1
#: A shingle is rare in up to three open texts: count, least, greatest and exclusive-or name them all.
RARE = 3
#: Pairs of one text that a task compares.
DEALT = 64
SEED = 41
_SPREAD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def bands(similarity: float = SIMILARITY, rows: int = ROWS, miss: float = MISS) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _fold(parts) -> np.ndarray:
    key = np.uint64(0)
    for part in parts:
        key = (key ^ part) * _SPREAD
        key = key ^ key >> _SHIFT
    return key


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(1, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    wide = min(words, len(hashed))
    return np.unique(_fold(hashed[i : len(hashed) - wide + 1 + i] for i in range(wide)))


def band_keys(found: np.ndarray, times: int) -> np.ndarray:
    generator = np.random.default_rng(SEED)
    mask, odd = generator.integers(0, 1 << 64, (2, times * ROWS, 1), np.uint64)
    odd |= np.uint64(1)
    least = np.full(times * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 1 << 11):
        least = np.minimum(least, ((found[at : at + (1 << 11)] ^ mask) * odd).min(axis=1))
    return _fold([np.arange(1, times + 1).astype(np.uint64), *least.reshape(times, ROWS).T])


def _column(apply):
    @F.pandas_udf("array<long>")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([apply(t).view(np.int64) for t in texts], dtype=object)

    return column


def _with_set(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """Adds the shingles of column ``side``; a text of many pairs is dealt to several tasks."""
    many = counted(pairs.groupBy(side).agg(F.ceil(F.count("*") / DEALT).alias("parts")).filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("parts")
    copies = (
        sets.withColumnsRenamed({"node": side, "shingles": f"of_{side}"}).join(many, side, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts"))
    return dealt.join(copies, [side, "part"]).drop("part")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, and other columns) whose shingle sets are similar enough."""
    both = _with_set(_with_set(pairs, "a", sets), "b", sets)
    shared, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return both.filter(shared >= F.lit(similarity) * (total - shared) - 1e-9).select(*pairs.columns)


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several groups."""
    parted = counted(members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket"))
    return cut_lineage(members.join(parted, "bucket"))


def _held(members: DataFrame, order: Column) -> DataFrame:
    """One pair (a, b, with their groups ra, rb) for each member that is not in the group of its buckets' first."""
    firsts = counted(members.groupBy("bucket").agg(F.min(order).alias("first")))
    other = members.join(firsts, "bucket").filter("root <> first.root").groupBy("node").agg(F.min(F.struct("first", "root")).alias("m"))
    return other.select(F.col("node").alias("a"), F.col("m.first.node").alias("b"), F.col("m.root").alias("ra"), F.col("m.first.root").alias("rb"))


def _needed(size: Column, other: Column, similarity: float) -> Column:
    """Shingles that sets of these sizes share at least if they are similar enough."""
    return F.lit(similarity / (1 + similarity)) * (size + other) - 1e-9


def _rated(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the size of their sets, how many shingles are common (some other member
    has them) and frequent (more than ``RARE`` members have them); and the pairs (a, b) that share a rare one."""
    own = sets.join(counted(members.select("node").distinct()), "node")
    shingle = own.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("c"), F.bit_xor("node").alias("x"))
    rare = cut_lineage(shingle.filter(F.col("n") <= RARE).select(
        "n", "a", "c", F.when(F.col("n") == RARE, F.col("a").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("x"))).alias("b")))
    owner = F.explode(F.array_compact(F.when(F.col("n") == 1, F.array("a")).otherwise(F.array("a", "b", "c")))).alias("node")
    few = rare.select("n", owner).groupBy("node").agg(F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("few"))
    less = lambda c: F.col("size") - F.coalesce(c, F.lit(0))
    rates = own.select("node", F.size("shingles").alias("size")).join(few, "node", "left").select(
        "node", "size", less("alone").alias("common"), less("few").alias("frequent"))
    two = F.array(F.struct("a", F.col("c").alias("b")))
    three = F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")))
    pairs = rare.filter("n > 1").select(F.inline(F.when(F.col("n") == 2, two).otherwise(three))).distinct()
    return members.join(counted(rates), "node"), pairs


def _thinned(rated: DataFrame, similarity: float) -> DataFrame:
    """Members that may yet be linked in their bucket."""
    least = counted(rated.groupBy("bucket").agg(F.min("size").alias("least")))
    partner = F.greatest(F.col("least").cast("double"), F.col("size") * F.lit(similarity))
    return rated.join(least, "bucket").filter(F.col("common") >= _needed(F.col("size"), partner, similarity)).drop("least")


def _pairs(members: DataFrame, sharing: DataFrame, similarity: float) -> DataFrame:
    """All pairs in different groups that a bucket and enough frequent shingles, or a rare shingle, allow to be linked."""
    side = lambda k: [F.col("node").alias(k), *(F.col(c).alias(f"{c[0]}{k}") for c in ("root", "size", "common", "frequent"))]
    bucket_a, bucket_b = (members.select("bucket", *side(k)) for k in ("a", "b"))
    enough = F.least("fa", "fb") >= _needed(F.col("sa"), F.col("sb"), similarity)
    frequent = bucket_a.join(bucket_b, "bucket").filter((F.col("ra") < F.col("rb")) & enough).select("a", "b", "ra", "rb")
    each = cut_lineage(members.select("node", "root", "size", "common", "frequent").distinct())
    possible = F.least("ca", "cb") >= _needed(F.col("sa"), F.col("sb"), similarity)
    rare = sharing.join(each.select(*side("a")), "a").join(each.select(*side("b")), "b").filter((F.col("ra") != F.col("rb")) & possible)
    return frequent.unionAll(rare.select("a", "b", "ra", "rb")).distinct()


def _by_print(nodes: DataFrame) -> DataFrame:
    """node, bucket: texts whose SimHash fingerprints are linked, directly or by others, share a bucket."""
    prints = cut_lineage(nodes.select("fp").distinct())
    roots = counted(components(fingerprint_links(prints)).select(F.col("node").alias("fp"), "root"))
    return nodes.join(roots, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("bucket"))


def near_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY,
) -> DataFrame:
    """key, digest (of the text), component: one row per document; equal components are linked."""
    times = bands(similarity)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    keys_of = _column(lambda t: band_keys(shingles(t, words), times))
    rows = cut_lineage(docs.select(
        F.col(key).alias("key"), digest.alias("digest"), fingerprints(words)(F.col(text)).alias("fp"), keys_of(F.col(text)).alias("keys")))
    # numbers are fixed by writing the table
    nodes = cut_lineage(
        rows.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    every = nodes.select("node", F.explode("keys").alias("bucket")).unionAll(_by_print(nodes))
    shared = counted(every.groupBy("bucket").count().filter("count > 1").select("bucket"))
    members = cut_lineage(every.join(shared, "bucket").select("node", "bucket"))
    texts = counted(members.select("node").distinct().join(nodes, "node").select("node", F.col("digest").alias("__digest")))
    sets_of = _column(lambda t: shingles(t, words))
    sets = cut_lineage(
        docs.select(F.col(text).alias("text"), digest.alias("__digest")).join(texts, "__digest")
        .select("node", sets_of("text").alias("shingles")).groupBy("node").agg(F.first("shingles").alias("shingles")))

    steps = []  # which group became part of which, round by round
    state = members.withColumn("root", F.col("node"))
    for turn in range(HOOKS + HUBS + 1):
        state = _open(state)
        if turn == HOOKS:
            state, sharing = _rated(state, sets)
        if turn >= HOOKS:
            state = _open(_thinned(state, similarity))
        if state.isEmpty():
            break
        if turn < HOOKS:
            pairs = _held(state, F.struct(F.xxhash64("node", F.lit(turn)).alias("drawn"), "node", "root"))
        elif turn < HOOKS + HUBS:
            pairs = _held(state, F.struct((-F.col("common") / F.col("size")).alias("rare"), "node", "root"))
        else:
            pairs = _pairs(state, sharing, similarity)
        found = similar(cut_lineage(pairs), sets, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        joined = counted(components(found).select(F.col("node").alias("root"), F.col("root").alias("joined")))
        steps.append(joined)
        state = state.join(joined, "root", "left").withColumn("root", F.coalesce("joined", "root")).drop("joined")
    named = nodes.select("digest", "node", F.col("node").alias("root"))
    for joined in steps:
        named = named.join(joined, "root", "left").select("digest", "node", F.coalesce("joined", "root").alias("root"))
    return rows.select("key", "digest").join(named.select("digest", F.col("root").alias("component")), "digest").withColumnRenamed("key", key)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies, chosen as ``simhash.keep_one`` does."""
    return keep_first(docs, near_copies(docs, text, key, words, similarity), text, key)
