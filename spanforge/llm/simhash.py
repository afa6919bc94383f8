"""SimHash near-duplicates: a self-join of the binary trie of all fingerprints.

The fingerprint is over the word shingles of the text (A-Z lower-cased). Distinct
fingerprints are cut by their first bits into the trie's subtrees; each pair of
subtrees whose prefixes differ in few enough bits is one group. There both subtrees
are walked together from the top: a node pair splits into its four child pairs, a
differing bit uses up error budget, and pairs out of budget are dropped. Small node
pairs are compared directly. A group hands on a spanning forest of the links it found,
not the links, so a cluster of many near copies stays linear; ``components`` joins the
forests. No table is broadcast and no link list is collected.

Cases: a null, empty or blank text has fingerprint zero, linked like any other; a text
shorter than a shingle is one shingle; repeated rows, tied or null ids share a
component (null ids never name it; a component of null ids only is named null); an
empty table gives an empty result; columns with the names of output columns are
replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

from .components import components, counted

#: Distinct fingerprints a subtree should hold at most.
SUBTREE = 1 << 13
#: Node pairs walked at once, and the size under which a node pair is compared directly.
FRONTIER, DIRECT = 1 << 20, 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of one text."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = hashed[at : at + (1 << 16)]
        bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashed)).view(">i8")[0])


def fingerprints(words: int = 3):
    """The fingerprint as a column function of a text column."""

    @F.pandas_udf("long")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return apply


def _halves(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where, within sorted keys[low:high] that agree above ``bit``, the ones begin."""
    one = np.uint64(1)
    split = (keys[low] >> (bit + one) << (bit + one)) | (one << bit)
    return np.clip(np.searchsorted(keys, split), low, high)


class _Forest:
    """Labels of elements; elements that were linked end up with one label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _within(keys: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int) -> np.ndarray:
    return np.bitwise_count(keys[a] ^ keys[b]) <= budget


def trie_links(keys: np.ndarray, cut: int, bits: int, used: int, budget: int, forest: _Forest) -> None:
    """Links all pairs of sorted keys within ``budget`` bits; ``cut`` > 0: only pairs across it.

    ``bits`` are still open below the roots, whose prefixes differ in ``used`` bits.

    A frontier holds node pairs as index ranges; a node paired with itself has equal
    ranges and makes three child pairs instead of four.
    """
    n = len(keys)
    one = ([0, cut, cut, n] if cut else [0, n, 0, n])
    stack = [(np.array([one], np.int64), np.array([bits], np.int64), np.array([used], np.int64))]
    while stack:
        spans, depth, used = stack.pop()
        if len(spans) > FRONTIER:
            half = len(spans) // 2
            stack += [(spans[:half], depth[:half], used[:half]), (spans[half:], depth[half:], used[half:])]
            continue
        a0, a1, b0, b1 = spans.T
        self_pair = (a0 == b0) & (a1 == b1)
        small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (depth == 0)
        at = np.flatnonzero(small)
        for low in range(0, len(at), FRONTIER // DIRECT):
            part = at[low : low + FRONTIER // DIRECT]
            wide = b1[part] - b0[part]
            count = (a1[part] - a0[part]) * wide
            own = np.repeat(np.arange(len(part)), count)
            step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            x, y = a0[part][own] + step // wide[own], b0[part][own] + step % wide[own]
            near = (x != y) & _within(keys, x, y, budget)
            forest.link(x[near], y[near])
        go = np.flatnonzero(~small)
        if not len(go):
            continue
        a0, a1, b0, b1, self_pair, used = a0[go], a1[go], b0[go], b1[go], self_pair[go], used[go]
        bit = (depth[go] - 1).astype(np.uint64)
        am, bm = _halves(keys, a0, a1, bit), _halves(keys, b0, b1, bit)
        children = (
            (a0, am, b0, bm, used, None), (am, a1, bm, b1, used, None),
            (a0, am, bm, b1, used + 1, None), (am, a1, b0, bm, used + 1, ~self_pair),
        )
        spans, depths, errors = [], [], []
        for p, q, r, s, error, also in children:
            keep = (p < q) & (r < s) & (error <= budget)
            if also is not None:
                keep &= also
            spans.append(np.stack((p, q, r, s), axis=1)[keep])
            depths.append(bit[keep].astype(np.int64))
            errors.append(error[keep])
        spans = np.concatenate(spans)
        if len(spans):
            stack.append((spans, np.concatenate(depths), np.concatenate(errors)))


def fingerprint_links(prints: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """a, b: a spanning forest of the links between the distinct values of ``fp``."""
    n = prints.count()
    top = min(20, max(0, math.ceil(math.log2(max(1, n) / subtree))))
    masks = [m for m in range(1 << top) if m.bit_count() <= budget]
    prefix = F.shiftrightunsigned("fp", 64 - top) if top else F.lit(0).cast("long")
    other = F.col("prefix").bitwiseXOR(F.col("mask"))
    cells = (
        prints.select("fp", prefix.alias("prefix"), F.explode(F.array(*map(F.lit, masks)).cast("array<long>")).alias("mask"))
        .select("fp", F.least("prefix", other).alias("low"), F.greatest("prefix", other).alias("high"), (F.col("prefix") > other).alias("upper"))
    )

    def walk(table: pa.Table) -> pa.Table:
        keys = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        keys.sort()
        # fingerprints sort by prefix first, so the two subtrees are two halves of the keys
        cut = len(keys) - int(np.count_nonzero(table.column("upper").to_numpy()))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        forest = _Forest(len(keys))
        if low == high:
            trie_links(keys, 0, 64 - top, 0, budget, forest)
        elif 0 < cut < len(keys):
            trie_links(keys, cut, 64 - top, (low ^ high).bit_count(), budget, forest)
        linked = np.flatnonzero(forest.label != np.arange(len(keys)))
        signed = keys.view(np.int64)
        return pa.table({"a": signed[forest.label[linked]], "b": signed[linked]})

    return cells.groupBy("low", "high").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, budget: int = 3) -> DataFrame:
    """key, digest (of the text), fingerprint (16 hex digits), component_id (smallest key
    of the component): one row per document.

    The narrow rows (key, digest, fp) are written to the shared folder once, so texts
    are read a single time.
    """
    rows = cut_lineage(docs.select(
        F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), fingerprints(words)(F.col(text)).alias("fp")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("key").alias("first")))
    roots = components(fingerprint_links(prints.select("fp"), budget))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = cut_lineage(rooted.join(names, "root").select("fp", "component_id", "root"))
    return rows.join(by_print, "fp").select(
        F.col("key").alias(key), "digest", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the
    smallest (key, digest of its text), null keys last, and only one of rows that repeat
    it. Rows that stay alone are passed through; only keys meet, never whole groups."""
    return keep_first(docs, near_duplicates(docs, text, key, words, budget), text, key)


def keep_first(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """``keep_one`` for the components (key, digest, component) in ``found``."""
    found = found.select(F.col(key).alias("key"), "digest", "component")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "digest")
    groups = cut_lineage(found.groupBy("component").agg(F.count("*").alias("n"), F.min(order).alias("best")).filter("n > 1"))
    grouped = found.join(groups.select("component", "best"), "component").groupBy("key", "digest").agg(
        F.first("best").alias("best"), F.count("*").alias("times"))
    is_best = F.col("best.key").eqNullSafe(F.col("key")) & (F.col("best.digest") == F.col("digest"))
    grouped = cut_lineage(grouped.select(
        F.col("key").alias("__key"), F.col("digest").alias("__digest"), is_best.alias("best"), "times"))
    gone, again = counted(grouped.filter("not best or times > 1")), counted(grouped.filter("best and times > 1"))
    keyed = docs.withColumns({"__key": F.col(key), "__digest": F.md5(F.coalesce(F.col(text), F.lit("")))})

    def on(side: DataFrame):
        return keyed["__key"].eqNullSafe(side["__key"]) & (keyed["__digest"] == side["__digest"])

    alone = keyed.join(gone, on(gone), "left_anti").drop("__key", "__digest")
    repeated = keyed.join(again, on(again), "left_semi").dropDuplicates(["__key", "__digest"]).drop("__key", "__digest")
    return alone.unionAll(repeated)
