"""Deals overlapping windows of texts to buckets so that equal windows meet.

A text is a row of units (bytes, or words joined by one space). Of the k-unit grams
inside a window the one with the smallest hash is its minimiser. Consecutive windows
with the same minimiser occurrence form one super-string, which travels whole to the
bucket of that minimiser. Equal windows have equal minimisers, so they always meet,
and an average text travels about three times.

What keeps one bucket small when a passage is very frequent:

* equal super-strings of one batch travel once. Where two meet in a batch, their
  windows are known to repeat: the spans are settled there and the string goes on
  without origin;
* grams of a slot that holds far more than an even share of all grams (counted over
  all texts in ``SLOTS`` counters) are chosen only where a window has no other, so
  windows around a frequent passage are dealt by what is rare in them.

Spans are keyed by the digest of the text, not by row: repeated rows, null ids and
equal texts under several ids need no special case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

SLOTS = 1 << 16
#: Times the even share from which a slot counts as frequent.
FREQUENT = 6
#: Decoded bytes of super-strings that a bucket should hold.
BUCKET_BYTES = 24 << 20
#: Units of a text handled at once; longer texts are cut into overlapping parts.
PART_UNITS = 1 << 18
#: Decoded bytes of super-strings a map task keeps before it sends them on.
FLUSH_BYTES = 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HOT = np.uint64(1 << 63)
_POSITION_BITS = np.uint64(20)
PIECES = "bucket int, blob binary, digest binary, starts array<int>, ends array<int>"


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand in each worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 14)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each range; equal ranges hash equally."""
    up, down = _Powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def word_bounds(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in it."""
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def byte_units(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    values = np.frombuffer(raw, np.uint8)
    at = np.arange(n, dtype=np.int64)
    return raw, at, at + 1, values


def word_units(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    joined, starts, ends = word_bounds(raw)
    return joined, starts, ends, range_hashes(np.frombuffer(joined, np.uint8), starts, ends)


def _gram_keys(values: np.ndarray, gram: int, hot: np.ndarray | None) -> np.ndarray:
    at = np.arange(len(values) - gram + 1)
    h = range_hashes(values, at, at + gram) >> np.uint64(1)
    if hot is not None:
        h |= np.where(hot[(h >> np.uint64(47)).astype(np.int64)], _HOT, np.uint64(0))
    return h


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def super_strings(values: np.ndarray, window: int, gram: int, hot: np.ndarray | None):
    """Yields (first window, last window, minimiser key) of each super-string."""
    step = PART_UNITS - window + 1
    for base in range(0, max(1, len(values) - window + 1), step):
        part = values[base : base + PART_UNITS]
        if len(part) < window:
            continue
        keys = _gram_keys(part, gram, hot)
        keys = (keys & ~((np.uint64(1) << _POSITION_BITS) - np.uint64(1))) | np.arange(len(keys), dtype=np.uint64)
        low = _window_minima(keys, window - gram + 1)
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        firsts = np.concatenate(([0], cuts))
        lasts = np.concatenate((cuts - 1, [len(low) - 1]))
        yield from zip((firsts + base).tolist(), (lasts + base).tolist(), (low[firsts] >> _POSITION_BITS).tolist())


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, not touching spans that cover the same units."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[first], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(reach) - 1]))]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column(0).cast(pa.large_binary()):
        raw = value.as_py()
        if raw:
            yield raw


def gram_slots(text: DataFrame, units: Callable, gram: int) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and which hash slots hold ``FREQUENT`` times their even share.

    Every gram of every text is counted; what reaches the driver is the list of
    frequent slots, at most ``SLOTS / FREQUENT`` numbers.
    """

    def count(batches):
        slots, size, held = np.zeros(SLOTS, np.int64), 0, []
        for batch in batches:
            for raw in _texts(batch):
                size += len(raw)
                values = units(raw)[3]
                for base in range(0, max(1, len(values) - gram + 1), PART_UNITS):
                    part = values[base : base + PART_UNITS + gram - 1]
                    if len(part) >= gram:
                        held.append((_gram_keys(part, gram, None) >> np.uint64(47)).astype(np.uint16))
                if len(held) >= 256:
                    slots += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held = []
        if held:
            slots += np.bincount(np.concatenate(held), minlength=SLOTS)
        used = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(slots[used], size), pa.int64())], ["slot", "n"])

    counts = text.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    totals = F.sum(F.when(F.col("slot") >= 0, F.col("n")))
    # one row of sums meets the slots; both have at most SLOTS rows
    row = counts.agg(
        F.sum(F.when(F.col("slot") < 0, F.col("n"))).alias("size"), totals.alias("grams"),
        F.sort_array(F.collect_list(F.when(F.col("slot") >= 0, F.struct(F.col("n"), F.col("slot"))))).alias("by"),
    ).select("size", F.filter("by", lambda x: x["n"] > F.lit(FREQUENT) * (F.col("grams") / SLOTS + 1))["slot"].alias("hot")).first()
    hot = np.zeros(SLOTS, bool)
    hot[row["hot"] or []] = True
    return row["size"] or 0, hot


def _packed(entries: list[tuple[bytes, int, int, int, bytes | None]]) -> bytes:
    """(string, first window's unit or -1, windows, key, digest) rows as one compressed block."""
    strings = [e[0] for e in entries]
    numbers = np.array([(len(e[0]), e[1], e[2], e[3]) for e in entries], np.int64)
    digests = b"".join(e[4] or bytes(16) for e in entries)
    head = np.array([len(entries)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + numbers.tobytes() + digests + b"".join(strings))


def unpacked(blob: bytes) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    numbers = np.frombuffer(data, np.int64, 4 * n, 8).reshape(n, 4).tolist()
    at = 8 + 32 * n
    text = at + 16 * n
    for k, (size, start, windows, key) in enumerate(numbers):
        yield data[text : text + size], start, windows, key, data[at + 16 * k : at + 16 * k + 16]
        text += size


def dealt(text: DataFrame, units: Callable, window: int, gram: int, buckets: int, hot: np.ndarray | None) -> DataFrame:
    """Blocks of super-strings by bucket, and spans that a map task could settle itself."""

    def flush(seen: dict, settled: dict):
        by_bucket: dict[int, list] = {}
        for string, (start, windows, key, digest) in seen.items():
            by_bucket.setdefault(key % buckets, []).append((string, start, windows, key, digest))
        rows = [(b, _packed(entries), None, None, None) for b, entries in by_bucket.items()]
        for digest, spans in settled.items():
            starts, ends = merge(*np.array(spans, np.int64).T)
            rows.append((int.from_bytes(digest[:4], "little") % buckets, None, digest, starts.tolist(), ends.tolist()))
        for at in range(0, len(rows), 256):
            columns = list(zip(*rows[at : at + 256]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
                ["bucket", "blob", "digest", "starts", "ends"])

    def deal(batches):
        seen: dict[bytes, tuple] = {}
        settled: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for raw in _texts(batch):
                joined, starts, ends, values = units(raw)
                if len(values) < window:
                    continue
                digest = hashlib.md5(raw).digest()
                for first, last, key in super_strings(values, window, gram, hot):
                    string = joined[starts[first] : ends[last + window - 1]]
                    other = seen.get(string)
                    if other is None:
                        seen[string] = (first, last - first + 1, key, digest)
                        held += len(string)
                        continue
                    settled.setdefault(digest, []).append((first, last + window))
                    if other[0] >= 0:
                        settled.setdefault(other[3], []).append((other[0], other[0] + other[1] - 1 + window))
                        seen[string] = (-1, other[1], key, None)
                if held > FLUSH_BYTES:
                    yield from flush(seen, settled)
                    seen, settled, held = {}, {}, 0
        yield from flush(seen, settled)

    return text.mapInArrow(deal, PIECES)


def repeated_spans(
    docs: DataFrame, text: str, units: Callable, window: int, gram: int, repeats: Callable, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """digest (binary), spans (start, end, start, end, ... in units, not merged): what
    repeated windows cover in each text that has any.

    ``repeats(strings, windows, seen_twice, keys)`` gets the distinct super-strings of
    a bucket, sorted by minimiser, how many windows each starts with, and whether it
    occurred more than once, and yields (index, first window, last window) runs of
    windows that occur more than once.
    """
    plain = docs.select(F.col(text).alias("text"))
    size, hot = gram_slots(plain, units, gram)
    buckets = max(1, -(-4 * size // bucket_bytes))

    def settle(table: pa.Table) -> pa.Table:
        strings: dict[bytes, int] = {}
        windows, keys, twice = [], [], []
        origins: list[tuple[int, int, bytes]] = []
        spans: dict[bytes, list] = {}
        for blob, digest, starts, ends in zip(*(table.column(c).to_pylist() for c in ("blob", "digest", "starts", "ends"))):
            if blob is None:
                spans.setdefault(digest, []).extend(zip(starts, ends))
                continue
            for string, start, n, key, digest in unpacked(blob):
                k = strings.setdefault(string, len(strings))
                if k == len(windows):
                    windows.append(n)
                    keys.append(key)
                    twice.append(start < 0)
                else:
                    twice[k] = True
                if start >= 0:
                    origins.append((k, start, digest))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        listed = list(strings)
        found: dict[int, list] = {}
        flags = np.array(twice, bool)
        for k in np.flatnonzero(flags).tolist():
            found[k] = [(0, windows[k] - 1)]
        for at, first, last in repeats([listed[k] for k in order], np.array(windows, np.int64)[order], flags[order], np.array(keys, np.int64)[order]):
            k = int(order[at])
            if not flags[k]:
                found.setdefault(k, []).append((first, last))
        for k, start, digest in origins:
            for first, last in found.get(k, ()):
                spans.setdefault(digest, []).append((start + first, start + last + window))
        rows = [(d, *merge(*np.array(s, np.int64).T)) for d, s in spans.items()]
        return pa.table({
            "digest": pa.array([r[0] for r in rows], pa.binary()),
            "starts": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            "ends": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
        })

    pieces = dealt(plain, units, window, gram, buckets, hot if hot.any() else None)
    settled = pieces.groupBy("bucket").applyInArrow(settle, "digest binary, starts array<int>, ends array<int>")
    lists = settled.groupBy("digest").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"))
    flat = F.flatten(F.transform("spans", lambda x: F.array(x["starts"], x["ends"])))
    # written, so that the join that follows reads plain exchanges and can split a hot text
    return cut_lineage(lists.select("digest", flat.alias("spans")))


def removed(docs: DataFrame, text: str, spans: DataFrame, cut: Callable, schema: str, out: str) -> DataFrame:
    """The rows of ``docs`` with the struct ``out`` that ``cut(raw, starts, ends)`` makes
    of each text (null: empty) and its merged spans. A column named ``out`` is replaced."""
    names = [f.split()[0] for f in schema.split(", ")]

    @F.pandas_udf(schema)
    def apply(texts: pd.Series, flat: pd.Series) -> pd.DataFrame:
        rows = []
        for value, own in zip(texts, flat):
            pairs = np.asarray(own if own is not None else (), np.int64).reshape(-1, 2)
            rows.append(cut((value or "").encode(), *merge(pairs[:, 0], pairs[:, 1])))
        return pd.DataFrame(rows, columns=names)

    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.drop(out).withColumn("__digest", digest)
    found = spans.withColumnsRenamed({"digest": "__digest", "spans": "__spans"})
    return keyed.join(found, "__digest", "left").withColumn(out, apply(text, "__spans")).drop("__digest", "__spans")
