"""Substring dedup over bytes by suffix arrays built with a difference cover.

Every byte covered by a ``window``-byte string that also starts anywhere else (same
document included) goes; strings never cross documents.

Texts are cut into super-strings so that equal windows meet in one bucket (see
``superstrings``). In a bucket the strings of each minimiser that has several different
ones are laid end to end and their suffixes are sorted: the positions off the multiples
of three are sorted by their triples, the triples' names form a text of two thirds the
length that is sorted the same way, the other suffixes follow from one symbol and the
rank after it, and both orders are merged. Names cover three times as many bytes at
each level; the strings differ and have at most 399 bytes, so seven levels tell all
suffixes apart. A window is a repeat if a neighbour in that order starts with the same bytes.

Cases: as in ``word_dedup``; a null text is empty, what is kept may end inside a
character and is binary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .superstrings import BUCKET_BYTES, byte_units, removed, repeated_spans

GRAM_BYTES = 32
#: Bytes whose suffixes are sorted at once, if the strings of one minimiser allow it.
SORTED_BYTES = 1 << 20


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and each element's dense rank from 1."""
    order = np.argsort(keys, kind="stable")
    steps = np.empty(len(keys), np.int64)
    steps[:1] = 1
    steps[1:] = keys[order[1:]] != keys[order[:-1]]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(steps)
    return order, ranks


def _joined(*columns: np.ndarray) -> np.ndarray:
    """One integer per row that sorts as the rows do."""
    key, top = columns[0], int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if top * width >= 1 << 62:
            key = _dense(key)[1]
            top = int(key.max(initial=0)) + 1
        key, top = key * width + column, top * width
    return key


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order; symbols are above 0."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate((symbols, np.zeros(4, np.int64)))
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    order, names = _dense(_joined(s[sample], s[sample + 1], s[sample + 2]))
    if names[order[-1]] < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_joined(s[rest], rank[rest + 1]), kind="stable")]
    # an element of either order goes behind those of the other that are smaller
    before = np.zeros(len(rest), np.int64)
    for residue, parts in ((1, lambda i: (s[i], rank[i + 1])), (2, lambda i: (s[i], s[i + 1], rank[i + 2]))):
        own = ordered[ordered % 3 == residue]
        both = _joined(*(np.concatenate(pair) for pair in zip(parts(own), parts(rest))))
        before += np.searchsorted(both[: len(own)], both[len(own) :])
    merged = np.empty(n, np.int64)
    places = before + np.arange(len(rest))
    merged[places] = rest
    others = np.ones(n, bool)
    others[places] = False
    merged[others] = ordered
    return merged


def _equal_neighbours(data: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Positions that share their first ``window`` bytes with a neighbour in ``order``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, right = order[:-1], order[1:]
    for at in [*range(0, window - 7, 8), window - 8] if window >= 8 else range(window):
        same = eights[left + at] == eights[right + at] if window >= 8 else data[left + at] == data[right + at]
        left, right = left[same], right[same]
    return np.unique(np.concatenate((left, right)))


def suffix_repeats(window: int):
    """Runs of windows that occur more than once, by suffix arrays of whole minimiser groups."""

    def repeats(strings: list[bytes], windows: np.ndarray, twice: np.ndarray, keys: np.ndarray):
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        several = [range(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
        chunk, held = [], 0
        for number, group in enumerate(several):
            chunk += group
            held += sum(len(strings[k]) for k in group)
            if held < SORTED_BYTES and number + 1 < len(several):
                continue
            data = np.frombuffer(b"\0".join(strings[k] for k in chunk) + b"\0", np.uint8)
            sizes = np.array([len(strings[k]) + 1 for k in chunk])
            firsts = np.cumsum(sizes) - sizes
            symbols = data.astype(np.int64) + 2
            symbols[firsts + sizes - 1] = 1
            begins = np.zeros(len(data) + 1, np.int64)
            np.add.at(begins, firsts, 1)
            np.add.at(begins, firsts + windows[chunk], -1)
            order = suffix_order(symbols)
            order = order[np.cumsum(begins)[order] > 0]
            hits = _equal_neighbours(data, order, window)
            owner = np.searchsorted(firsts, hits, side="right") - 1
            new = np.concatenate(([True], (np.diff(hits) != 1) | (np.diff(owner) != 0))) if len(hits) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            tails = np.concatenate((heads[1:] - 1, [len(hits) - 1])) if len(heads) else heads
            for head, tail in zip(heads.tolist(), tails.tolist()):
                base = firsts[owner[head]]
                yield chunk[owner[head]], int(hits[head] - base), int(hits[tail] - base)
            chunk, held = [], 0

    return repeats


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray):
    at, kept = 0, []
    for start, end in zip(starts.tolist(), ends.tolist()):
        kept.append(raw[at:start])
        at = end
    kept.append(raw[at:])
    left = b"".join(kept)
    return len(raw), len(raw) - len(left), len(starts), left


def drop_repeated_bytes(
    docs: DataFrame, text: str = "text", window: int = 200, gram: int = GRAM_BYTES, bucket_bytes: int = BUCKET_BYTES, out: str = "dedup"
) -> DataFrame:
    """Adds the struct ``out``: n_bytes, n_removed, n_spans and the kept bytes."""
    spans = repeated_spans(docs, text, byte_units, window, gram, suffix_repeats(window), bucket_bytes)
    return removed(docs, text, spans, _cut, "n_bytes long, n_removed long, n_spans long, kept binary", out)
