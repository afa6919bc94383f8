"""Substring dedup over words: super-k-mers dealt by minimiser, windows counted by sorting.

Every word covered by a window of ``window`` consecutive words whose word sequence also
starts anywhere else (same document included) goes. See ``superstrings`` for how
windows meet and how frequent passages are kept from filling one bucket.

Cases: a null, empty or short text has no window and is kept whole (as its words joined
by one space); repeated rows and equal texts repeat all their windows and lose them; ids
are not looked at, so they may be null or tied; an empty table gives an empty result; a
column that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .superstrings import BUCKET_BYTES, removed, repeated_spans, word_units

GRAM_WORDS = 6


def _windows(string: bytes, n: int, window: int) -> Iterator[bytes]:
    ends = np.flatnonzero(np.frombuffer(string + b" ", np.uint8) == 32).tolist()
    for i in range(n):
        yield string[(ends[i - 1] + 1 if i else 0) : ends[i + window - 1]]


def sorted_counts(window: int):
    """Runs of windows that occur more than once, found by sorting each minimiser's windows."""

    def repeats(strings: list[bytes], windows: np.ndarray, twice: np.ndarray, keys: np.ndarray):
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if high - low < 2:
                continue
            rows = sorted((w, k, i) for k in range(low, high) for i, w in enumerate(_windows(strings[k], int(windows[k]), window)))
            for before, row in zip(rows, rows[1:]):
                if before[0] == row[0]:
                    yield before[1], before[2], before[2]
                    yield row[1], row[2], row[2]

    return repeats


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray):
    words = raw.split()
    at, kept = 0, []
    for start, end in zip(starts.tolist(), ends.tolist()):
        kept += words[at:start]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def drop_repeated_words(
    docs: DataFrame, text: str = "text", window: int = 35, gram: int = GRAM_WORDS, bucket_bytes: int = BUCKET_BYTES, out: str = "dedup"
) -> DataFrame:
    """Adds the struct ``out``: n_words, n_removed and the kept words as one text."""
    spans = repeated_spans(docs, text, word_units, window, gram, sorted_counts(window), bucket_bytes)
    return removed(docs, text, spans, _cut, "n_words long, n_removed long, kept string", out)
