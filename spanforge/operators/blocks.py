"""Windows as packed rows: embed, score, vote or store without a row per position.

A long sequence is cut into overlapping windows; a position in two of them has the mean of
their vectors. All that a window can decide alone (its positions in no other window, less
those whose kernels reach into a neighbour) is finished in the task that embedded it and
leaves as one row: a string of votes, or a 32-bit block of vectors. Of the rest, only strips
of vectors at the window's ends are passed on: the two strips of a border meet, and the
positions around it are finished there. So one row per window and two strips per border are
shuffled, never a position or a whole window of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ensemble import votes_needed
from spanforge.operators.scoring import (
    HELD,
    MAX_TOKENS,
    STRIDE,
    WINDOW,
    attempt_batch,
    conv_features,
    dense_forward,
    kernel_reach,
    pack_planes,
    packed_batches,
    sigmoid_of,
    unpack_planes,
    window_texts,
    with_length,
)

_PIECE = "id {id}, start bigint, {columns}, border bigint, side string, strip binary, dim int, length bigint, error string"
VOTES = "bits string, ones bigint, p_sum double, p_max double"
STORED = "n bigint, dim_out int, block binary"

#: What finishes stretches, made inside a task: consecutive vectors and the part to finish, of each -> columns of each.
Finish = Callable[[Sequence[tuple[np.ndarray, slice]]], list[dict]]
#: Values of vectors that are finished together.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Rule:
    """How the members of an ensemble vote; ``cut`` is the threshold of the mean, None for a majority."""

    limits: tuple[float, ...]
    cut: float | None = None

    def vote(self, ps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probability and 0/1 per position from a (members, positions) table."""
        mean = ps[0].copy()
        for p in ps[1:]:
            mean += p
        mean /= len(ps)
        if self.cut is not None and len(ps) > 1:
            return mean, mean >= self.cut
        votes = (ps >= np.array(self.limits)[:, None]).sum(axis=0)
        return mean, votes >= votes_needed(len(ps))


def member_probabilities(x: np.ndarray, heads: Sequence[Mapping]) -> np.ndarray:
    """(members, positions) for consecutive vectors; beyond them the sequence is taken to end."""
    out = []
    for head in heads:
        local = [conv_features(x, head["conv"], np.ones(len(x)))] if "conv" in head else []
        out.append(sigmoid_of(dense_forward(np.concatenate([x, *local], axis=1) if local else x, head)))
    return np.stack(out)


def pieces_schema(id_type: str, columns: str) -> str:
    """Schema of what ``finish_windows`` makes; ``finish_borders`` makes its stretches' columns alone."""
    return _PIECE.format(id=id_type, columns=columns)


def voter(heads: Sequence[Mapping], rule: Rule) -> Finish:
    """Votes of a stretch, in the columns of ``VOTES``."""
    local = any("conv" in head for head in heads)

    def finish(stretches: Sequence[tuple[np.ndarray, slice]]) -> list[dict]:
        if local:  # kernels look around within a stretch
            ps = [member_probabilities(x, heads)[:, take] for x, take in stretches]
            sizes, ps = [p.shape[1] for p in ps], np.concatenate(ps, axis=1)
        else:
            parts = [x[take] for x, take in stretches]
            sizes, ps = [len(x) for x in parts], member_probabilities(np.concatenate(parts), heads)
        mean, hit = rule.vote(ps)
        bits, ends = (hit.astype(np.uint8) + ord("0")).tobytes().decode(), np.cumsum(sizes).tolist()
        return [{"bits": bits[a:b], "ones": int(hit[a:b].sum()), "p_sum": float(mean[a:b].sum()), "p_max": float(mean[a:b].max())}
                for a, b in zip([0, *ends], ends)]

    return finish


def store(stretches: Sequence[tuple[np.ndarray, slice]]) -> list[dict]:
    """Stretches of vectors as blocks, in the columns of ``STORED``."""
    return [{"n": len(x[take]), "dim_out": x.shape[1], "block": pack_planes(x[take])} for x, take in stretches]


class _Pending:
    """Rows whose stretches wait to be finished together, up to a number of values."""

    def __init__(self, done: Finish, out: list[dict]):
        self.done, self.out, self.rows, self.stretches, self.held = done, out, [], [], 0

    def add(self, row: dict, x: np.ndarray, take: slice) -> None:
        if self.rows and (self.held + x.size > TOGETHER or x.shape[1] != self.stretches[0][0].shape[1]):
            self.flush()
        self.rows.append(row)
        self.stretches.append((x, take))
        self.held += x.size

    def flush(self) -> None:
        if self.rows:
            self.out += [row | columns for row, columns in zip(self.rows, self.done(self.stretches))]
        self.rows, self.stretches, self.held = [], [], 0


def finish_windows(
    sequences: DataFrame,
    embed: Callable[[Sequence[str]], Sequence[np.ndarray]],
    finish: Callable[[], Finish],
    columns: str,
    *,
    reach: int = 0,
    feature: str = "none",
    budget: int = 8 * MAX_TOKENS,
    max_tokens: int = MAX_TOKENS,
    window: int = WINDOW,
    stride: int = STRIDE,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Finished stretches, border strips and errors of every window of ``(id, sequence)``.

    ``finish`` gives ``columns`` of a stretch, ``reach`` is how far its kernels look, ``keep``
    may drop windows ``(id, start, length, sequence)``. The result is costly and read three times: write it before handing it on.
    """
    overlap = window - stride
    if overlap > stride or 4 * reach > window - 2 * overlap:
        raise ValueError("windows must overlap by half at most and hold twice the kernels' reach at both ends")
    schema = pieces_schema(sequences.schema["id"].dataType.simpleString(), columns)
    arrow = _arrow(sequences, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = finish()
        for batch in batches:
            rows = batch.to_pylist()
            packed = packed_batches([len(r["sequence"]) for r in rows], budget, max_tokens)
            groups: dict[int, list] = {}
            for number, row in zip(packed, rows):
                groups.setdefault(number, []).append(row)
            out: list[dict] = []
            pending, held = _Pending(done, out), 0
            for group in groups.values():
                for row, found in zip(group, attempt_batch(embed, [r["sequence"] for r in group])):
                    if isinstance(found, str):
                        out.append({"id": row["id"], "error": found})
                        continue
                    x = np.asarray(found, dtype=np.float32)
                    out += pieces(row, x, pending)
                    held += x.nbytes
                if held >= HELD:
                    pending.flush()
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
                    held = 0
            pending.flush()
            yield pa.RecordBatch.from_pylist(out, arrow)

    def pieces(row: dict, raw: np.ndarray, pending: _Pending) -> list[dict]:
        start, length, n = row["start"], row["length"], len(raw)
        first, last = start == 0, start + n >= length
        x = with_length(raw.astype(float), length, feature)
        low, high = 0 if first else overlap, n if last else n - overlap
        begin, end = low if first else low + reach, high if last else high - reach
        common = {"id": row["id"], "length": length, "dim": raw.shape[1]}
        out = []
        if begin < end:
            pending.add(common | {"start": start + begin}, x[low:high], slice(begin - low, end - low))
        number = start // stride
        if not first:
            out.append(common | {"border": number, "side": "after", "strip": pack_planes(raw[: overlap + 2 * reach])})
        if not last:
            out.append(common | {"border": number + 1, "side": "before", "strip": pack_planes(raw[n - overlap - 2 * reach :])})
        return out

    return window_texts(sequences, max_tokens, window, stride, keep).mapInArrow(run, schema)


def finish_borders(
    pieces: DataFrame, finish: Callable[[], Finish], columns: str, *, reach: int = 0, feature: str = "none", window: int = WINDOW, stride: int = STRIDE,
) -> DataFrame:
    """The finished stretches around the borders, from the strips on both sides."""
    overlap = window - stride
    strips = pieces.filter(F.col("border").isNotNull())
    after = strips.filter(F.col("side") == "after").select("id", "border", "length", "dim", F.col("strip").alias("after"))
    before = strips.filter(F.col("side") == "before").select("id", "border", F.col("strip").alias("before"))
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start bigint, {columns}"
    arrow = _arrow(pieces, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = finish()
        for batch in batches:
            out: list[dict] = []
            pending = _Pending(done, out)
            for row in batch.to_pylist():
                left, right = (unpack_planes(row[side], row["dim"]).astype(float) for side in ("before", "after"))
                both = (left[2 * reach :] + right[:overlap]) / 2.0
                x = with_length(np.concatenate([left[: 2 * reach], both, right[overlap:]]), row["length"], feature)
                at = row["border"] * stride
                stop = min(row["length"], at + overlap + reach)
                take = slice(reach, stop - at + 2 * reach)
                pending.add({"id": row["id"], "start": at - reach}, x, take)
            pending.flush()
            yield pa.RecordBatch.from_pylist(out, arrow)

    return before.join(after, ["id", "border"]).mapInArrow(run, schema)


def assemble(stretches: DataFrame, threshold: float | None) -> DataFrame:
    """Mask string and summary per id from its voted stretches, one row per window."""
    bits = F.transform(F.array_sort(F.collect_list(F.struct("start", "bits"))), lambda s: s["bits"])
    sums = stretches.groupBy("id").agg(
        F.array_join(bits, "").alias("binary_mask"), F.sum("ones").alias("n_epitopes"), F.sum("p_sum").alias("_p"), F.max("p_max").alias("p_epitope_max"))
    n = F.length("binary_mask").cast("bigint")
    return sums.select(
        "id", "binary_mask", n.alias("length"), "n_epitopes", (F.col("n_epitopes") / n).alias("frac_epitope"),
        (F.col("_p") / n).alias("p_epitope_mean"), "p_epitope_max", F.lit(threshold).cast("double").alias("threshold"))


def all_stretches(written: DataFrame, finish: Callable[[], Finish], columns: str, **shape) -> tuple[DataFrame, DataFrame]:
    """(stretches, failures) of a written table of ``finish_windows``: an id with a failed window is a failure."""
    failures = written.filter(F.col("error").isNotNull()).groupBy("id").agg(F.min("error").alias("error"))
    alone = written.filter(F.col("start").isNotNull()).select("id", "start", *column_names(columns))
    every = alone.unionByName(finish_borders(written, finish, columns, **shape))
    return every.join(failures.select("id"), "id", "left_anti"), failures


def column_names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def reach_of(heads: Sequence[Mapping]) -> int:
    return max((kernel_reach(h) for h in heads), default=0)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
