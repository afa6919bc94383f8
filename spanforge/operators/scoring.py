"""Per-position vectors: batched embedding, window stitching, dense/conv scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import length_feature
from spanforge.operators.intervals import window_spans
from spanforge.session import cut_lineage

# Longest input in tokens, and the window geometry beyond it.
MAX_TOKENS = 1022
WINDOW, STRIDE = 1000, 900
#: Blocks (of a window's positions at most) that are unpacked into rows together.
UNPACKED = 32
#: Bytes of vectors a task gathers before it hands them on.
HELD = 4 << 20


def average_vectors(pieces: DataFrame, keys: Sequence[str] = ("id", "pos"), vector: str = "vec") -> DataFrame:
    """Element-wise mean of the vectors of each key, combined on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return pieces.groupBy(*keys).agg(vector_to_array(mean).alias(vector), F.count(F.lit(1)).alias("n_windows"))


def packed_batches(lengths: Sequence[int], budget: int, per_item: int = MAX_TOKENS) -> list[int]:
    """Batch number of each item under greedy filling of a token budget."""
    batch, used, out = 0, 0, []
    for n in lengths:
        need = min(int(n), per_item)
        if used and used + need > budget:
            batch, used = batch + 1, 0
        used += need
        out.append(batch)
    return out


def _vector_list(rows: np.ndarray) -> pa.Array:
    """A (n, dim) matrix as an Arrow list column, without Python objects per row."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim),
                                    pa.array(np.ascontiguousarray(rows, dtype=float).reshape(-1)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal-length vectors as a (n, dim) matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def _sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def spans_of(length: Column, max_tokens: int = MAX_TOKENS, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """The windows of a sequence as (start, stop) pairs; null for an empty one."""
    return F.when(length.between(1, max_tokens), window_spans(length, None)).when(length > max_tokens, window_spans(length, window, stride))


def window_texts(
    sequences: DataFrame, max_tokens: int = MAX_TOKENS, window: int = WINDOW, stride: int = STRIDE,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The windows ``(id, start, length, sequence)`` of non-empty sequences, similar lengths together.
    ``keep`` may drop windows before they are dealt."""
    n = F.length("sequence").cast("bigint")
    sized = sequences.select("id", "sequence", n.alias("length"), (F.octet_length("sequence") == n).alias("plain"))
    # Empty texts have no spans. A filter would be moved ahead of the caller's cleaning and clean every text twice.
    spans = spans_of(F.col("length"), max_tokens, window, stride)
    # Window texts are cut inside the row, so no copy of the whole text per window. In a text of one byte per
    # letter they are cut by bytes: to find a letter, the text would be read from its beginning for every window.
    def cut(w: Column) -> Column:
        at, size = (w["start"] + 1).cast("int"), (w["stop"] - w["start"]).cast("int")
        by_bytes = F.substring(F.col("sequence").cast("binary"), at, size).cast("string")
        return F.struct(w["start"].alias("start"), F.when(F.col("plain"), by_bytes).otherwise(F.substring("sequence", at, size)).alias("sequence"))

    texts = F.transform(spans, cut)
    work = sized.select("id", "length", F.explode(texts).alias("w")).select("id", "w.start", "length", "w.sequence")
    work = keep(work) if keep else work
    # Dealt by key, not by range: ranges would be sampled, and the texts cleaned and cut once more for that.
    return work.repartition("id", "start").sortWithinPartitions(F.length("sequence"))


def attempt_batch(embed: Callable[[Sequence[str]], Sequence[np.ndarray]], texts: list[str]) -> list:
    """Vectors of a batch; on failure one by one, with the error text in place."""
    try:
        return list(embed(texts))
    except Exception:
        out = []
        for t in texts:
            try:
                out.append(embed([t])[0])
            except Exception as exc:
                out.append(str(exc))
        return out


def with_length(x: np.ndarray, length: int, feature: str) -> np.ndarray:
    """The vectors with the sequence length or its inverse appended."""
    if feature == "none":
        return x
    value = float(length) if feature == "raw" else 1.0 / length
    return np.concatenate([x, np.full((len(x), 1), value)], axis=1)


def embed_windows(
    sequences: DataFrame,
    embed: Callable[[Sequence[str]], Sequence[np.ndarray]],
    *,
    feature: str = "none",
    budget: int = 8 * MAX_TOKENS,
    max_tokens: int = MAX_TOKENS,
    window: int = WINDOW,
    stride: int = STRIDE,
) -> DataFrame:
    """Embed every sequence: packed pieces ``(id, start, n, dim, share, block, error)`` of its windows.

    Short sequences are one window. Long ones are cut into overlapping windows
    first, so a very long sequence spreads over tasks. A piece is a run of ``n`` positions
    from ``start`` with equal ``share``: 0 where one window alone covers them, else the
    1-based number of this window among those that do. Its ``block`` has their vectors as
    64-bit values, so what is written and shuffled is a few rows per window. The length
    ``feature`` is appended where the vectors are made. Tasks go through windows of similar
    length, fill token-packed batches and turn a failing item into one error row instead
    of failing the job.
    """
    work = window_texts(sequences, max_tokens, window, stride)
    id_type = _sql_type(sequences, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts, starts = batch.column("sequence").to_pylist(), batch.column("start").to_pylist()
            lengths, ids = batch.column("length").to_pylist(), batch.column("id")
            packed = np.array(packed_batches([len(t) for t in texts], budget, max_tokens))
            ends = np.append(np.flatnonzero(np.diff(packed)) + 1, len(texts))
            begin, out, held = 0, [], 0
            for end in ends:
                for i, found in enumerate(attempt_batch(embed, texts[begin:end]), begin):
                    if isinstance(found, str):
                        out.append((i, None, None, None, None, None, found))
                        continue
                    x = with_length(np.asarray(found, dtype=float), lengths[i], feature)
                    for low, high, share in _pieces(starts[i], len(x), lengths[i], max_tokens, window, stride):
                        out.append((i, starts[i] + low, high - low, x.shape[1], share, x[low:high].astype("<f8", copy=False).tobytes(), None))
                    held += x.nbytes
                begin = end
                if not out or (held < HELD and end < len(texts)):
                    continue
                owner, *columns = zip(*out)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["id", "start", "n", "dim", "share", "block", "error"])
                out, held = [], 0

    return work.mapInArrow(run, f"id {id_type}, start bigint, n int, dim int, share int, block binary, error string")


def _pieces(start: int, n: int, length: int, max_tokens: int, window: int, stride: int) -> list[tuple[int, int, int]]:
    """Runs ``(from, to, share)`` of a window of ``n`` positions, within the window."""
    if length <= max_tokens:
        return [(0, n, 0)] if n else []
    low, high = covering_windows(start + np.arange(n), np.full(n, length), window, stride)
    share = np.where(high > low, start // stride - low + 1, 0)
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), n]
    return [(a, b, int(share[a])) for a, b in zip(cuts, cuts[1:]) if a < b]


def covering_windows(pos: np.ndarray, length: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and the last window of a sequence that contain each position."""
    last = np.maximum(0, np.minimum(-(-(length - window) // stride), (length - 1) // stride))
    return np.maximum(0, (pos - window) // stride + 1), np.minimum(pos // stride, last)


def stitch(
    windows: DataFrame, lengths: DataFrame | None = None, *, feature: str = "none", window: int = WINDOW,
    stride: int = STRIDE,
) -> DataFrame:
    """Position vectors ``(id, pos, vec)``; positions in several windows are averaged.

    Only pieces with those positions shuffle: all others are final where they were computed.
    Rows per position are made last.
    """
    if window <= 2 * stride:
        out = unpack_blocks(stitch_blocks(windows, window=window, stride=stride), "double")
    else:
        rows = windows.filter(F.col("error").isNull())
        merged = average_vectors(unpack_blocks(rows.filter(F.col("share") > 0), "double")).select("id", "pos", "vec")
        out = unpack_blocks(rows.filter(F.col("share") == 0), "double").unionByName(merged)
    if feature == "none":
        return out
    if lengths is None:
        raise ValueError("a length feature needs the sequence lengths")
    return out.join(lengths.select("id", "length"), "id").select(
        "id", "pos", length_feature(F.col("vec"), F.col("length"), feature).alias("vec")
    )


def stitch_blocks(windows: DataFrame, *, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Packed position vectors ``(id, start, n, dim, block)``; with at most two windows per
    position the average is a join of the two, block by block."""
    if window > 2 * stride:
        raise ValueError("windows must overlap by half at most to be stitched as blocks")
    rows = windows.filter(F.col("error").isNull())
    single = rows.filter(F.col("share") == 0).select("id", "start", "n", "dim", "block")
    first = rows.filter(F.col("share") == 1).select("id", "start", "n", "dim", F.col("block").alias("_a"))
    second = rows.filter(F.col("share") == 2).select("id", "start", F.col("block").alias("_b"))
    return single.unionByName(_mean_blocks(first.join(second, ["id", "start"])))


def block_totals(blocks: DataFrame) -> DataFrame:
    """``(id, start, n, total, last)`` of packed 64-bit blocks: the sum of their vectors and the last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = [np.frombuffer(b, "<f8").reshape(-1, dim) for b, dim in zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist())]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "start", "n")), pa.array([x.sum(axis=0) for x in parts], kind), pa.array([x[-1] for x in parts], kind)],
                ["id", "start", "n", "total", "last"])

    return blocks.select("id", "start", "n", "dim", "block").mapInArrow(
        run, f"id {_sql_type(blocks, 'id')}, start bigint, n int, total array<double>, last array<double>")


def _mean_blocks(pairs: DataFrame) -> DataFrame:
    """Packed pieces whose vectors are the means of two windows' blocks ``_a`` and ``_b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())
            mean = [((np.frombuffer(a, "<f8") + np.frombuffer(b, "<f8")) / 2.0).tobytes() for a, b in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "start", "n", "dim")), pa.array(mean, pa.binary())],
                                             ["id", "start", "n", "dim", "block"])

    return pairs.mapInArrow(run, f"id {_sql_type(pairs, 'id')}, start bigint, n int, dim int, block binary")


def pack_planes(x: np.ndarray) -> bytes:
    """Vectors as 32-bit values, byte by byte: the first byte of each position, then the second of each, and so on.
    Bytes that are alike lie together, which a codec packs several times smaller than whole values."""
    return np.ascontiguousarray(x, dtype="<f4").view(np.uint8).reshape(len(x), -1).T.tobytes()


def unpack_planes(block: bytes, dim: int) -> np.ndarray:
    """The (n, dim) vectors of ``pack_planes``."""
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(4 * dim, -1).T).view("<f4")


def unpack_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """``(id, pos, vec)`` of packed ``(id, start, n, dim, block)``, for what works on positions: blocks of 64-bit
    values of ``kind`` double, or of ``pack_planes`` of ``kind`` float."""
    values = {
        "float": lambda block, dim: unpack_planes(block, dim).reshape(-1),
        "double": lambda block, dim: np.frombuffer(block, "<f8"),
    }[kind]

    def unpacked(part):
        n, dim = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "dim"))
        ends = np.concatenate([[0], np.cumsum(np.repeat(dim, n))]).astype(np.int32)
        flat = np.concatenate([values(b, d) for b, d in zip(part.column("block").to_pylist(), dim.tolist())])
        vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), vectors)
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("start"), whole], ["id", "start", "vecs"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, UNPACKED):
                yield unpacked(batch.slice(at, UNPACKED))

    # A row per block leaves Python; Spark makes the rows per position, without a copy of id and vector for each.
    arrays = blocks.select("id", "start", "n", "dim", "block").mapInArrow(run, f"id {_sql_type(blocks, 'id')}, start bigint, vecs array<array<{kind}>>")
    return arrays.select("id", "start", F.posexplode("vecs").alias("at", "vec")).select("id", (F.col("start") + F.col("at")).alias("pos"), "vec")


def vector_index(vectors: DataFrame, *, feature: str = "none", model: str = "") -> DataFrame:
    """Index row per id of a position-vector table."""
    extra = 0 if feature == "none" else 1
    return vectors.groupBy("id").agg(
        F.count(F.lit(1)).alias("length"), F.max(F.size("vec")).alias("embed_dim")
    ).select(
        "id",
        "length",
        "embed_dim",
        F.col("length").alias("original_seq_len"),
        F.lit(feature).alias("seq_len_feature"),
        F.when(F.col("length") <= MAX_TOKENS, "short").otherwise("long").alias("handle"),
        F.lit(model).alias("model"),
        (F.col("embed_dim") - extra).alias("base_dim"),
    )


def failed_ids(windows: DataFrame) -> DataFrame:
    """Ids with a failed window, with one error text."""
    return windows.filter(F.col("error").isNotNull()).groupBy("id").agg(F.min("error").alias("error"))


# --- heads -----------------------------------------------------------------


def linear_logit(vector: Column, weights: Sequence[float], bias: float) -> Column:
    """Linear head as an expression: no Python in the scan."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    products = F.zip_with(vector.cast("array<double>"), w, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) + F.lit(float(bias))


def dense_forward(x: np.ndarray, head: Mapping) -> np.ndarray:
    """Logits of rows under a stack of dense blocks and a linear output.

    A block is ``{"w": (out, in), "b": (out,), "gain"/"shift": layer norm or
    absent, "skip": None | "same" | {"w", "b"}}``.
    """
    for block in head["blocks"]:
        y = x @ np.asarray(block["w"]).T + np.asarray(block["b"])
        if block.get("gain") is not None:
            centred = y - y.mean(axis=1, keepdims=True)
            y = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
            y = y * np.asarray(block["gain"]) + np.asarray(block["shift"])
        y = np.maximum(y, 0.0)
        skip = block.get("skip")
        if skip == "same":
            y = y + x
        elif skip:
            y = y + x @ np.asarray(skip["w"]).T + np.asarray(skip["b"])
        x = y
    return x @ np.asarray(head["w"]) + float(head["b"])


def conv_features(x: np.ndarray, layers: Sequence[Mapping], inside: np.ndarray) -> np.ndarray:
    """Same-length convolutions with ReLU along rows; rows outside the sequence stay zero."""
    y = x * inside[:, None]
    for layer in layers:
        w = np.asarray(layer["w"])  # (out, in, kernel)
        kernel = w.shape[2]
        padded = np.pad(y, ((kernel // 2, kernel // 2), (0, 0)))
        y = sum(padded[k:k + len(x)] @ w[:, :, k].T for k in range(kernel)) + np.asarray(layer["b"])
        y = np.maximum(y, 0.0) * inside[:, None]
    return y


def kernel_reach(head: Mapping) -> int:
    """How many positions to either side the stacked kernels of a head look."""
    return sum(np.asarray(c["w"]).shape[2] // 2 for c in head.get("conv", ()))


def sigmoid_of(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def score_members(vectors: DataFrame, heads: Mapping[str, Mapping]) -> DataFrame:
    """``(id, pos, ps)``: the probabilities of all members, in member order, in one pass."""
    chosen = list(heads.values())
    id_type = _sql_type(vectors, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column("vec"))
            ps = np.stack([sigmoid_of(dense_forward(x, head)) for head in chosen], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pos"), _vector_list(ps)],
                                             ["id", "pos", "ps"])

    rows = vectors.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"id {id_type}, pos bigint, ps array<double>")


def by_member(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Member probabilities as rows ``(id, pos, member, p)``."""
    table = F.array(*[F.lit(str(n)) for n in names])
    return scores.select("id", "pos", F.posexplode("ps").alias("at", "p")).select(
        "id", "pos", F.get(table, F.col("at")).alias("member"), "p"
    )


def score_dense(vectors: DataFrame, heads: Mapping[str, Mapping]) -> DataFrame:
    """``(id, pos, member, p)`` of dense heads."""
    return by_member(score_members(vectors, heads), list(heads))


class _Run:
    """Consecutive positions of one id, scored as they come in, ``block`` rows at a time."""

    def __init__(self, owner, kind: pa.DataType, first: int, open_start: bool, heads: Sequence[Mapping], reach: int) -> None:
        self.owner, self.kind, self.heads, self.reach, self.open_start = owner, kind, heads, reach, open_start
        self.at = first  # position of the first row held
        self.rows: list[np.ndarray] = []
        self.held = self.done = 0  # rows held, and those of them that are finished or left to the border

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.held += len(rows)

    def next(self) -> int:
        return self.at + self.held

    def score(self, last: bool, open_end: bool):
        """(first position, probabilities) of what can be finished now; keeps what later rows need."""
        x = np.concatenate(self.rows)
        begin = min(self.reach, self.held) if self.open_start and not self.done else self.done
        end = self.held if last and not open_end else max(begin, self.held - self.reach)
        out = None
        if begin < end:
            inside = np.ones(self.held)
            ps = np.stack([
                sigmoid_of(dense_forward(np.concatenate([x, conv_features(x, h["conv"], inside)], axis=1)[begin:end], h)) for h in self.heads], axis=1)
            out = (self.at + begin, ps)
        drop = max(0, end - 2 * self.reach)
        self.rows, self.at, self.held, self.done = [x[drop:]], self.at + drop, self.held - drop, end - drop
        self.open_start = self.open_start and drop == 0
        return out


def score_members_conv(vectors: DataFrame, heads: Mapping[str, Mapping], *, block: int = 4096) -> DataFrame:
    """``(id, pos, ps)`` of conv-context heads (``{"conv": [...], **dense head}``).

    Positions are cut into ranges of (id, position), one shuffle, and a task scores its
    ranges as a stream of ``block`` rows, whatever the length of a sequence. Only rows within
    twice the kernels' reach of a border between ranges are passed on; there the positions
    next to the border are scored. Positions of an id follow each other without gaps; a gap
    ends a sequence.
    """
    chosen = list(heads.values())
    reach = max(map(kernel_reach, chosen))
    if reach >= block:
        raise ValueError("block must exceed the reach of the kernels")
    id_type = _sql_type(vectors, "id")
    strip = 2 * reach

    def stream(batches: Iterator[pa.RecordBatch], whole: bool):
        """Runs of the sorted rows: yields (what, run or rows). ``whole``: a run's ends are its sequence's ends."""
        run, before = None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, pos, x = batch.column("id").to_pylist(), batch.column("pos").to_numpy(), _matrix(batch.column("vec"))
            cuts = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or pos[i] != pos[i - 1] + 1]
            for low, high in zip([0, *cuts], [*cuts, len(ids)]):
                if run is None or run.owner != ids[low] or run.next() != pos[low]:
                    if run is not None:
                        yield run, True, False
                    run = _Run(ids[low], batch.column("id").type, int(pos[low]), before and not whole and pos[low] > 0, chosen, reach)
                    before = False
                for at in range(low, high, block):
                    run.add(x[at : min(at + block, high)])
                    if run.held >= block + strip:
                        yield run, False, False
        if run is not None:
            yield run, True, not whole

    def rows(run: _Run, first: int, ps=None, vec=None, pending=None) -> pa.RecordBatch:
        n = len(ps) if ps is not None else len(vec)
        return pa.RecordBatch.from_arrays(
            [pa.array([run.owner] * n, run.kind), pa.array(first + np.arange(n)), _vector_list(ps) if ps is not None else pa.nulls(n, pa.list_(pa.float64())),
             _vector_list(vec) if vec is not None else pa.nulls(n, pa.list_(pa.float64())), pa.array(pending if pending is not None else np.zeros(n, bool))],
            ["id", "pos", "ps", "vec", "pending"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, last, open_end in stream(batches, False):
            both = False
            if run.open_start and reach:  # still whole: no row has been let go
                x = np.concatenate(run.rows)
                both = last and open_end and run.held <= 2 * strip
                head = x if both else x[:strip]
                near = np.arange(len(head))
                pending = (near < reach) | (near >= run.held - reach if last and open_end else False)
                yield rows(run, run.at, vec=head, pending=pending)
            found = run.score(last, open_end)
            if found:
                yield rows(run, found[0], ps=found[1])
            if last and open_end and reach and not both:
                tail = np.concatenate(run.rows)[-strip:]
                yield rows(run, run.next() - len(tail), vec=tail, pending=np.arange(len(tail)) >= len(tail) - reach)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, last, _ in stream(batches, True):
            found = run.score(last, False)
            if found:
                yield rows(run, found[0], ps=found[1]).select(["id", "pos", "ps"])

    narrow = vectors.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    cut = narrow.repartitionByRange("id", "pos").sortWithinPartitions("id", "pos")
    schema = f"id {id_type}, pos bigint, ps array<double>"
    done = cut_lineage(cut.mapInArrow(ranges, f"{schema}, vec array<double>, pending boolean"))
    strips = done.filter(F.col("vec").isNotNull())
    near = strips.select("id", "pos", "vec").repartition("id").sortWithinPartitions("id", "pos").mapInArrow(borders, schema)
    waiting = strips.filter("pending").select("id", "pos")
    return done.filter(F.col("ps").isNotNull()).select("id", "pos", "ps").unionByName(near.join(waiting, ["id", "pos"]))


def score_conv(vectors: DataFrame, heads: Mapping[str, Mapping], *, block: int = 4096) -> DataFrame:
    """``(id, pos, member, p)`` of conv-context heads."""
    return by_member(score_members_conv(vectors, heads, block=block), list(heads))
