"""Half-open intervals on keyed sequences: painting, windows, overlap sums.

Labels are kept as run-length segments ``(id, start, stop, label)``, so cost
follows the number of intervals, not the number of positions. Long sequences
are cut into fixed position blocks, so one sequence never has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import shuffle_width

BLOCK = 65_536
CHUNK = 256
#: Positions of training windows that a task turns into arrays together.
GATHERED = 1 << 20
#: Intervals whose events one task of the painting sorts.
TASK_ROWS = 1 << 20


def _blocks(start: Column, stop: Column, size: int) -> Column:
    """Numbers of the fixed blocks that ``[start, stop)`` touches."""
    return F.sequence(F.floor(start / size), F.floor((stop - 1) / size))


def checked_bounds(intervals: DataFrame, lengths: DataFrame, *, id_col: str = "id", name: str = "id") -> DataFrame:
    """Fail the job on an interval outside its sequence, or of an unknown one."""
    joined = intervals.join(lengths.select(id_col, "length"), id_col, "left")
    bad = F.col("length").isNull() | (F.col("start") < 0) | (F.col("stop") <= F.col("start")) | (
        F.col("stop") > F.col("length")
    )
    text = F.concat_ws(" ", F.lit("interval outside its sequence:"), F.col(name), F.col("start"), F.col("stop"))
    start = F.when(bad, F.raise_error(text).cast("bigint")).otherwise(F.col("start"))
    return joined.withColumn("start", start).drop("length")


def paint(
    intervals: DataFrame, lengths: DataFrame, *, id_col: str = "id", block: int = BLOCK, rows: int | None = None, blocks: bool = False
) -> DataFrame:
    """Label every position: def beats not beats uncertain, the default.

    ``intervals`` is ``(id, start, stop, label)``, ``lengths`` is ``(id,
    length)``. Intervals become signed events; events are summed per position
    before the sort, so any number of copies of one interval is one event pair.
    Returns gap-free segments ``(id, start, stop, label)``, with ``blocks`` also the number
    of the ``block`` they lie in. The sort is dealt to tasks of ``TASK_ROWS`` intervals or so,
    by their number ``rows`` (counted here if it is not given), not by a fixed number of tasks.
    """
    edge = F.lit(block).cast("bigint")
    marks = intervals.filter(F.col("label").isin("def", "not")).select(
        id_col,
        F.col("start").cast("bigint").alias("start"),
        F.col("stop").cast("bigint").alias("stop"),
        (F.col("label") == "def").cast("int").alias("d"),
        (F.col("label") == "not").cast("int").alias("n"),
    )

    low, high = F.greatest(F.col("start"), F.col("block") * edge), F.least(F.col("stop"), (F.col("block") + 1) * edge)
    pair = F.array(
        F.struct("block", low.alias("pos"), "d", "n"),
        F.struct("block", high.alias("pos"), (-F.col("d")).alias("d"), (-F.col("n")).alias("n")),
    )
    events = marks.select("*", F.explode(_blocks(F.col("start"), F.col("stop"), block)).alias("block")).select(
        id_col, F.explode(pair).alias("e"))
    sizes = lengths.filter(F.col("length") > 0).select(id_col, F.col("length").cast("bigint").alias("length"))
    spans = sizes.select(id_col, "length", F.explode(_blocks(F.lit(0), F.col("length"), block)).alias("block"))

    def anchor(pos: Column) -> Column:
        return F.struct(F.col("block"), pos.alias("pos"), F.lit(0).alias("d"), F.lit(0).alias("n"))

    anchors = spans.select(
        id_col,
        F.explode(F.array(anchor(F.col("block") * edge), anchor(F.least(F.col("length"), (F.col("block") + 1) * edge))))
        .alias("e"),
    )
    summed = (
        events.unionByName(anchors)
        .select(id_col, "e.*")
        .groupBy(id_col, "block", "pos")
        .agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    )
    if rows is None:
        rows = intervals.count()
    tasks = max(shuffle_width(intervals), -(-rows // TASK_ROWS))
    along = Window.partitionBy(id_col, "block").orderBy("pos")
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_def, open_not = F.sum("d").over(running), F.sum("n").over(running)
    return summed.repartition(tasks, id_col, "block").select(
        id_col,
        F.col("pos").alias("start"),
        F.lead("pos").over(along).alias("stop"),
        F.when(open_def > 0, "def").when(open_not > 0, "not").otherwise("uncertain").alias("label"),
        *(["block"] if blocks else []),
    ).filter(F.col("stop").isNotNull())


def merge_segments(segments: DataFrame, *, id_col: str = "id", block: int = BLOCK) -> DataFrame:
    """Join touching equal-label segments within each block (for compact output).

    Segments that carry their ``block`` are merged where they are. A run is its first and its
    last segment, side by side once those between are gone: no table of runs is held.
    """
    tagged = segments.withColumn("_b", F.col("block") if "block" in segments.columns else F.floor(F.col("start") / block))
    place = Window.partitionBy(id_col, "_b").orderBy("start")
    first = F.coalesce(
        (F.lag("label").over(place) != F.col("label")) | (F.lag("stop").over(place) != F.col("start")), F.lit(True)
    )
    ends = tagged.withColumn("_first", first).withColumn("_last", F.coalesce(F.lead("_first").over(place), F.lit(True)))
    kept = ends.filter("_first OR _last").withColumn("_stop", F.when(F.col("_last"), F.col("stop")).otherwise(F.lead("stop").over(place)))
    return kept.filter("_first").select(id_col, "start", F.col("_stop").alias("stop"), "label")


def segments_from_labels(labels: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Binary or three-way label arrays (``array<byte>`` of 0/1) to segments of one position each run."""
    # Every value beside its predecessor; positions where they differ start a run.
    # The array is read a fixed number of times, never once per element.
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(F.col("y"), F.lit(1), F.size("y") - 1).cast("array<int>"))
    pairs = F.zip_with(F.col("y").cast("array<int>"), before, lambda v, u: F.struct(v.alias("v"), u.alias("u")))
    starts = F.transform(
        pairs,
        lambda pair, i: F.when(pair["u"].isNull() | (pair["u"] != pair["v"]), F.struct(i.alias("at"), pair["v"].alias("v"))),
    )
    cut = labels.filter(F.size("y") > 0).select(id_col, F.size("y").alias("n"), F.array_compact(starts).alias("runs"))
    # Each run takes its stop from the next before exploding: no row carries the array of all.
    following = F.slice(F.col("runs"), F.lit(2), F.size("runs"))
    closed = F.zip_with(
        F.col("runs"), following,
        lambda run, after: F.struct(run["at"].alias("at"), F.coalesce(after["at"], F.col("n")).alias("stop"), run["v"].alias("v")),
    )
    return cut.select(id_col, F.explode(closed).alias("run")).select(
        id_col,
        F.col("run.at").cast("bigint").alias("start"),
        F.col("run.stop").cast("bigint").alias("stop"),
        F.when(F.col("run.v") == 1, "def").otherwise("not").alias("label"),
    )


def label_counts(segments: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Per id: valid, positive and negative positions; uncertain ones are masked."""
    size = F.col("stop") - F.col("start")
    return segments.groupBy(id_col).agg(
        F.sum(F.when(F.col("label") != "uncertain", size).otherwise(0)).alias("valid_residues"),
        F.sum(F.when(F.col("label") == "def", size).otherwise(0)).alias("positive_residues"),
        F.sum(F.when(F.col("label") == "not", size).otherwise(0)).alias("negative_residues"),
    )


def class_stats(segments: DataFrame, *keys: str) -> DataFrame:
    """Class counts and ``pos_weight = neg / max(1, pos)``, overall or per key."""
    size = F.col("stop") - F.col("start")
    sums = segments.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("label") == "def", size)), F.lit(0)).alias("pos_count"),
        F.coalesce(F.sum(F.when(F.col("label") == "not", size)), F.lit(0)).alias("neg_count"),
    )
    weight = F.col("neg_count").cast("double") / F.greatest(F.col("pos_count"), F.lit(1)).cast("double")
    return sums.withColumn("pos_weight", weight)


def combine_class_stats(stats: DataFrame) -> DataFrame:
    """``pos_weight`` over shards; negatives may sit in ``neg_count`` or ``neg_counts``."""
    names = [c for c in ("neg_count", "neg_counts") if c in stats.columns]
    if not names:
        raise ValueError("class stats need neg_count or neg_counts")
    negative = F.coalesce(*[F.col(c) for c in names])
    missing = F.raise_error(F.lit("class stats row without a negative count")).cast("bigint")
    total = stats.agg(
        F.sum("pos_count").alias("pos_count"), F.sum(F.coalesce(negative, missing)).alias("neg_count")
    )
    weight = F.col("neg_count").cast("double") / F.greatest(F.col("pos_count"), F.lit(1)).cast("double")
    return total.withColumn("pos_weight", weight)


def label_support(ids: DataFrame, segments: DataFrame, shards: DataFrame | None = None, *, id_col: str = "id") -> DataFrame:
    """Support per requested id; ids without labels stay, with zeros and a status."""
    counts = label_counts(segments, id_col=id_col).withColumn("_found", F.lit(True))
    out = ids.select(id_col).join(counts, id_col, "left")
    listed = F.col("_found").isNotNull()
    shard = F.lit(None).cast("string")
    if shards is not None:
        out = out.join(shards.select(id_col, "shard"), id_col, "left")
        listed, shard = F.col("shard").isNotNull(), F.col("shard")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("valid_residues", "positive_residues", "negative_residues")]
    status = F.when(~listed, "missing_label").when(F.col("_found").isNull(), "missing_label_tensor").otherwise("ok")
    return out.select(id_col, *zero, shard.alias("label_shard"), status.alias("status"))


def window_spans(length: Column, window: int | None = 1000, stride: int | None = 900) -> Column:
    """Array of ``struct(start, stop)``: starts step by ``stride`` until a window
    reaches the end. The number of windows has a closed form."""
    size = length.cast("bigint")
    none = F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>")
    if window is None or window <= 0:
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("stop")))
        return whole.cast("array<struct<start:bigint,stop:bigint>>")
    if stride is None or stride <= 0:
        raise ValueError("stride must be > 0")
    last = F.least(F.ceil((size - window) / stride), F.floor((size - 1) / stride))
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), last))
    spans = F.transform(
        steps,
        lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + window, size).alias("stop")),
    )
    return F.when(size <= 0, none).otherwise(spans.cast("array<struct<start:bigint,stop:bigint>>"))


def sequence_windows(
    lengths: DataFrame, window: int | None = 1000, stride: int | None = 900, *, id_col: str = "id"
) -> DataFrame:
    """One row per window ``(id, start, stop)``."""
    return lengths.select(id_col, F.explode(window_spans(F.col("length"), window, stride)).alias("w")).select(
        id_col, "w.start", "w.stop"
    )


def overlap_totals(
    spans: DataFrame,
    segments: DataFrame,
    *,
    row_key: str,
    counted: Column | None = None,
    id_col: str = "id",
    out: str = "n_overlap",
    chunk: int = CHUNK,
) -> DataFrame:
    """``(row_key, out)``: positions of the ``counted`` segments inside each span.

    A span that meets no segment at all has no row, one that meets only uncounted
    segments counts 0. ``segments`` must not overlap each other. Both sides are cut into
    position chunks and joined on (id, chunk): a span meets at most ``chunk``
    segments per chunk it touches, however many spans or segments the id has.
    """
    edge = F.lit(chunk).cast("bigint")
    weight = F.lit(1) if counted is None else counted.cast("int")

    def pieces(df: DataFrame, *keep: Column | str) -> DataFrame:
        cut = df.select(*keep, id_col, "start", "stop", F.explode(_blocks(F.col("start"), F.col("stop"), chunk)).alias("_c"))
        low = F.greatest(F.col("start").cast("bigint"), F.col("_c") * edge)
        high = F.least(F.col("stop").cast("bigint"), (F.col("_c") + 1) * edge)
        return cut.withColumns({"_low": low, "_high": high}).drop("start", "stop")

    left = pieces(spans, row_key)
    right = pieces(segments, weight.alias("_weight")).withColumnsRenamed({"_low": "_s", "_high": "_e"})
    meets = (F.col("_s") < F.col("_high")) & (F.col("_e") > F.col("_low"))
    shared = (F.least("_high", "_e") - F.greatest("_low", "_s")) * F.col("_weight")
    return left.join(right, [id_col, "_c"]).filter(meets).groupBy(row_key).agg(F.sum(shared).alias(out))


def window_support(windows: DataFrame, segments: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Valid positions per window; a zero marks a window that trains on nothing."""
    keyed = windows.withColumn("_w", F.struct(id_col, "start"))
    valid = segments.filter(F.col("label") != "uncertain")
    totals = overlap_totals(keyed, valid, row_key="_w", id_col=id_col, out="n_valid")
    return keyed.join(totals, "_w", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0))).drop("_w")


def label_strings(segments: DataFrame, *, id_col: str = "id", chunk: int | None = None) -> DataFrame:
    """Label letters ``d``/``n``/``u`` per position, whole or in chunks of ``chunk``."""
    letter = F.substring("label", 1, 1)
    source, keys = segments, [id_col]
    if chunk:
        edge = F.lit(chunk).cast("bigint")
        cut = segments.withColumn("chunk", F.explode(_blocks(F.col("start"), F.col("stop"), chunk)))
        source = cut.withColumn("start", F.greatest("start", F.col("chunk") * edge)).withColumn(
            "stop", F.least("stop", (F.col("chunk") + 1) * edge)
        )
        keys = [id_col, "chunk"]
    run = F.repeat(letter, (F.col("stop") - F.col("start")).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("start", run.alias("run"))))
    return source.groupBy(*keys).agg(F.array_join(ordered["run"], "").alias("labels"))


def training_windows(
    labels: DataFrame, *, id_col: str = "id", window: int | None = 1000, stride: int | None = 900, pad: bool = True
) -> DataFrame:
    """Windowed training examples: targets ``y`` and ``mask`` (0 on uncertain and padding).

    ``labels`` holds one label string per id over ``d``, ``n``, ``u``.
    """
    # Windows are cut inside the row, so no window carries the whole string.
    texts = F.transform(
        window_spans(F.length("labels"), window, stride),
        lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.substring(
            F.col("labels"), (w["start"] + 1).cast("int"), (w["stop"] - w["start"]).cast("int")).alias("labels")),
    )
    cut = labels.select(id_col, F.explode(texts).alias("w")).select(id_col, "w.start", "w.stop", "w.labels")
    width = window if pad and window else 0

    def targets(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("labels")
        n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.maximum(n, width))])
        # Every letter goes to its place in the padded rows; what no letter fills stays 0.
        at = np.arange(len(letters)) + np.repeat(ends[:-1] - (np.cumsum(n) - n), n)
        lists = []
        for hit in (letters == ord("d"), letters != ord("u")):
            flat = np.zeros(ends[-1], np.int32)
            flat[at] = hit
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, "start", "stop")), *lists], [id_col, "start", "stop", "y", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.maximum(pc.binary_length(batch.column("labels")).to_numpy(zero_copy_only=False), width)
            part = np.cumsum(size) // GATHERED  # rows of a bounded number of positions are handled together
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    yield targets(batch.slice(low, high - low))

    kind = labels.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(run, f"`{id_col}` {kind}, start bigint, stop bigint, y array<int>, mask array<int>")


def peptide_lists(
    peptides: DataFrame, *, id_col: str = "id", order: str = "source_order", parts: int = 1
) -> DataFrame:
    """Nested peptide list per id in row order, with the first row's full name.

    With ``parts`` > 1 each id's list is written as that many ordered ``part``
    lists, so an id holding a third of all peptides is not one row.
    """
    from spanforge.functions.text import family_of, fullname_part

    one_hot = F.when(F.col("label") == "def", F.array(F.lit(1), F.lit(0), F.lit(0))).when(
        F.col("label") == "not", F.array(F.lit(0), F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0), F.lit(1), F.lit(0)))
    item = F.struct(
        F.col("code_name"), F.col("peptide"), F.col("start").alias("align_start"), F.col("stop").alias("align_stop"),
        one_hot.alias("label_onehot"), F.col("fullname"),
    )
    row, keys = F.struct(F.col(order).alias("o"), item.alias("p")), [id_col]
    # The id's first row names it in all its parts; one small row per id, combined before the shuffle.
    names = peptides.groupBy(id_col).agg(F.min(row)["p"]["fullname"].alias("_name")) if parts > 1 else None
    if parts > 1:
        peptides = peptides.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)))
        keys = [id_col, "part"]
    grouped = peptides.groupBy(*keys).agg(
        F.sort_array(F.collect_list(row))["p"].alias("peptides")
    )
    if names is None:
        grouped = grouped.withColumn("_name", F.col("peptides")[0]["fullname"])
    else:
        grouped = grouped.join(names, id_col)
    name = F.col("_name")
    oxx = fullname_part(name, 3)
    tax = F.struct(name.alias("fullname"), fullname_part(name, 1).alias("protein_id"),
                   fullname_part(name, 2).alias("ac"), oxx.alias("oxx"), family_of(oxx).alias("family"))
    return grouped.select(*keys, tax.alias("tax_info"), "peptides")
