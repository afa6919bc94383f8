import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import intervals as I


def windows(spark, length, window, stride):
    row = spark.range(1).select(I.window_spans(F.lit(length), window, stride).alias("w")).first()
    return [(w["start"], w["stop"]) for w in row["w"]]


def test_window_starts(spark):
    assert [a for a, _ in windows(spark, 2050, 1000, 900)] == [0, 900, 1800]
    assert windows(spark, 1000, 1000, 900) == [(0, 1000)]
    assert [a for a, _ in windows(spark, 1001, 1000, 900)] == [0, 900]
    assert [a for a, _ in windows(spark, 10, 2, 5)] == [0, 5]
    assert windows(spark, 5, None, None) == [(0, 5)]
    assert windows(spark, 0, 4, 2) == []


@pytest.mark.parametrize("window,stride", [(7, 3), (4, 4), (3, 8), (10, 1)])
def test_windows_against_loop(spark, window, stride):
    for length in range(1, 40):
        want, start = [], 0
        while start < length:
            want.append((start, min(start + window, length)))
            if want[-1][1] == length:
                break
            start += stride
        assert windows(spark, length, window, stride) == want


@pytest.mark.parametrize("block", [8, 64, 65_536])
def test_paint_against_positions(spark, block):
    rng = np.random.default_rng(block)
    sizes = {f"s{i}": int(rng.integers(1, 120)) for i in range(12)}
    rows = []
    for _ in range(400):
        name = f"s{rng.integers(0, 12)}" if rng.random() > .4 else "s0"  # s0 is hot
        start = int(rng.integers(0, sizes[name]))
        stop = int(rng.integers(start + 1, sizes[name] + 1))
        rows.append((name, start, stop, str(rng.choice(["def", "not", "uncertain"]))))
    want = {n: ["u"] * s for n, s in sizes.items()}
    for mark in ("not", "def"):
        for n, a, b, label in rows:
            if label == mark:
                want[n][a:b] = [mark[0]] * (b - a)
    painted = I.paint(spark.createDataFrame(rows, "id string, start int, stop int, label string"),
                      spark.createDataFrame(list(sizes.items()), "id string, length int"), block=block)
    got = {r["id"]: r["labels"] for r in I.label_strings(painted).collect()}
    assert got == {n: "".join(v) for n, v in want.items()}
    merged = {r["id"]: r["labels"] for r in I.label_strings(I.merge_segments(painted, block=block)).collect()}
    assert merged == got


def test_merging_stays_in_the_painted_tasks(spark, monkeypatch):
    """Tasks follow the number of intervals, and runs are merged in them: no exchange, no table of runs."""
    rows = [(i, s, s + w, label) for i in range(40) for s, w, label in ((0, 3, "def"), (3, 4, "def"), (2, 9, "not"), (70, 5, "not"), (60, 20, "def"))]
    spans = spark.createDataFrame(rows, "id long, start int, stop int, label string")
    sizes = spark.createDataFrame([(i, 100) for i in range(41)], "id long, length int")
    monkeypatch.setattr(I, "TASK_ROWS", 20)
    painted = I.paint(spans, sizes, block=64, blocks=True)
    merged = I.merge_segments(painted, block=64)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (painted, merged)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") == 2 and "_run" not in plans[1]
    assert painted.rdd.getNumPartitions() == 10
    got: dict = {}
    for r in merged.orderBy("id", "start").collect():
        got.setdefault(r["id"], []).append((r["start"], r["stop"], r["label"]))
    want = [(0, 7, "def"), (7, 11, "not"), (11, 60, "uncertain"), (60, 64, "def"), (64, 80, "def"), (80, 100, "uncertain")]
    assert got == {i: want for i in range(40)} | {40: [(0, 64, "uncertain"), (64, 100, "uncertain")]}
    plain = I.merge_segments(I.paint(spans, sizes, block=64, rows=len(rows)), block=64)
    assert sorted(plain.collect()) == sorted(merged.collect())


def test_overlap_sum(spark):
    segments = spark.createDataFrame([("a", 0, 300, "def"), ("a", 300, 320, "not"), ("a", 320, 900, "def")],
                                     "id string, start int, stop int, label string")
    spans = spark.createDataFrame([(1, "a", 250, 350), (2, "a", 300, 310), (3, "b", 0, 5), (4, "a", 0, 900)],
                                  "row int, id string, start int, stop int")
    out = I.overlap_totals(spans, segments, row_key="row", counted=F.col("label") == "def")
    assert {r["row"]: r["n_overlap"] for r in out.collect()} == {1: 80, 2: 0, 4: 880}


def test_training_windows_and_mask(spark):
    labels = spark.createDataFrame([("p", "dundn")], "id string, labels string")
    rows = I.training_windows(labels, window=4, stride=4).orderBy("start").collect()
    assert [r["mask"] for r in rows] == [[1, 0, 1, 1], [1, 0, 0, 0]]
    assert [r["y"] for r in rows] == [[1, 0, 0, 1], [0, 0, 0, 0]]
    whole = I.training_windows(labels, window=None).first()
    assert (whole["start"], whole["stop"]) == (0, 5)


def test_training_windows_are_filled_by_batch(spark, monkeypatch):
    """Targets come from whole batches of letters, cut at any row, not from a loop over each letter."""
    texts = {"a": "dun" * 7, "b": "", "c": "d", "e": "u" * 4, "f": "n" * 9}
    labels = spark.createDataFrame(list(texts.items()), "key string, labels string")
    for gathered in (1, 7, 1 << 20):
        monkeypatch.setattr(I, "GATHERED", gathered)
        for window, stride, pad in ((4, 3, True), (4, 3, False), (None, None, True)):
            rows = I.training_windows(labels, id_col="key", window=window, stride=stride, pad=pad)
            assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
            got = rows.collect()
            assert len({(r["key"], r["start"]) for r in got}) == len(got) and {r["key"] for r in got} - {"b"} == {"a", "c", "e", "f"}
            for r in got:
                cut = texts[r["key"]][r["start"]:r["stop"]]
                room = [0] * (window - len(cut)) if pad and window else []
                assert r["y"] == [int(c == "d") for c in cut] + room and r["mask"] == [int(c != "u") for c in cut] + room


def test_support_and_weights(spark):
    segments = spark.createDataFrame([("b", 0, 2, "def"), ("b", 2, 4, "not"), ("u", 0, 2, "uncertain")],
                                     "id string, start int, stop int, label string")
    ids = spark.createDataFrame([("b",), ("u",), ("x",)], "id string")
    got = {r["id"]: (r["valid_residues"], r["positive_residues"], r["status"]) for r in I.label_support(ids, segments).collect()}
    assert got == {"b": (4, 2, "ok"), "u": (0, 0, "ok"), "x": (0, 0, "missing_label")}
    stats = spark.createDataFrame([(2, 6, None), (1, None, 5)], "pos_count int, neg_count int, neg_counts int")
    assert I.combine_class_stats(stats).first()["pos_weight"] == pytest.approx(11 / 3)
    assert I.combine_class_stats(stats.limit(1)).first()["pos_weight"] == 3
    zero = spark.createDataFrame([(0, 7)], "pos_count int, neg_count int")
    assert I.combine_class_stats(zero).first()["pos_weight"] == 7
    with pytest.raises(Exception, match="negative count"):
        I.combine_class_stats(spark.createDataFrame([(1, None)], "pos_count int, neg_count int")).collect()


def test_runs_of_label_arrays(spark):
    rows = [("a", [1, 1, 0, 0, 1]), ("b", [0]), ("c", []), ("d", [1, 0, 1, 0])]
    labels = spark.createDataFrame(rows, "id string, y array<int>")
    got = sorted((r.id, r.start, r.stop, r.label) for r in I.segments_from_labels(labels).collect())
    want = []
    for name, y in rows:
        at = 0
        for value, run in itertools.groupby(y):
            n = len(list(run))
            want.append((name, at, at + n, "def" if value else "not"))
            at += n
    assert got == sorted(want)


def test_peptide_list_parts_share_the_first_name(spark):
    rows = [("p", f"c{i}", "PEP", i, i + 3, "def", f"ID=p AC=a OXX=1,{i}", i) for i in range(40)]
    peptides = spark.createDataFrame(rows, "id string, code_name string, peptide string, start long, stop long, label string, fullname string, source_order long")
    whole, parts = I.peptide_lists(peptides).collect(), I.peptide_lists(peptides, parts=3).collect()
    assert len(whole) == 1 and len(parts) == 3
    assert {r.tax_info for r in parts} == {whole[0].tax_info}
    assert sorted(p.code_name for r in parts for p in r.peptides) == sorted(p.code_name for p in whole[0].peptides)
