"""What the embedding job writes and shuffles, and that its rows do not depend on it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import scoring as V
from spanforge.plans import embed as J

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def _embedding():
    """A function that tasks get by value, since they can't import this file."""
    def letters(batch):
        out = []
        for text in batch:
            if "WWW" in text:
                raise ValueError("no WWW please")
            codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(float)
            out.append(np.stack([codes, np.arange(len(codes), dtype=float)], axis=1))
        return out

    return letters


letters = _embedding()


def _text(rng, n):
    return "".join(rng.choice(list(LETTERS), n)).replace("WWW", "WAW")


def _records(spark, rows):
    return spark.createDataFrame(rows, "protein_id string, family string, sequence string").repartition(3)


def _files(folder):
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planes_are_exact():
    x = np.array([[1.5, -0.0, np.nan], [np.inf, 3e-40, -7.25]], dtype="<f4")
    assert V.unpack_planes(V.pack_planes(x), 3).tobytes() == x.tobytes()
    assert V.unpack_planes(V.pack_planes(x[:1]), 3).tobytes() == x[:1].tobytes()


def test_a_run_writes_little(spark, tmp_path):
    """Neither texts nor vectors are written several times, and vectors are packed: under two bytes a letter in all."""
    rng = np.random.default_rng(5)
    rows = [(f"p{i}", "1", _text(rng, 20_000)) for i in range(20)]
    shared = spark.conf.get("spark.checkpoint.dir")
    before = _files(shared)
    for run, some in (("one", rows[:7]), ("two", rows)):
        assert J.embed_missing(_records(spark, some), letters, f"{tmp_path}/store", run, feature="raw").count() == 0
    written = sum(n for f, n in _files(shared).items() if f not in before) + sum(_files(tmp_path).values())
    assert J.stored_vectors(J.stored_blocks(spark, f"{tmp_path}/store")).count() == 20 * 20_000
    assert written < 2 * 20 * 20_000


@pytest.mark.parametrize("bound", [J.BROADCAST_KEYS, 0])
def test_rows_of_few_and_of_many_keys(spark, tmp_path, monkeypatch, bound):
    """Repeated records, stored keys, a text that fails in one of its windows and is mended later."""
    monkeypatch.setattr(J, "BROADCAST_KEYS", bound)
    rng = np.random.default_rng(6)
    text = {n: _text(rng, n) for n in (3, 1022, 1023, 2500, 5000)}
    bad = text[5000][:2000] + "WWW" + text[5000][2003:]  # in the third window of six alone
    store = f"{tmp_path}/store"
    first = [("a", "1", text[3]), ("b", "2", text[2500]), ("b", "2", text[2500].lower() + "!"), ("c", "3", bad), (None, "3", text[3])]
    failed = J.embed_missing(_records(spark, first), letters, store, "one", feature="raw").collect()
    assert [(r["id"], r["error"]) for r in failed] == [("c-3", "no WWW please")]
    second = [("a", "1", text[3]), ("b", "2", text[2500]), ("d", "4", text[1023]), ("e", "5", text[1022])]
    assert J.embed_missing(_records(spark, second), letters, store, "two", feature="raw").count() == 0
    want = {"a-1": text[3], "b-2": text[2500], "d-4": text[1023], "e-5": text[1022]}
    for mended in (False, True):
        if mended:  # blocks of its other windows lie in the first run's folder
            want["c-3"] = text[5000]
            assert J.embed_missing(_records(spark, [*second, ("c", "3", text[5000])]), letters, store, "three", feature="raw").count() == 0
        assert {r["id"]: r["length"] for r in J.read_index(spark, store).collect()} == {k: len(t) for k, t in want.items()}
        assert J.read_index(spark, store).count() == len(want)
        got: dict = {}
        for r in J.stored_vectors(J.stored_blocks(spark, store)).orderBy("id", "pos").collect():
            got.setdefault(r["id"], []).append((r["pos"], *r["vec"]))
        whole = spark.createDataFrame(list(want.items()), "id string, sequence string")
        sizes = whole.select("id", F.length("sequence").cast("bigint").alias("length"))
        expected: dict = {}
        for r in V.stitch(V.embed_windows(whole, letters), sizes, feature="raw").orderBy("id", "pos").collect():
            expected.setdefault(r["id"], []).append((r["pos"], *r["vec"]))
        assert got == expected


def test_texts_are_exchanged_once_and_blocks_not(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/store"
    rows = _records(spark, [("a", "1", "ACDA" * 900), ("b", "2", "CCA")])
    J.embed_missing(rows, letters, store, "one")
    plan = _plan(J.stored_blocks(spark, store))
    assert "Join" not in plan and "Exchange" not in plan
    # what stands between the records and the embedding, without a broadcast by size
    monkeypatch.setattr(J, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = J.keyed_sequences(spark.read.parquet(_written(rows, tmp_path)))
        texts, keep = J.wanted(keyed.select("id", "sequence"), J.cut_lineage(J.key_table(keyed)))
        plan = _plan(V.window_texts(texts, keep=keep))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_COL" not in plan  # windows, and places of windows
    assert plan.count("regexp_replace") == 1


def _written(rows, folder):
    rows.write.parquet(f"{folder}/records")
    return f"{folder}/records"


def test_failures_outlive_a_restart(spark, tmp_path):
    """A run of which nothing was committed may be started again; its failures stay readable."""
    store = f"{tmp_path}/store"
    failed = J.embed_missing(_records(spark, [("a", "1", "AWWWA")]), letters, store, "one")
    assert J.embed_missing(_records(spark, [("a", "1", "AWWA")]), letters, store, "one").count() == 0
    assert [r["id"] for r in failed.collect()] == ["a-1"] and J.read_index(spark, store).count() == 1


def test_an_older_layout_is_not_misread(spark, tmp_path):
    store = f"{tmp_path}/store"
    J.embed_missing(_records(spark, [("a", "1", "ACD")]), letters, store, "one")
    path = f"{store}/blocks/run=one"
    spark.createDataFrame([("a-1", 0, 3, 2, bytearray(24))], "id string, start bigint, n bigint, dim int, block binary").write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="older layout"):
        J.stored_vectors(J.stored_blocks(spark, store)).collect()
