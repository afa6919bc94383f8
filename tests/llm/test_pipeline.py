"""The pipeline stage by stage, and the registered queries of the subpackage."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spanforge.llm import components, queries
from workload.check import compare, sql_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert compare(df.columns, df.collect(), *sql_rows(sf_dir, queries.ORACLES[name])) is None


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaked = {r.doc_id for r in queries.op1_decontamination(spark, sf_dir).collect()}
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, sf_dir).filter("kept").collect()}
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        seen[name] = [r.doc_id for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == names
    assert sorted(seen["quality"]) == sorted(kept)
    assert set(seen["near_dedup"]) < kept and len(seen["near_dedup"]) == len(set(seen["near_dedup"]))
    assert sorted(seen["decontamination"]) == sorted(set(seen["near_dedup"]) - leaked) and set(seen["near_dedup"]) & leaked
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and sorted(seen["sharding"]) == sorted(seen["mixing"])


def test_stages_with_many_keys(spark, sf_dir, monkeypatch):
    """Key tables too large to broadcast: the joins that shuffle keep the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionAll(docs.filter("doc_id < 40"))
    stages = {name: stage for name, stage in corpus_pipeline.STAGES if name in ("near_dedup", "decontamination")}
    few = {name: sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) for name, stage in stages.items()}
    monkeypatch.setattr(components, "BROADCAST_KEYS", -1)
    many = {name: sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) for name, stage in stages.items()}
    assert many == few and len(few["near_dedup"]) == len(set(few["near_dedup"])) and len(few["decontamination"]) > len(set(few["decontamination"]))


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def _near_groups(texts):
    """Smallest index reachable over pairs whose five-word shingles have a Jaccard similarity of 0.8."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def _holds(text, item):
    """Whether some stretch of the text is within a fifth of the item's words of it, by the whole table of distances."""
    at, row = np.arange(len(text) + 1), np.zeros(len(text) + 1, int)
    for k, word in enumerate(item, 1):
        new = np.concatenate([[k], np.minimum(row[:-1] + (text != word), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return row.min() <= int(0.2 * len(item) + 1e-9)


def test_run_equals_brute_force(spark, sf_dir, tmp_path):
    """All rows of the whole pipeline: SQL for the rules and the mix, all pairs for near copies, all distances for leaks."""
    table = pq.read_table(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.to_pylist()}

    def judged(name, column, folder):
        columns, rows = sql_rows(str(folder), queries.ORACLES[name])
        return {r[columns.index("doc_id")]: r[columns.index(column)] for r in rows}

    good = judged("op3_quality_rules", "kept", sf_dir)
    left = sorted(i for i in docs if good[i])
    groups = _near_groups([docs[i]["text"] for i in left])
    left = [i for k, i in enumerate(left) if groups[k] == k]
    numbers: dict = {}
    split = lambda text: np.array([numbers.setdefault(w, len(numbers) + 1) for w in re.findall(r"[^\W_]+", (text or "").lower())], int)
    items = [i for i in (split(r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()) if len(i)]
    leaked = [i for i in left if any(_holds(split(docs[i]["text"]), item) for item in items)]
    left = [i for i in left if i not in set(leaked)]
    assert len(docs) > sum(good.values()) > len(left) + len(leaked) > len(left) > 50 and leaked

    pq.write_table(table.filter(np.isin(table["doc_id"].to_numpy(), left)), tmp_path / "documents.parquet")
    size, taken = (judged("op6_mixing", c, tmp_path) for c in ("size", "taken"))
    want = Counter({i: taken[i] // size[i] for i in left if taken[i]})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == want
    assert all(r[c] == docs[r.doc_id][c] for r in rows for c in table.column_names)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
