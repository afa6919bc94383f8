"""Model store, manifest prediction, packed windows, the resumable embedding job and the mask directory."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import blocks as B
from spanforge.operators import compare as C
from spanforge.operators import scoring as V
from spanforge.plans import embed as J
from spanforge.plans.predict import Predictor
from spanforge.sources import models as M

RNG = np.random.default_rng(4)
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def _embedding():
    """A function that tasks get by value, since they can't import this file."""
    def letters(batch):
        out = []
        for text in batch:
            if "WWW" in text:
                raise ValueError("no WWW please")
            codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(float)
            out.append(np.stack([codes / 90, np.arange(len(codes)) / 1000], axis=1))
        return out

    return letters


letters = _embedding()  # letter code and place in the window


def _dense(width):
    return {
        "blocks": [
            {"w": RNG.normal(size=(4, width)), "b": RNG.normal(size=4), "gain": RNG.normal(size=4), "shift": RNG.normal(size=4), "skip": {"w": RNG.normal(size=(4, width)), "b": RNG.normal(size=4)}},
            {"w": RNG.normal(size=(4, 4)), "b": RNG.normal(size=4), "skip": "same"},
            {"w": RNG.normal(size=(3, 4)), "b": RNG.normal(size=3)}],
        "w": RNG.normal(size=3), "b": 0.1}


def _conv(width, channels=2):
    conv = [{"w": RNG.normal(size=(3, width, 5)), "b": RNG.normal(size=3)}, {"w": RNG.normal(size=(channels, 3, 3)), "b": RNG.normal(size=channels)}]
    return {"conv": conv} | _dense(width + channels)


def _sequences(spark, lengths=(1, 30, 1022, 1023, 1101, 1110, 1900, 2000, 2801)):
    rng = np.random.default_rng(8)
    rows = [(i, f"h{i}", "".join(rng.choice(list(LETTERS), n)).replace("WWW", "WAW")) for i, n in enumerate(lengths)]
    return spark.createDataFrame([*rows, (90, "none", " 1-"), (91, "bad", "A" * 1500 + "WWW" + "C" * 900)], "id long, header string, sequence string")


@pytest.mark.parametrize("kind", ["dense", "conv"])
@pytest.mark.parametrize("feature", ["none", "inverse"])
@pytest.mark.parametrize("aggregation", ["majority", "mean-prob"])
def test_windows_vote_like_positions(spark, kind, feature, aggregation):
    """Masks and summaries of packed windows are those of position rows."""
    width = 2 + (feature != "none")
    heads = {"a": _dense(width), "b": _conv(width) if kind == "conv" else _dense(width), "c": _conv(width) if kind == "conv" else _dense(width)}
    if kind == "conv":
        heads["a"] = _conv(width)
    model = Predictor(letters, heads, {"a": .4, "b": .5, "c": .6}, aggregation=aggregation, length_feature=feature)
    rows = _sequences(spark)
    results, failures = model.predict(rows)
    got = {r["id"]: r for r in results.collect()}
    assert {r["id"] for r in failures.collect()} == {90, 91} and set(got) == set(range(9))
    scores, _ = model.score(rows.filter("id < 90"))
    want: dict = {}
    for r in scores.orderBy("id", "pos").collect():
        want.setdefault(r["id"], []).append(r["ps"])
    for i, ps in want.items():
        ps = np.array(ps)
        hits = (ps >= [.4, .5, .6]).sum(axis=1) >= 2 if aggregation == "majority" else ps.mean(axis=1) >= .5
        # vectors at a border are 32-bit in the strips: leave out what lies at the threshold
        sure = (np.abs(ps - [.4, .5, .6]).min(axis=1) > 1e-6) & (np.abs(ps.mean(axis=1) - .5) > 1e-6)
        mask = np.array([c == "1" for c in got[i]["binary_mask"]])
        assert len(mask) == len(hits) == got[i]["length"] and (mask == hits)[sure].all()
        assert got[i]["p_epitope_mean"] == pytest.approx(ps.mean(), abs=1e-6) and got[i]["p_epitope_max"] == pytest.approx(ps.mean(axis=1).max(), abs=1e-6)
        assert got[i]["n_epitopes"] == mask.sum() and got[i]["frac_epitope"] == pytest.approx(mask.mean())


def test_windows_reject_wide_kernels(spark):
    with pytest.raises(ValueError, match="reach"):
        B.finish_windows(_sequences(spark).select("id", "sequence"), letters, lambda: B.store, B.STORED, reach=300)


@pytest.fixture()
def store(spark, tmp_path):
    """A store of dense members and manifests of one and two sets."""
    models = {f"run_{i}": {"head": _dense(2), "threshold": t} for i, t in enumerate((.3, None, 1.5, .7))}
    M.write_models(spark, str(tmp_path / "store"), models)
    members = [{"status": "OK", "checkpoint": f"store/run_{i}", "fold_index": 4 - i, "member_index": i, "threshold": t} for i, t in enumerate((.6, None, None, 2.0))]
    (tmp_path / "one.json").write_text(json.dumps({"schema_version": 1, "set_index": 1, "members": members}, indent=1))
    two = {"schema_version": 2, "sets": [{"set_index": 1, "members": members[:1]}, {"set_index": 3, "members": [members[1] | {"status": "FAILED"}, members[3]]}]}
    (tmp_path / "two.json").write_text(json.dumps(two))
    (tmp_path / "gone.json").write_text(json.dumps({"schema_version": 1, "members": [members[0], members[0] | {"checkpoint": "store/run_9"}]}))
    return tmp_path, {name: m["head"] for name, m in models.items()}


def test_members_of_a_manifest(spark, store):
    folder, heads = store
    build = lambda name, **options: Predictor.from_artifact(spark, str(folder / name), letters, **options)
    # order by fold; override, else manifest, else checkpoint if it is a probability, else 0.5
    assert build("one.json").thresholds == {"run_3": .7, "run_2": .5, "run_1": .5, "run_0": .6}
    assert list(build("one.json").heads) == ["run_3", "run_2", "run_1", "run_0"]
    assert build("one.json", k_folds=2, threshold=.25).thresholds == {"run_3": .25, "run_2": .25}
    assert build("two.json").thresholds == {"run_0": .6} and build("two.json", set_index=3).thresholds == {"run_3": .7}
    assert build("store/run_0").thresholds == {"run_0": .3}
    for name, head in build("one.json").heads.items():
        x = RNG.normal(size=(7, 2))
        assert np.allclose(V.dense_forward(x, head), V.dense_forward(x, heads[name]))
    mean = build("one.json", aggregation="mean-prob")
    assert mean._mean_cut() == pytest.approx((.7 + .5 + .5 + .6) / 4)
    assert build("one.json", aggregation="mean-prob", threshold=.2)._mean_cut() == .2
    assert build("one.json", aggregation="mean-prob", threshold=.2, ensemble_threshold=.9)._mean_cut() == .9
    rows = _sequences(spark, (5, 12)).filter("id < 9")
    result = build("two.json").predict(rows)[0].first()
    assert (result["artifact_mode"], result["n_members"], result["threshold"], result["meta"]["set_index"]) == ("single-checkpoint", 1, .6, "1")
    with pytest.raises(FileNotFoundError, match="run_9"):
        build("gone.json")
    for bad in (dict(set_index=0), dict(threshold=1.0), dict(k_folds=0), dict(seq_len_feature="cube")):
        with pytest.raises(ValueError):
            build("one.json", **bad)
    with pytest.raises(Exception, match="k_folds=5"):
        build("one.json", k_folds=5)


def test_members_must_agree(spark, tmp_path):
    models = {"a": {"head": _dense(2)}, "b": {"head": _dense(3)}, "c": {"head": _dense(2), "seq_len_feature": "raw"}, "d": {"head": _conv(2)}}
    M.write_models(spark, str(tmp_path), models)
    load = lambda *names, **options: M.load_members(M.checkpoint_rows(spark, [f"{tmp_path}/{n}" for n in names]), **options)
    with pytest.raises(ValueError, match="length of their vectors"):
        load("a", "b")
    with pytest.raises(ValueError, match="seq_len_feature"):
        load("a", "c")
    assert [m.seq_len_feature for m in load("a", "c", seq_len_feature="none")] == ["none", "none"]
    with pytest.raises(ValueError, match="too many"):
        load("a", max_parameters=3)
    both = load("a", "d", "a")
    assert [m.name for m in both] == ["001-a", "002-d", "003-a"]
    x = RNG.normal(size=(9, 2))
    want = B.member_probabilities(x, [models["a"]["head"], models["d"]["head"]])
    assert np.allclose(B.member_probabilities(x, [M.head_of(m.tensors) for m in both[:2]]), want)


def test_runs_into_a_store(spark, tmp_path):
    runs = spark.createDataFrame([(1, [1.0, -2.0], .5, .25), (2, [0.0, 3.0], -1.0, .75)], "RunIndex int, weights array<double>, bias double, Threshold double")
    M.write_runs(runs, str(tmp_path))
    first, second = M.load_members(M.checkpoint_rows(spark, [f"{tmp_path}/run_001", f"{tmp_path}/run_002"]))
    assert (first.threshold, second.threshold) == (.25, .75)
    x = np.array([[1.0, 2.0]])
    assert V.dense_forward(x, M.head_of(first.tensors))[0] == -2.5 and V.dense_forward(x, M.head_of(second.tensors))[0] == 5.0


# --- embedding job ---------------------------------------------------------------------


def test_resumable_embedding(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def noted(batch):
        with open(seen, "a") as file:
            file.writelines(f"{t}\n" for t in batch)
        return letters(batch)

    def embedded():
        try:
            with open(seen) as file:
                return len(file.read().split())
        finally:
            open(seen, "w").close()

    rng = np.random.default_rng(2)
    text = {n: "".join(rng.choice(list(LETTERS), n)).replace("WWW", "WAW") for n in (5, 40, 1022, 1023, 2500)}
    rows = [("p1", "7", text[5]), ("p1", "7", text[5].lower()), ("p2", None, text[40]), ("p3", "8", text[1022]), ("p4", "9", "  "), ("p5", "9", "WWW")]
    frame = lambda rows: spark.createDataFrame(rows, "protein_id string, family string, sequence string").repartition(3)
    where = str(tmp_path / "store")
    failed = {r["id"]: r["error"] for r in J.embed_missing(frame(rows), noted, where, "one", feature="inverse", model="m").collect()}
    assert set(failed) == {"p4-9", "p5-9"} and "WWW" in failed["p5-9"]
    index = {r["id"]: r for r in J.read_index(spark, where).collect()}
    assert set(index) == {"p1-7", "p2", "p3-8"} and J.read_index(spark, where).columns == [c.split()[0] for c in J.INDEX.split(", ")]
    assert tuple(index["p3-8"]) == ("p3-8", "p3", "8", "id-family", "-", 1022, 3, 1022, "inverse", "short", "m", "parquet", f"{where}/blocks/run=one")
    assert embedded() >= 4

    # the same run again has nothing to do, but for what failed
    J.embed_missing(frame([r for r in rows if r[2] != "WWW"]), noted, where, "one", feature="inverse")
    assert embedded() == 0 and J.read_index(spark, where).count() == 3
    # a run that failed before its commit left blocks: readers do not see them, and it can start again
    stray = spark.read.parquet(f"{where}/blocks/run=one").withColumn("id", F.lit("p6-1"))
    stray.write.parquet(f"{where}/blocks/run=two")
    more = [*rows[:4], ("p6", "1", text[1023]), ("p7", "1", text[2500])]
    assert J.embed_missing(frame(more), noted, where, "two", feature="inverse").count() == 0
    assert embedded() == 2 + 3  # windows of the two new ones
    vectors: dict = {}
    for r in J.stored_vectors(J.stored_blocks(spark, where)).orderBy("id", "pos").collect():
        vectors.setdefault(r["id"], []).append(r["vec"])
    assert {k: len(v) for k, v in vectors.items()} == {"p1-7": 5, "p2": 40, "p3-8": 1022, "p6-1": 1023, "p7-1": 2500}
    whole = spark.createDataFrame([("x", text[2500])], "id string, sequence string")
    sizes = spark.createDataFrame([("x", 2500)], "id string, length long")
    want = V.stitch(V.embed_windows(whole, letters), sizes, feature="inverse").orderBy("pos").collect()
    assert np.allclose([r["vec"] for r in want], vectors["p7-1"], atol=1e-6)
    with pytest.raises(ValueError, match="committed already"):
        J.embed_missing(frame([("p8", "1", "ACD")]), noted, where, "two")
    with pytest.raises(ValueError, match="conflicting sequences"):
        J.embed_missing(frame([("p8", "1", "ACD"), ("p8", "1", "ACE")]), noted, where, "three")
    with pytest.raises(ValueError, match="another sequence"):
        J.embed_missing(frame([("p2", None, "ACD")]), noted, where, "three")
    assert J.stored_blocks(spark, str(tmp_path / "empty")).count() == 0


def test_key_modes(spark):
    rows = spark.createDataFrame([("p", "7", "acd"), ("q", None, "x1y")], "protein_id string, family string, sequence string")
    assert [tuple(r) for r in J.keyed_sequences(rows, "id").collect()] == [("p", "p", "7", "ACD"), ("q", "q", "", "XY")]
    assert [r["id"] for r in J.keyed_sequences(rows, delimiter="_").collect()] == ["p_7", "q"]
    with pytest.raises(ValueError):
        J.keyed_sequences(rows, "name")


# --- mask directory --------------------------------------------------------------------


def test_mask_directory(spark):
    rng = np.random.default_rng(6)
    masks = {f"p{n}": "".join(rng.choice(["0", "1"], n)) for n in (1, 255, 256, 257, 512, 5000)}
    table = spark.createDataFrame(list(masks.items()), "ProteinID string, mask string").repartition(2)
    peptides, want = [], {}
    for name, mask in masks.items():
        for k in range(40):
            a, b = sorted(rng.choice(len(mask) + 1, 2, replace=False).tolist())
            a, b = [(0, len(mask)), (a, b)][k > 0]
            peptides.append((len(peptides), f"c{len(peptides)}", name, a, b, k % 2, 0))
            want[f"c{len(peptides) - 1}"] = mask[a:b].count("1")
    peptides.append((len(peptides), "lost", "p0", 0, 1, 0, 0))
    rows = spark.createDataFrame(peptides, "row_id long, CodeName string, ProteinID string, AlignStart int, AlignStop int, `Def epitope` int, `Not epitope` int")
    compared = C.compare_peptides(rows, table)
    assert {r["CodeName"]: r["PredOnes"] for r in compared.collect()} == want
    directory = C.mask_directory(table)
    assert directory.agg(F.max(F.length("bits"))).first()[0] == C.MASK_CHUNK
    with pytest.raises(Exception, match="no comparable rows"):
        C.comparison_summary(compared.filter("CodeName = 'x'")).collect()


def test_stretches_are_finished_together():
    """One call of the heads serves many stretches, in the rows of one call each."""
    calls = []
    stretches = [(RNG.normal(size=(n, 2)), slice(a, b)) for n, a, b in ((9, 0, 9), (1, 0, 1), (30, 4, 20), (5, 5 - 2, 5))]
    for heads in ([_dense(2), _dense(2)], [_conv(2), _dense(2)]):
        vote = B.voter(heads, B.Rule((.4, .6)))
        want = [vote([s])[0] for s in stretches]
        out: list = []
        pending = B._Pending(lambda s: calls.append(len(s)) or vote(s), out)
        for i, (x, take) in enumerate(stretches):
            pending.add({"id": i}, x, take)
        pending.flush()
        pending.flush()
        assert [r["id"] for r in out] == [0, 1, 2, 3] and [len(r["bits"]) for r in out] == [9, 1, 16, 2]
        for r, w in zip(out, want):
            assert (r["bits"], r["ones"]) == (w["bits"], w["ones"]) and r["p_sum"] == pytest.approx(w["p_sum"]) and r["p_max"] == pytest.approx(w["p_max"])
    assert calls == [4, 4]
