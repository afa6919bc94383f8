"""Members, votes, scoring, prediction, training, analysis and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import compare as C
from spanforge.operators import ensemble as E
from spanforge.operators import paired as P
from spanforge.operators import scoring as V
from spanforge.operators import splits as S
from spanforge.plans.analyse import analyse
from spanforge.plans.evaluate import best_set, evaluate_ensemble
from spanforge.plans.predict import Predictor, mask_records
from spanforge.operators import fits as L
from spanforge.plans.train import cross_validate, drawn_trials, ensemble_manifest, plan_models, sweep, training_table
from spanforge.streaming.predict_stream import predict_new_files
from workload.vector_queries import letter_codes, predictor


def votes(spark, logits, thresholds, **kw):
    rows = [("s", i, str(m), 1 / (1 + np.exp(-z))) for m, zs in enumerate(logits, start=1) for i, z in enumerate(zs)]
    table = spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "id string, pos long, member string, p double")
    limits = {str(m): t for m, t in enumerate(thresholds, start=1)}
    out = E.vote(table, limits, **kw)
    wide = table.groupBy("id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "p"))), lambda s: s["p"]).alias("ps"))
    assert E.prediction_payload(E.vote_wide(wide, limits, **kw)).first()["binary_mask"] == E.prediction_payload(out).first()["binary_mask"]
    return E.prediction_payload(out).first()["binary_mask"]


def test_votes(spark):
    three = [[2, 2, -2, -2], [2, -2, 2, -2], [-2, 2, 2, -2]]
    assert votes(spark, three, [.5] * 3) == "1110" and E.votes_needed(3) == 2
    assert votes(spark, [[2, -2], [-2, 2]], [.5] * 2) == "00"
    assert votes(spark, [[2, -2], [-2, 2]], [.5] * 2, aggregation="mean-prob", ensemble_threshold=.49) == "11"
    assert votes(spark, [[2, -2, 2]], [.5]) == "101"
    with pytest.raises(ValueError):
        votes(spark, three, [.5, .5, 1.0])
    with pytest.raises(ValueError):
        votes(spark, three, [.5] * 3, aggregation="median")


def test_manifest(spark, tmp_path):
    members = [
        {"status": "OK", "checkpoint": "b.pt", "fold_index": 2, "member_index": 2, "threshold": 0.7},
        {"status": " ok ", "checkpoint": "/abs/a.pt", "fold_index": 1, "member_index": 1, "threshold": "bad"},
        {"status": "FAIL", "checkpoint": "c.pt", "fold_index": 3}, {"status": "OK", "fold_index": 4}, "text", 3,
    ]
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"schema_version": 1, "members": members}, indent=2))
    rows = E.read_members(spark, str(one)).orderBy("member").collect()
    assert [(r["fold_index"], r["threshold"]) for r in rows] == [(1, None), (2, .7)]
    assert rows[0]["checkpoint"] == "/abs/a.pt" and rows[1]["checkpoint"].endswith(f"{tmp_path}/b.pt")
    assert E.read_members(spark, str(one), k_folds=1).count() == 1
    with pytest.raises(Exception, match="exceeds"):
        E.read_members(spark, str(one), k_folds=3).collect()
    two = tmp_path / "two.json"
    two.write_text(json.dumps({"schema_version": 2, "sets": [
        "junk", {"set_index": "1", "members": members},
        {"set_index": "2", "members": [{"status": "OK", "checkpoint": "z.pt", "threshold": .55}]}]}))
    assert [r["threshold"] for r in E.read_members(spark, str(two), set_index=2).collect()] == [.55]
    with pytest.raises(ValueError, match="no usable"):
        E.read_members(spark, str(two), set_index=3)


def test_best_set_and_fold(spark):
    rows = [(1, .20, 1.2), (1, .30, 1.1), (2, .41, .9), (2, .39, 1.0), (3, .31, 1.3), (3, .30, 1.4)]
    runs = spark.createDataFrame([(a, b, c, "OK") for a, b, c in rows] + [(4, .99, .1, "FAIL")],
                                 "EnsembleSetIndex int, PR_AUC double, BestValLoss double, Status string")
    row = best_set(runs, "pr-auc").first()
    assert (row["set_index"], row["aggregate_metric"], row["direction"]) == (2, pytest.approx(.40), "max")
    row = best_set(runs, "best_val_loss").first()
    assert (row["set_index"], row["aggregate_metric"], row["direction"]) == (2, pytest.approx(.95), "min")
    folds = spark.createDataFrame([(1, .71), (2, .79), (3, .75)], "fold_index int, auc double")
    assert E.rank_folds(folds, "auc").filter("rank = 1").first()["fold_index"] == 2
    with pytest.raises(ValueError, match="not found"):
        best_set(runs, "nope")


def test_packed_batches():
    assert V.packed_batches([3, 3, 9], 10) == [0, 0, 1]
    assert V.packed_batches([5000, 1, 1], 1022) == [0, 1, 1]


def test_overlap_average_of_equal_vectors(spark):
    seqs = spark.createDataFrame([("long", "A" * 55), ("short", "AC")], "id string, sequence string")
    ones = lambda batch: [np.ones((len(t), 2)) for t in batch]
    for window, stride in ((20, 15), (20, 6)):
        pieces = V.embed_windows(seqs, ones, max_tokens=20, window=window, stride=stride)
        rows = V.stitch(pieces, window=window, stride=stride).collect()
        assert len(rows) == 57 and all(r["vec"] == [1.0, 1.0] for r in rows)
        assert len({(r["id"], r["pos"]) for r in rows}) == 57


@pytest.mark.parametrize("window,stride", [(20, 15), (20, 6), (7, 7)])
def test_overlap_average_against_loop(spark, window, stride):
    text = "".join(chr(65 + i % 25) for i in range(83))
    want, count = np.zeros((83, 2)), np.zeros(83)
    start = 0
    while True:
        stop = min(start + window, 83)
        want[start:stop] += letter_codes([text[start:stop]])[0]
        count[start:stop] += 1
        if stop == 83:
            break
        start += stride
    seqs = spark.createDataFrame([("x", text)], "id string, sequence string")
    pieces = V.embed_windows(seqs, letter_codes, max_tokens=window, window=window, stride=stride)
    rows = V.stitch(pieces, window=window, stride=stride).orderBy("pos").collect()
    assert np.allclose([r["vec"] for r in rows], want / count[:, None])


def test_failing_sequences_are_rows(spark):
    def picky(batch):
        if any("W" in t for t in batch):
            raise RuntimeError("no W")
        return letter_codes(batch)

    model = Predictor(picky, {"a": {"blocks": [], "w": [1.0, 0.0], "b": -77.5}}, {"a": 0.5})
    results, failures = model.predict_sequences(spark, {"one": "acW", "two": "AZ", "three": "--"})
    assert [(r["header"], r["binary_mask"], r["votes_needed"]) for r in results.collect()] == [("two", "01", None)]
    assert {r["id"]: r["error"] for r in failures.collect()} == {1: "no W", 3: "empty after cleaning"}


def test_predict_fasta_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fasta").write_text(">p1\nAZ\nNA\n>p2 x\nMMM\n")
    results, _ = predictor().predict_fasta(spark, str(folder))
    rows = {r["header"]: r for r in results.collect()}
    assert rows["p1"]["binary_mask"] == "0110" and rows["p2 x"]["binary_mask"] == "000"
    assert rows["p1"]["n_members"] == 3 and rows["p1"]["votes_needed"] == 2 and rows["p1"]["threshold"] is None
    assert {r[0] for r in mask_records(results).collect()} == {">p1\n0110", ">p2 x\n000"}
    query = predict_new_files(spark, predictor(), str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert {r["header"]: r["binary_mask"] for r in streamed.collect()} == {"p1": "0110", "p2 x": "000"}


def test_conv_block_size_does_not_matter(spark):
    rng = np.random.default_rng(0)
    conv = [{"w": rng.normal(size=(3, 2, 5)).tolist(), "b": rng.normal(size=3).tolist()},
            {"w": rng.normal(size=(3, 3, 3)).tolist(), "b": rng.normal(size=3).tolist()}]
    head = {"conv": conv, "blocks": [{"w": rng.normal(size=(4, 5)).tolist(), "b": [0.1] * 4, "skip": {"w": rng.normal(size=(4, 5)).tolist(), "b": [0.0] * 4}}],
            "w": rng.normal(size=4).tolist(), "b": .2}
    x = rng.normal(size=(37, 2))
    vectors = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "id string, pos long, vec array<double>")
    local = V.conv_features(x, conv, np.ones(37))
    want = V.sigmoid_of(V.dense_forward(np.concatenate([x, local], axis=1), head))
    for block in (4, 10, 64):
        rows = V.score_conv(vectors, {"m": head}, block=block).orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(37)) and np.allclose([r["p"] for r in rows], want)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_conv_across_range_borders(spark, partitions):
    """Ranges that cut sequences anywhere, also shorter than the kernels' reach, change no score."""
    rng = np.random.default_rng(partitions)
    conv = [{"w": rng.normal(size=(3, 2, 5)), "b": rng.normal(size=3)}, {"w": rng.normal(size=(2, 3, 3)), "b": rng.normal(size=2)}]
    heads = {"m": {"conv": conv, "blocks": [], "w": rng.normal(size=4), "b": .2}, "n": {"conv": conv[:1], "blocks": [], "w": rng.normal(size=5), "b": -.1}}
    xs = {i: rng.normal(size=(n, 2)) for i, n in enumerate((1, 2, 5, 90, 3, 40, 6, 7, 130, 1))}
    rows = [(i, p, v.tolist()) for i, x in xs.items() for p, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "id int, pos long, vec array<double>").repartition(3)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {(r["id"], r["pos"]): r["ps"] for r in V.score_members_conv(vectors, heads, block=8).collect()}
        count = V.score_members_conv(vectors, heads, block=8).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert count == len(got) == len(rows)
    for i, x in xs.items():
        want = [V.sigmoid_of(V.dense_forward(np.concatenate([x, V.conv_features(x, h["conv"], np.ones(len(x)))], axis=1), h)) for h in heads.values()]
        assert np.allclose([got[i, p] for p in range(len(x))], np.stack(want, axis=1))


def test_evaluate_ensemble(spark):
    rng = np.random.default_rng(1)
    rows = [("s", i, str(m), int(i % 3 == 0), float(np.clip(.3 * (i % 3 == 0) + .6 * rng.random(), 0, 1))) for i in range(90) for m in (1, 2, 3)]
    scores = spark.createDataFrame(rows, "id string, pos long, member string, y int, p double")
    support = spark.createDataFrame([(90,), (0,)], "valid_residues long")
    out = evaluate_ensemble(scores, support, {"1": .5, "2": .5, "3": .5}, max_points=10)
    results = {r["member"]: r for r in out.results.collect()}
    assert set(results) == {"ensemble", "1", "2", "3"} and results["ensemble"]["votes_needed"] == 2
    assert out.grid.count() == 44 and out.counters.first()["proteins_zero_valid_residues"] == 1
    assert out.curves.groupBy("member", "curve").count().filter("count > 10").count() == 0
    best = out.best_fold.filter("rank = 1").first()
    assert best["metric_value"] == max(results[m]["pr_auc"] for m in "123")


def test_train_to_predict(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) + (i % 4 == 0) * 2).tolist(), int(i % 4 == 0)) for i in range(120)]
    examples = spark.createDataFrame(rows, "id long, features array<double>, y int")
    plan = S.fold_plan(examples.select("id"), None, n_folds=2, split_seeds=[1, 2], train_seeds=[1, 2])
    runs, scored = cross_validate(examples, plan)
    table = runs.collect()
    assert len(table) == 4 and all(r["Status"] == "OK" and r["AUC"] > .8 for r in table) and scored.count() == 240
    document = ensemble_manifest(runs, n_folds=2, policy="best-f1", metric="pr_auc").first()["value"]
    path = tmp_path / "ensemble_manifest.json"
    path.write_text(document)
    members = E.read_members(spark, str(path), set_index=2).collect()
    assert [m["member_index"] for m in members] == [3, 4]
    heads = {str(r["RunIndex"]): {"blocks": [], "w": r["weights"], "b": r["bias"]} for r in table}
    vectors = examples.select(F.lit("s").alias("id"), F.col("id").alias("pos"), F.col("features").alias("vec"))
    voted = E.vote_wide(V.score_members(vectors, heads), {k: .5 for k in heads})
    agree = voted.join(examples.select(F.col("id").alias("pos"), "y"), "pos").agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]
    assert agree > .8


def test_bootstrap_edges(spark):
    diffs = spark.createDataFrame([("one", 1, .25), ("many", 1, .1), ("many", 2, .3), ("many", 3, -.2), ("many", 4, .4)],
                                  "metric string, set_index int, diff double")
    got = {r["metric"]: (r["ci_low"], r["ci_high"]) for r in P.bootstrap_interval(diffs, n_bootstrap=4000).collect()}
    assert got["one"] == (.25, .25)
    rng = np.random.default_rng(0)
    values = np.array([.1, .3, -.2, .4])
    draws = values[rng.integers(0, 4, (20000, 4))].mean(axis=1)
    assert got["many"] == pytest.approx(tuple(np.quantile(draws, [.025, .975])), abs=.03)


def test_analyse_documents(spark, tmp_path):
    def put(path, value):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(value, indent=2))

    for model, shift in (("m1", 0.0), ("m2", 0.1)):
        for k in (1, 2, 3):
            if (model, k) == ("m2", 3):
                continue
            metrics = {"support_pos": 10, "support_neg": 90, "auc": .6 + shift, "pr_auc": .2 + shift, "f1": float("nan")}
            folds = [{"fold_index": f, "metrics": metrics} for f in (1, 2)]
            put(tmp_path / model / f"set_{k:02d}" / "combined/eval.json",
                {"n_members": 2, "evaluation": {"metrics": metrics, "best_fold": folds[0], "folds": folds}})
            if (model, k) != ("m1", 2):
                put(tmp_path / model / f"set_{k:02d}" / "combined/compare.json",
                    {"n_rows_compared": 5, "confusion_peptide_any_positive": {"tp": 1, "fp": 1, "tn": 2, "fn": 1, "precision": .5, "recall": .5}})
    out = analyse(spark, str(tmp_path), ["m1", "m2"], evaluation_file="combined/eval.json",
                  comparison_file="combined/compare.json", first=1, last=3, n_bootstrap=200)
    assert out["seed_metrics"].count() == 5 and out["fold_metrics"].count() == 10
    assert {(r["model"], r["set_index"], r["missing"]) for r in out["warnings"].collect()} == {("m2", 3, "evaluation"), ("m1", 2, "comparison")}
    stats = {r["metric"]: r for r in out["paired_stats"].collect()}
    assert stats["overall_auc"]["n_pairs"] == 2 and stats["overall_auc"]["mean_diff_b_minus_a"] == pytest.approx(.1)
    assert stats["overall_auc"]["sign_test_pvalue"] == .5 and stats["peptide_f1"]["n_pairs"] == 1


def test_comparison_rejects_bad_rows(spark):
    schema = "row_id long, CodeName string, ProteinID string, AlignStart int, AlignStop int, `Def epitope` int, `Not epitope` int"
    masks = spark.createDataFrame([("p", "0110")], "ProteinID string, mask string")
    good = C.compare_peptides(spark.createDataFrame([(1, "c", "p", 1, 4, 1, 0)], schema), masks).first()
    assert (good["PredOnes"], good["PredZeros"], good["DeltaPredMinusExpected"], good["ExactMatch"]) == (2, 1, -1, 0)
    for row in ((1, "c", "p", 1, 5, 1, 0), (1, "c", "p", 1, 3, 1, 1)):
        with pytest.raises(Exception, match="invalid bounds or label"):
            C.compare_peptides(spark.createDataFrame([row], schema), masks).collect()
    bad = spark.createDataFrame([("h", "01x", 1)], "header string, sequence string, source_order int")
    with pytest.raises(Exception, match="non-binary"):
        C.masks_by_id(bad).collect()


@pytest.mark.parametrize("rows", [[("s", 0, "a", .5)], [("s", 0, "a", .5), ("s", 0, "b", .5), ("s", 0, "b", .5)]])
def test_vote_needs_each_member_once(spark, rows):
    table = spark.createDataFrame(rows, "id string, pos long, member string, p double")
    with pytest.raises(Exception, match="members do not vote once each at s:0"):
        E.vote(table, {"a": .5, "b": .5}).collect()


def test_fits_equal_single_ones(spark):
    """Models fitted together are those that Spark's own fit finds one by one, for folds and for a holdout."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=3) * [1, 5, .1]).tolist(), int(rng.random() < .25)) for i in range(300)]
    examples = spark.createDataFrame(rows, "id long, features array<double>, y int").repartition(5)
    for options in (dict(n_folds=3, split_seeds=[4, 5], train_seeds=[1, 2]), dict(n_folds=1, val_frac=.3)):
        plan = S.fold_plan(examples.select("id"), None, **options)
        table = training_table(examples, plan)
        models = plan_models(plan, penalty=0.0) + plan_models(plan, penalty=.1, first=50)
        fits, weights = L.fit_all(table, models)
        assert all(f.converged for f in fits)
        scored = {(r["model"], r["id"]): r["p"] for r in L.score_held_out(table, models, fits).collect()}
        runs = plan.runs().collect()
        for model, fit, weight in list(zip(models, fits, weights))[::3]:
            side = {r["id"]: r["role"] for r in runs if r["run_index"] == (model.name - 1) % 50 + 1}
            train = [r for r in rows if side[r[0]] == "train"]
            pos = sum(r[2] for r in train)
            assert weight == pytest.approx((len(train) - pos) / pos)
            frame = spark.createDataFrame([(r[1], r[2], float(weight) if r[2] else 1.0) for r in train], "x array<double>, label int, w double")
            own = LogisticRegression(weightCol="w", regParam=model.penalty, maxIter=200, tol=1e-12).fit(frame.select(array_to_vector("x").alias("features"), "label", "w"))
            near = 1e-5 if model.penalty == 0 else 5e-3  # Spark takes the spread of a sample
            assert np.allclose(own.coefficients.toArray(), fit.weights, rtol=near, atol=near) and own.intercept == pytest.approx(fit.bias, abs=near)
            held = [r for r in rows if side[r[0]] == "validation"]
            assert {i for m, i in scored if m == model.name} == {r[0] for r in held}
            assert all(scored[model.name, r[0]] == pytest.approx(1 / (1 + np.exp(-(np.dot(r[1], fit.weights) + fit.bias)))) for r in held)
    with pytest.raises(ValueError, match="nothing to fit"):
        L.fit_all(table.limit(0), models)
    with pytest.raises(ValueError, match="unknown parameters"):
        cross_validate(examples, plan, params={"elasticNetParam": .5})


def test_separable_rows_stop(spark):
    """Without a penalty separable classes have no finite fit: the iterations end, the order is right."""
    examples = spark.createDataFrame([(i, [float(i)], int(i >= 20)) for i in range(40)], "id long, features array<double>, y int")
    plan = S.fold_plan(examples.select("id"), None, n_folds=2)
    runs, scored = cross_validate(examples, plan, params={"regParam": 0.0, "maxIter": 15})
    assert [(r["AUC"], r["BestEpoch"]) for r in runs.collect()] == [(1.0, 15)] * 2 and scored.filter("isnan(p)").count() == 0


def test_holdout_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    examples = spark.createDataFrame([(i, rng.normal(size=2).tolist(), i % 3 == 0 and 1 or 0) for i in range(60)], "id long, features array<double>, y int")
    plan = S.fold_plan(examples.select("id"), None, n_folds=1, val_frac=.25, split_seeds=[4, 9], train_seeds=[1, 2])
    rows = cross_validate(examples, plan, policy="fixed", fixed_threshold=.4, save_path=str(tmp_path))[0].orderBy("RunIndex").collect()
    assert [(r["RunIndex"], r["TrainMode"], r["FoldIndex"], r["EnsembleSetIndex"], r["SplitSeed"], r["TrainSeed"], r["ValProteins"], r["TrainProteins"]) for r in rows] == [
        (1, "seeded", None, None, 4, 1, 15, 45), (2, "seeded", None, None, 9, 2, 15, 45)]
    assert {(r["Threshold"], r["ThresholdFixedValue"], r["ThresholdMinRecall"], r["CheckpointPath"]) for r in rows} == {
        (.4, .4, None, f"{tmp_path}/run_00{k}") for k in (1, 2)}


def test_sweep(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) + (i % 4 == 0) * 2).tolist(), int(i % 4 == 0)) for i in range(120)]
    examples = spark.createDataFrame(rows, "id long, features array<double>, y int")
    plan = S.fold_plan(examples.select("id"), None, n_folds=2)
    trials, best = sweep(examples, plan, {"regParam": [0.001, 10.0], "maxIter": [20, 30]})
    rows = trials.orderBy("trial").collect()
    assert [json.loads(r["params"]) for r in rows] == [{"regParam": a, "maxIter": b} for a in (.001, 10.0) for b in (20, 30)]
    single = cross_validate(examples, plan, params={"regParam": .001})[0].agg(F.avg("PR_AUC")).first()[0]
    assert rows[0]["score"] == pytest.approx(single) and best.first()["trial"] in range(4)
    halved = sweep(examples, plan, {"regParam": ("log", 1e-4, 1e2), "maxIter": [25]}, n_trials=9, rungs=(2, 5, 20))[0].collect()
    assert sorted((r["rung"], r["state"]) for r in halved) == [(1, "PRUNED")] * 6 + [(2, "PRUNED")] * 2 + [(3, "COMPLETE")]
    assert drawn_trials({"a": ("uniform", 2, 3), "b": [1, 2]}, 5, 7) == drawn_trials({"a": ("uniform", 2, 3), "b": [1, 2]}, 5, 7)
    assert all(2 <= t["a"] < 3 for t in drawn_trials({"a": ("uniform", 2, 3)}, 50, 1))
    for bad in (dict(rungs=(5, 5)), dict(rungs=())):
        with pytest.raises(ValueError):
            sweep(examples, plan, {"regParam": [.1]}, **bad)
    with pytest.raises(ValueError, match="number of trials"):
        sweep(examples, plan, {"regParam": ("log", .1, 1)})


def test_windows_travel_packed(spark):
    """Texts are cleaned once, dealt without sampling, and a window is a few rows, not one per position."""
    texts = {"a": "ACDEF" * 500, "b": "A" * 1022, "c": "", "d": "C" * 1023, "e": "ÄÖ" * 700, "f": None}
    seqs = spark.createDataFrame(list(texts.items()), "id string, sequence string")
    cleaned = seqs.select("id", F.regexp_replace("sequence", "-", "").alias("sequence"))
    plan = V.window_texts(cleaned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert "rangepartitioning" not in V.window_texts(cleaned)._jdf.queryExecution().executedPlan().toString()
    cut = {(r["id"], r["start"]): r["sequence"] for r in V.window_texts(cleaned).collect()}
    assert cut == {(i, at): t[at:at + (1000 if len(t) > 1022 else 1022)] for i, t in texts.items() if t
                   for at in ([0] if len(t) <= 1022 else range(0, len(t) - 100, 900))}
    codes = lambda batch: [np.stack([[float(ord(c)) for c in t], np.arange(len(t))], axis=1) for t in batch]
    pieces = V.embed_windows(seqs, codes)
    assert pieces.count() == sum(1 if len(t) <= 1022 else 1 + 3 * ((len(t) - 1000 + 899) // 900) for t in texts.values() if t)
    totals = V.block_totals(V.stitch_blocks(pieces)).groupBy("id").agg(
        F.sum("n").alias("n"), F.sum(F.col("total")[1]).alias("places"), F.max_by(F.col("last")[1], "start").alias("end")).collect()
    rows: dict = {}
    for r in V.stitch(pieces).orderBy("id", "pos").collect():
        rows.setdefault(r["id"], []).append(r["vec"][1])
    assert {r["id"]: (r["n"], r["places"], r["end"]) for r in totals} == {i: (len(v), sum(v), v[-1]) for i, v in rows.items()}
    assert {i: len(v) for i, v in rows.items()} == {i: len(t) for i, t in texts.items() if t}
    with pytest.raises(ValueError, match="half"):
        V.stitch_blocks(pieces, window=20, stride=6)
