"""Near copies of the pipeline against all pairs."""

import random

import numpy as np
import xxhash

import corpus_pipeline
from spanforge.llm import near_copies
from spanforge.llm.simhash import fingerprint


def _shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _groups(texts, similarity=0.8):
    sets = list(map(_shingles, texts))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= similarity * max(len(a), len(sets[j])) and _jaccard(a, sets[j]) >= similarity:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def _scattered(rng, words, at_least):
    """Edits one word after the other until one more would be below ``at_least``."""
    base, best = _shingles(" ".join(words)), list(words)
    while True:
        new = list(best)
        new[rng.randrange(len(new))] = f"x{rng.random()}"
        if _jaccard(base, _shingles(" ".join(new))) < at_least:
            return best
        best = new


def test_pairs_are_found_down_to_the_limit(spark):
    rng = random.Random(3)
    texts = []
    for k in range(80):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 1000))]
        near = _scattered(rng, words, (0.8, 0.85, 0.9, 0.95)[k % 4])
        if k % 8 == 0:  # just outside the limit
            while _jaccard(_shingles(" ".join(words)), _shingles(" ".join(near))) >= 0.8:
                near[rng.randrange(len(near))] = "far"
        texts += [" ".join(words), " ".join(near)]
    want = sorted(set(_groups(texts)))
    assert len(want) == 90
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == want


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Chains and a large group whose copies are similar to their base but not to each other."""
    monkeypatch.setattr(near_copies, "DEALT", 8)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join(_scattered(rng, base, rng.choice([0.75, 0.8, 0.82]))) for _ in range(60)] + [" ".join(base)]
    step = [f"v{rng.randrange(500)}" for _ in range(150)]
    for _ in range(30):
        texts.append(" ".join(step))
        step = _scattered(rng, step, 0.8)
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", texts[0], texts[0].upper()] + [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = _groups(texts)
    got = {r.doc_id: r.component for r in near_copies.near_copies(frame).collect()}
    assert len(got) == len(texts) and len({(got[i], r) for i, r in enumerate(want)}) == len(set(got.values())) == len(set(want))
    assert sorted(r.doc_id for r in near_copies.keep_one(frame).collect()) == sorted(set(want))


def test_no_near_copies(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert near_copies.keep_one(frame).count() == 2 and near_copies.keep_one(frame.filter("doc_id > 2")).count() == 0


def test_texts_of_one_base_that_are_not_linked_make_no_pairs(spark, monkeypatch):
    """Each has its own changes to a common text and is far from all others: the bound on shared shingles leaves no pair."""
    made = []
    pairs = near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", lambda *a: made.append(pairs(*a).count()) or pairs(*a))
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = []
    for k in range(80):
        text = list(base)
        for at in rng.sample(range(400), 14):
            text[at] = f"x{k}-{at}"
        texts.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near_copies.keep_one(frame).count() == 80 == len(set(_groups(texts)))
    assert sum(made) == 0


def test_simhash_proposes_pairs_and_sets_decide(spark, monkeypatch):
    """With band keys that no two texts share, only texts with close fingerprints meet; of these, only similar ones are linked."""
    monkeypatch.setattr(near_copies, "band_keys", lambda found, times: np.array([xxhash.xxh64_intdigest(found.tobytes())], np.uint64))
    rng = random.Random(11)
    texts = []
    for k in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(800)]
        texts += [" ".join(words), " ".join([*words, f"x{k}"])]
    # five shingles, ever again, settle the fingerprint; most shingles of the set are others
    texts += [" ".join(["p q r s t"] * 200 + [f"y{rng.random()}" for _ in range(30)]) for _ in range(2)]
    prints = [fingerprint(t, 5) & (1 << 64) - 1 for t in texts]
    close = [k for k in range(0, len(texts), 2) if (prints[k] ^ prints[k + 1]).bit_count() <= 3]
    assert close[-1] == 40 and len(close) > 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert kept == sorted(set(range(42)) - {k + 1 for k in close[:-1]})
