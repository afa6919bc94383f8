"""The ten operators against brute force, and their edge cases."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import (
    byte_dedup, chat_format, decontaminate, mixing, quality_rules, queries, sharding, simhash, url_filter, warc, word_dedup,
)
from spanforge.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the long text of many words " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, tied and repeated rows, with clashing column names."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (4, LONG, "b"), (4, "same id, other text " * 30, "b"),
        (None, "no id " * 60, None), (None, None, None), (7, "é ü \x85 \xa0 nbsp" * 30, "c"),
    ]
    clash = "size long, shard int, slot long, kept boolean, dedup string, mix string, component_id long, n_words long, digest string, verdict string"
    return spark.createDataFrame(
        [(i, t, "en", s, None) + (0, 0, 0, False, "x", "x", 0, 0, "x", "x") for i, t, s in rows], f"{DOC}, {clash}").repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.filter("doc_id = -1")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- repeated substrings ---------------------------------------------------------------


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        for top in (2, 3, 9):
            t = rng.integers(1, top, n)
            assert byte_dedup.suffix_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def _texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(300)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(n):
        body = rng.choices(vocabulary, k=rng.randint(0, 150))
        if rng.random() < 0.4:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 10) : rng.randint(40, 60)]
        out.append(rng.choice([" ", "  ", "\n"]).join(body))
    return out + out[:4] + [None, "", "aa " * 300, "x" * 900]


def _covered(items, window, seen):
    flags = [False] * len(items)
    for i in range(len(items) - window + 1):
        if seen[tuple(items[i : i + window])] > 1:
            flags[i : i + window] = [True] * window
    return flags


@pytest.mark.parametrize("bucket_bytes", [2_000, 24 << 20])
def test_repeated_words(spark, bucket_bytes):
    texts = _texts(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = {i: _words(t) for i, t in enumerate(texts)}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in word_dedup.drop_repeated_words(docs, bucket_bytes=bucket_bytes).select("doc_id", "dedup.*").collect()}
    for i, w in split.items():
        flags = _covered(w, 35, seen)
        assert got[i] == (len(w), sum(flags), " ".join(x for x, f in zip(w, flags) if not f))


@pytest.mark.parametrize("bucket_bytes", [2_000, 24 << 20])
def test_repeated_bytes(spark, bucket_bytes):
    texts = _texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    seen = Counter(tuple(r[i : i + 200]) for r in raws.values() for i in range(len(r) - 199))
    rows = byte_dedup.drop_repeated_bytes(docs, bucket_bytes=bucket_bytes).select("doc_id", "dedup.*").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    for i, r in raws.items():
        flags = _covered(r, 200, seen)
        spans = sum(f and not before for f, before in zip(flags, [False, *flags]))
        assert got[i] == (len(r), sum(flags), spans, bytes(x for x, f in zip(r, flags) if not f))


def test_frequent_grams_do_not_change_the_result(spark, monkeypatch):
    from spanforge.llm import superstrings

    texts = _texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = sorted(map(str, word_dedup.drop_repeated_words(docs).collect()))
    monkeypatch.setattr(superstrings, "FREQUENT", 1)
    size, hot = superstrings.gram_slots(docs.select("text"), superstrings.word_units, 6)
    assert hot.any() and size == sum(len((t or "").encode()) for t in texts)
    assert sorted(map(str, word_dedup.drop_repeated_words(docs).collect())) == plain


def test_dedup_edge_cases(spark, odd, none):
    for drop in (word_dedup.drop_repeated_words, byte_dedup.drop_repeated_bytes):
        rows = drop(odd).collect()
        assert len(rows) == 9 and drop(none).count() == 0
        for r in rows:
            if r.text == LONG:
                assert r.dedup.n_removed > 0 and not r.dedup.kept.strip()
            if not (r.text or "").strip():
                assert r.dedup.n_removed == 0


# --- SimHash ---------------------------------------------------------------------------


def _simhash(text, k=3):
    words = _words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, budget=3):
    """Union-find over all pairs of distinct fingerprints."""
    distinct = sorted(set(prints))
    up = {p: p for p in distinct}

    def find(p):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= budget:
                up[find(q)] = find(p)
    return {p: find(p) for p in distinct}


def test_simhash_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: _simhash(r.text) for r in docs}
    root = _groups(prints.values())
    smallest = defaultdict(lambda: 1 << 62)
    for i, p in prints.items():
        smallest[root[p]] = min(smallest[root[p]], i)
    got = queries.op10_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", smallest[root[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("subtree", [4, 40, 1 << 13])
def test_trie_links(spark, subtree):
    rng = random.Random(subtree)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = set(centres) | {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))}) for c in centres for _ in range(6)} | {0, 7, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(frame, 3, subtree)
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 12 for a, b in links.collect())
    want = _groups(prints)
    ends = {r.node & ((1 << 64) - 1): r.root & ((1 << 64) - 1) for r in components(links).collect()}
    groups = defaultdict(set)
    for p in prints:
        groups[ends.get(p, p)].add(p)
    wanted = defaultdict(set)
    for p, r in want.items():
        wanted[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_paths(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 400)
    edges = [(names[i], names[i + 1]) for i in range(399) if i % 50 != 49]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[i // 50 * 50 : i // 50 * 50 + 50]) for i, n in enumerate(names)}


def test_keep_one(spark, odd, none):
    rows = simhash.keep_one(odd).collect()
    assert simhash.keep_one(none).count() == 0 and rows and simhash.keep_one(odd).columns == odd.columns
    texts = [r.text for r in odd.collect()]
    root = _groups(map(_simhash, texts))
    assert len(rows) == len({root[_simhash(t)] for t in texts})
    assert [r.doc_id for r in rows if not (r.text or "").strip()] == [1]


# --- decontamination -------------------------------------------------------------------


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_reach_recall(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(40)]
    docs = []
    for k in range(400):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if k % 2:
            leak = list(rng.choice(items))
            for _ in range(rng.randint(0, int(0.2 * len(leak)))):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append((k, " ".join(body)))
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {(d, k) for d, text in docs for k, item in enumerate(items) if _distance(item, text.split()) <= int(0.2 * len(item) + 1e-9)}
    for block in (20_000, 15):
        got = decontaminate.find_leaks(frame, benchmark, block=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert pairs <= want and len(pairs) >= 0.95 * len(want)
        for r in got:
            assert _distance(items[r.item_id], docs[r.doc_id][1].split()[r.start_word : r.end_word]) == r.edits


def _edited(rng, item, kind, even):
    """The item at exactly the allowed distance, edits at random places or evenly spread."""
    n = int(0.2 * len(item) + 1e-9)
    at = [(k + 1) * len(item) // (n + 1) for k in range(n)] if even else rng.sample(range(1, len(item)), n)
    out = list(item)
    for k, p in enumerate(sorted(at, reverse=True)):
        out[p : p + (kind != "insert")] = [] if kind == "delete" else [f"new{k}"]
    return out


@pytest.mark.parametrize("length", [16, 32, 64, 128, 256])
def test_leaks_at_full_distance(spark, length):
    """Benchmarks of one item length, so that every item is the smallest of its class."""
    rng = random.Random(length)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [rng.choices(vocabulary, k=length) for _ in range(30)]
    docs, kinds = [], {}
    for kind in ("replace", "insert", "delete"):
        for even in (False, True):
            for k, item in enumerate(items):
                leak = _edited(rng, item, kind, even)
                if _distance(item, leak) == int(0.2 * length + 1e-9):
                    kinds[len(docs), k] = kind, even
                    docs.append((len(docs), " ".join(rng.choices(vocabulary, k=rng.randint(20, 80)) + leak + rng.choices(vocabulary, k=30))))
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    total, found = Counter(kinds.values()), Counter(kinds[p] for p in kinds.keys() & got)
    print(length, {k: (found[k], n) for k, n in total.items()})
    assert len(total) == 6 and min(total.values()) >= 25 and all(found[k] >= 0.95 * n for k, n in total.items())


def test_leaks_on_table(spark, sf_dir):
    items = {r.item_id: decontaminate.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontaminate.words(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    exact = {(d, i) for d, w in docs.items() for i, item in items.items() if f" {' '.join(item)} " in f" {' '.join(w)} "}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op1_decontamination(spark, sf_dir).collect()}
    assert exact and exact <= {k for k, e in got.items() if e == 0} and {k for k, e in got.items() if e == 0} <= exact


def test_leak_edge_cases(spark, odd, none):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "same id other text same id other text"), (3, "the long text of many words the long text")], "item_id long, text string")
    leaks = decontaminate.find_leaks(odd, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in leaks) == [(4, -1), (4, 3), (4, 3)]
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.filter("item_id = 9")).count() == 0
    left = decontaminate.drop_leaks(odd, benchmark)
    assert left.columns == odd.columns and left.count() == 6


# --- sharding, mixing, quality ------------------------------------------------------------


def test_shards(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for small in (10_000, 16 << 20):
        out = sharding.shuffle_shards(docs, bucket_bytes=small)
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(s) for s in slots.values()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 8
        again = sharding.shuffle_shards(docs.repartition(7), bucket_bytes=small)
        assert {(r.doc_id, r.shard, r.slot) for r in again.collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
        order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
        assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3
    crc = {r.doc_id: zlib.crc32(r.text.encode()) for r in docs.collect()}
    assert {r.doc_id: r.text_crc32 for r in queries.op2_sharding(spark, sf_dir).collect()} == crc
    assert sharding.shuffle_shards(odd).count() == 9 and sharding.shuffle_shards(none).count() == 0


def test_fisher_yates_is_even():
    counts = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(counts) == 6 and max(counts.values()) - min(counts.values()) < 300


def test_mix(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), None if i % 9 == 0 else f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.repetitions(docs).select("doc_id", "source", "mix.*").collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 3
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(odd).columns == odd.columns
    assert mixing.repetitions(odd).count() == 9 and mixing.mix_sources(none).count() == 0


def test_targets_are_poured(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 5), ("d", 0), (None, 985)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # b and c are full (30, 15); what is left is poured over a, d (none) and null by 1 : 2
    assert got["b"] == 30 and got["c"] == 15 and got["d"] == 0
    weights = {"a": 1, None: 2}  # a, b, c, d, null weigh 1, 2, 3, 1, 2
    assert sum(got.values()) == pytest.approx(2000)
    assert all(got[s] == pytest.approx(1955 * w / 3) for s, w in weights.items())


def _repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    return len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})


def test_quality_counts(spark, odd, none):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "the", "b#", "c", "é|"], k=rng.randint(0, 80))).replace("c a", "c\na") for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.verdicts(docs).collect():
        w = _words(texts[r.doc_id])
        lines = [x for x in texts[r.doc_id].split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = _repeats(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[r.doc_id]), len(lines) - len(set(lines)), n)
        assert r.base_failed == (len(w) < 50 or 100 * n > 50 * len(w))
    judged = quality_rules.verdicts(odd)
    assert judged.count() == 9 and judged.filter("text is null and not base_failed").count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(none).count() == 0


def test_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = queries.op3_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got.get((0, True), 0) == 0 and got.get((1, False), 0) <= 0.02 * got[1, True]


# --- chats, urls, WARC ------------------------------------------------------------------


def test_chats(spark):
    base = [(t, r, f"text {t}") for t, r in enumerate(["user", "assistant"] * 3)]
    logs = {1: base[:2], 2: base[:4], 3: base, 4: base, 5: [(0, "user", "other")], 6: base[:3] + [(3, "assistant", "forked")], None: [(0, None, None)]}
    rows = [(c, *t) for c, turns in logs.items() for t in turns] + [(3, *base[0])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat_format.format_chats(frame).collect()}
    assert set(got) == {3, 5, 6, None} and got[3].copies == 2 and got[3].n_turns == 6
    assert got[6].rendered.endswith("<|im_start|>assistant\nforked<|im_end|>\n")
    assert chat_format.format_chats(frame.filter("turn > 99")).count() == 0


def test_long_chat_is_cut(spark, monkeypatch):
    rows = [(1, t, "user", "x") for t in range(2500)] + [(2, t, "user", "x") for t in range(2499)] + [(3, t, "user", "x") for t in range(1, 2499)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(frame).groupBy("conv_id").agg(F.sum("n_turns").alias("n"), F.max("part").alias("p")).collect()
    assert {(r.conv_id, r.n, r.p) for r in got} == {(1, 2500, 9), (3, 2498, 9)}


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.org/es/1?q": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/15": ("example.org", "/en/15", "example.org/en/1", "block"),
        "https://a.org/x": ("a.org", "/x", "org/", "allow"), "x://b.com/fr/#f": ("b.com", "/fr/", "com/fr/", "allow"),
        "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://notcom/de/": ("notcom", "/de/", None, None),
        "http://h.org": ("h.org", "", None, None), "nothing": ("", "", None, None), None: ("", "", None, None),
        "a://b#://c/d": ("b", "", None, None),
    }
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    got = url_filter.judge_urls(frame).collect()
    urls = list(cases)
    for r in got:
        host, path, rule, verdict = cases[urls[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
        assert r.verdict in ("allow", "block")
    assert url_filter.judge_urls(frame.filter("page_id < 0")).count() == 0


def test_url_model_by_brute_force(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['good', 'fine'])}.x/{rng.randint(0, 99)}" if k % 2 else f"http://{rng.choice(['bad', 'evil'])}.y/{rng.randint(0, 99)}" for k in range(400)]
    rules = (url_filter.UrlRule("allow", "good.x", "/"), url_filter.UrlRule("block", "bad.y", "/"))
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge_urls(frame, rules=rules).collect()
    hidden = [r for r in rows if r.rule is None]
    assert hidden and all(r.verdict == ("allow" if r.host == "fine.x" else "block") for r in hidden)
    texts = {r.host + r.path: r.rule for r in rows}
    keys = spark.createDataFrame([(s,) for s in texts], "s string").select("s", (F.pmod(F.xxhash64("s"), F.lit(10)) == 0).alias("out")).collect()
    counts = {c: Counter() for c in "ar"}
    times = Counter(r.host + r.path for r in rows)
    for s, out in keys:
        if texts[s] and not out:
            padded = "\x02" * 4 + s + "\x03"
            for i in range(4, len(padded)):
                for k in range(5):
                    counts["a" if texts[s] == "good.x/" else "r"][padded[i - k : i + 1]] += times[s]
    totals = {c: Counter() for c in "ar"}
    for c, grams in counts.items():
        for g, n in grams.items():
            totals[c][len(g), g[:-1]] += n

    def probability(c, gram):
        p = 1 / 256
        for k in range(5):
            tail = gram[4 - k :]
            p = (counts[c][tail] + 4 * p) / (totals[c][len(tail), tail[:-1]] + 4)
        return p

    for r in rows[:60]:
        padded = "\x02" * 4 + r.host + r.path + "\x03"
        grams = [padded[i - 4 : i + 1] for i in range(4, len(padded))]
        assert r.score == pytest.approx(np.mean([np.log(probability("a", g) / probability("r", g)) for g in grams]))


def test_chunks_cut_at_characters_and_openings():
    opening = warc.OPENING
    text = ("é" * 50 + opening + "x" * 33 + opening + opening) * 3
    for size in (1, 7, 64, 10_000):
        parts = list(warc.chunks(text.encode(), size))
        assert b"".join(parts) == text.encode() and all(opening not in p.decode() and len(p) <= size + 4 for p in parts)
    assert list(warc.chunks(b"", 5)) == [b""]


def warc_segments(text):
    return list(warc.chunks(text.encode(), 1000))


def test_warc_round_trip(spark, tmp_path):
    same, long = "s" * 100, "line\r\n\r\n" * 400 + warc.OPENING + "ü" * 3000
    pages = [(1, "http://a\r\nb", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
             (7, "u", long), (7, "u", long), (8, "u", long + "!"), (None, "u", same), (9, "u", warc.OPENING)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_warc(warc.with_records(frame), str(tmp_path / "w"), chunk_bytes=1000)
    got = sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = html == same and i != 1
        want.append(("null" if i is None else str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", "1" if again else ""))
    assert got == sorted(want)
    # fields that the format asks for, and references that resolve
    texts = [gzip.open(f, "rt", newline="").read() for f in (tmp_path / "w").glob("part-*.gz")]
    heads = [dict(line.split(": ", 1) for line in f"WARC-Type: {piece}".split("\r\n\r\n")[0].split("\r\n")) for t in texts for piece in t.split(warc.OPENING)[1:]]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) - len(warc_segments(long)) and all({"WARC-Date", "Content-Length", "WARC-Type"} <= h.keys() for h in heads)
    assert all(ids[h["WARC-Refers-To"]]["WARC-Type"] == "response" and "WARC-Profile" in h for h in heads if h["WARC-Type"] == "revisit")
    parts = [h for h in heads if h["WARC-Type"] == "continuation"]
    assert all(ids[h["WARC-Segment-Origin-ID"]]["WARC-Segment-Number"] == "1" for h in parts) and any("WARC-Segment-Total-Length" in h for h in parts)
    assert sum("WARC-Segment-Total-Length" in h for h in parts) == sum(h.get("WARC-Segment-Number") == "1" for h in heads)
    warc.write_warc(warc.with_records(frame.filter("page_id < 0")), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
