"""Merkle manifest, token counts and conversation repair against brute force, and their edge cases."""

import hashlib
import random
import re
from itertools import product

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import components, conversation_repair as repair, merkle, token_counts

# --- Merkle manifest -------------------------------------------------------------------


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(leaves):
    """Levels from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def _flanks(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def _manifest(rows):
    """rows of (order, group, leaf) -> {(order, leaf): (subroot, root, flanks)}"""
    low = lambda v: (v is not None, v or 0)
    groups = {}
    for order, group, leaf in sorted(rows, key=lambda r: (low(r[0]), r[2])):
        groups.setdefault(group, []).append((order, leaf))
    trees = {g: _tree([leaf for _, leaf in rows]) for g, rows in groups.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = _tree([trees[g][-1][0] for g in names])
    found = []
    for g, rows in groups.items():
        for at, (order, leaf) in enumerate(rows):
            flanks = _flanks(trees[g], at) + _flanks(top, names.index(g))
            found.append((order, leaf, trees[g][-1][0], top[-1][0], flanks))
    return found


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 600, "é": 65, "z": 64, None: 3}, {str(k): 2 for k in range(70)} | {"": 515}])
def test_manifest(spark, sizes):
    rng = random.Random(5)
    rows = []
    for group, n in sizes.items():
        for k in range(n):
            order = None if k == 0 else rng.randrange(n)
            rows.append((order, group, _leaf((order, group, k % 7 or None, None, "T" * (k % 5)))))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5).withColumn("pos", F.lit(1)).withColumn("root", F.lit("x"))
    got = merkle.manifest(frame, "leaf", "lang", "doc_id", ["doc_id"]).withColumns({
        "fold": merkle.folded(F.col("leaf"), F.col("siblings")), "proof": merkle.proof_digest(F.col("siblings"))}).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(_manifest(rows), key=key)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in got], key=key) == want
    assert all(r.fold == r.root for r in got)
    proofs = {(r[0], r[1], _h("".join(left + right for left, right in r[4]))) for r in want}
    assert {(r.doc_id, r.leaf, r.proof) for r in got} == proofs


def test_leaf_digest(spark):
    rows = [(1, "web", None, 3, "é\n:"), (None, "", "en", None, ""), (3, None, "en", 9, "x" * 3_000_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = frame.select(merkle.leaf_digest([F.col(c) for c in frame.columns]).alias("leaf")).collect()
    assert [r.leaf for r in got] == [_leaf(r) for r in rows]


def test_manifest_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(frame, "leaf", "lang", "doc_id", ["doc_id"]).columns == ["doc_id", "leaf", "subroot", "root", "siblings"]
    assert merkle.manifest(frame, "leaf", "lang", "doc_id", ["doc_id"]).count() == 0


# --- token counts ----------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _count(text):
    return len(_count.tokenizer.encode(text or "", add_special_tokens=False))


_count.tokenizer = Tokenizer.from_file(WORDS)
ODD = [
    None, "", " \t\n", "It's  they'LL  42 <|endoftext|>x <|startoftext|>", "ÀÉ é é ́a", "a b c", "x" * 9000, "1234 " * 5,
    "İstanbul ﬁ \U0001f600\U0001f600!!", "tab\tnew\nline\x0b\x0c\rend", "It's they'll 42 <|endoftext|>x <|startoftext|>", "the same text", "the  same\ttext ",
]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé'sltre0 9\t\n\x0b ́İ <|endoftext>startoftext!?가"), max_size=60) | st.text(max_size=40))
def test_pieces_count_like_the_whole(text):
    counts = token_counts.PieceCounts(lambda texts: [len(e) for e in _count.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    text = text.replace("endoftext", "<|endoftext|>")
    whole = _count(text)
    assert counts(text) == whole
    assert counts(re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")) == whole


def test_slabs():
    text = "word " * 50 + "y" * 100 + " end"
    parts = list(token_counts.slabs(text, 16))
    assert "".join(parts) == text and len(parts) > 10 and all(p[0] == " " for p in parts[1:]) and list(token_counts.slabs("", 16)) == [""]
    assert list(token_counts.slabs("z" * 100, 16)) == ["z" * 100, ""]


@pytest.mark.parametrize("few", [True, False])
def test_token_counts(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(components, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(token_counts, "HOT_ROWS", 5)
    rows = [(i, t, 0, "x") for i, t in enumerate(ODD)] + [(None, "the same text", 0, "x")] * 8 + [(3, "other words " * 3000, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, digest string").repartition(4)
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(docs, cache, WORDS, blanks=False).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(i, len((t or "").encode()), _count(t)) for i, t, *_ in rows], key=key)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=key) == want
    stored = spark.read.parquet(cache)
    first = stored.count()
    assert first == stored.select("digest").distinct().count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip() for _, t, *_ in rows})

    more = docs.unionByName(spark.createDataFrame([(90, "a new one", 0, "x")], docs.schema))
    assert token_counts.count_tokens(more, cache, WORDS, blanks=False).filter("doc_id = 90").first().n_tokens == _count("a new one")
    assert spark.read.parquet(cache).count() == first + 1  # only the miss was encoded and added
    # another way of counting is another version: nothing of the first one is used
    assert token_counts.count_tokens(docs.filter("doc_id = 5"), cache, WORDS).count() == 1
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_stored_counts_are_used(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    with open(WORDS, "rb") as file:
        name = token_counts.version(file.read(), ".json", False)
    for _ in range(2):  # two runs stored the same count
        docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"), F.lit(name).alias("tokenizer")).write.mode(
            "append").partitionBy("tokenizer").parquet(cache)
    assert [r.n_tokens for r in token_counts.count_tokens(docs, cache, WORDS, blanks=False).collect()] == [77]


def test_sentence_pieces(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, str(tmp_path / "c"), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(docs.limit(0), str(tmp_path / "none"), path).count() == 0


# --- conversation repair -----------------------------------------------------------------


def _states(initials, marks, entry=repair.START):
    """state -> (cost, audit) after all turns, one state machine step per turn."""
    def inserts(found):
        for _ in range(2):
            for state, (cost, audit) in list(found.items()):
                to = repair.ASSISTANT if state == repair.USER else repair.USER
                found[to] = min(found.get(to, (1e9, "")), (cost + 2, audit + "I"))
        return found

    found = inserts({entry: (0, "")})
    for initial, mark in zip(initials, marks):
        after = {}
        for state, (cost, audit) in found.items():
            steps = [(state, 3, "D")]
            if mark != "-":
                for (at, letter), to in repair.NEXT.items():
                    if at == state and (letter == initial or letter in "ua"):
                        steps.append((to, (letter != initial) * 2 + (mark == "t"), "K" if letter == initial else "R"))
            for to, more, op in steps:
                after[to] = min(after.get(to, (1e9, "")), (cost + more, audit + op))
        found = inserts(after)
    return found


def test_alignment_of_all_short_segments():
    for n in range(5):
        for initials in product("sua?", repeat=n):
            for marks in product(".t-", repeat=n) if n < 4 else [tuple(".t-."), tuple("...."), tuple("-..t")]:
                found = repair.ways("".join(initials), "".join(marks))
                for entry in range(4):
                    want = _states(initials, marks, entry)
                    assert {end: way for (begin, end), way in found.items() if begin == entry} == want, (initials, marks, entry)


def test_alignment_of_long_segments():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(5, 64)
        initials = "".join(rng.choice("ua" if rng.random() < 0.7 else "sua?") if rng.random() < 0.4 else "ua"[k % 2] for k in range(n))
        marks = "".join(rng.choices(".t-", [8, 1, 1], k=n))
        found = repair.ways(initials, marks)
        for entry in range(4):
            assert {end: way for (begin, end), way in found.items() if begin == entry} == _states(initials, marks, entry)
        at = rng.randint(1, n - 1)
        assert repair.through(repair.ways(initials[:at], marks[:at]), repair.ways(initials[at:], marks[at:])) == found


def _brute(turns):
    """The repair of one conversation, given its rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marks, faults, seen = "", {"b": 0, "d": 0, "t": 0, ".": 0}, set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "."
        seen.add((role, text))
        faults[fault] += 1
        marks += {"b": "-", "d": "-", "t": "t", ".": "."}[fault]
    letters = [r[:1] for _, r, _ in rows]
    found = _states([c if c in ("s", "u", "a") else "?" for c in letters], marks)
    cost, audit = min(found[s] for s in (repair.START, repair.ASSISTANT) if s in found)
    out, state, at = [], repair.START, 0
    for op in audit:
        if op == "D":
            at += 1
            continue
        letter = letters[at] if op == "K" else "a" if state == repair.USER else "u"
        out.append((rows[at][1] if op == "K" else repair.ROLES[letter]) + ":" + ("" if op == "I" else rows[at][2]))
        state, at = repair.NEXT[state, letter], at + (op != "I")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, "\n".join(out)


@pytest.mark.parametrize("segment", [3, 64])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(segment)
    conversations = {}
    for conv in [None, *range(40), 99]:
        n = 300 if conv == 99 else rng.randint(1, 9)
        conversations[conv] = [(
            rng.choice([None, 3]) if rng.random() < 0.1 else k + (k > 4) * rng.randint(0, 2),
            rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ["user", "assistant"][k % 2],
            rng.choice(["", None, " \n", "Same.", "cut off", "é! ", "long words " * 2000 + "."]) if rng.random() < 0.4 else f"Text {k}. \n") for k in range(n)]
    rows = [(c, *row, "x") for c, turns in conversations.items() for row in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(4)
    found, segments = repair.repair(frame)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.repaired_hashes(segments).collect()}
    got = {r.conv_id: (*r[1:], hashes[r.conv_id]) for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    want = {c: (*b[:-1], _h(b[-1])) for c, b in ((c, _brute(turns)) for c, turns in conversations.items())}
    assert got == want


def test_repair_of_nothing(spark):
    found, segments = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.count() == 0 and repair.repaired_hashes(segments).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in [*range(6), None]] + [(None, 1, None, None)]
    got = sorted(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=str)
    want = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if draw == 4 else role, {1: "", 2: "One Two" if text != " " else " "}.get(draw, text))
        want += [row] * (0 if draw == 0 else 2 if draw == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
