"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A benchmark item leaks into a document if some stretch of the document is within
``1 - similarity`` times the item's words of it by edit distance over words (runs of
letters and digits, lower-cased).

* Items are classed by size (octaves whose windows would stand equally close are one
  class, so a text is walked once for them). Windows of half of what deletions leave of the smallest item
  of a class, ``WIDTH`` words at most, stand so close in every text that any stretch an
  item can leave holds two or more, and every window of an item is indexed. Short windows
  have fewer edits at best than the item has on average, so long items are found as well.
  A window is walked at random: at each step the walk writes the word it is at and moves
  on if a random bit of (step, word) says so. Windows at a small edit distance give walks
  at a small Hamming distance.
* A repetition samples ``bits`` steps of the walk; windows of a text and of an item are
  candidates if all sampled words agree. The number of repetitions follows from the
  recall aimed at and from how often a sampled step agrees at the full distance. The
  walk of a window stops at the first sampled step that no item shares.
* A candidate's document must have the item's distinct words less its edits, and what the
  stretch and the item have in common, repeats counted, must reach the item less its edits; then the edit distance of the item to all stretches around it decides.

Words that no item has are one symbol; they equal no item word, so no distance changes.

Items are taken in blocks of ``ITEM_BLOCK``; each block goes to all tasks and is one pass
over the texts, so the benchmark may be of any size.

Cases: null or empty texts and items match nothing; repeated documents are flagged
alike, repeated items each; null ids are carried; an empty table on either side gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import counted

ITEM_BLOCK = 20_000
SIMILARITY = 0.8
RECALL = 0.95
BITS = 4
#: How often a sampled step is taken to agree at the full distance; an assumption, and
#: tests/llm hold the recall that follows from it to brute force at exactly that distance.
AGREEMENT = 0.68
#: Words of a window, and words from the start of one in a text to the next, at most.
WIDTH, STRIDE = 8, 6
SEED = 97
WORD = re.compile(r"[^\W_]+")
_SLOTS, _TABLE_BITS = 1 << 12, 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text searched at once, and words of stretches verified at once.
SLICE_BYTES, CELLS = 4 << 20, 1 << 19


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def repetitions(recall: float = RECALL, bits: int = BITS, agreement: float = AGREEMENT) -> int:
    """Repetitions after which a pair at full distance was a candidate with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**bits))


def edits_allowed(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def closest_stretches(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of the item to the nearest stretch of each text (a row), and where that ends.

    Rows may be filled up with zeros: a nearest stretch never needs them.
    """
    at = np.arange(texts.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = k
        np.minimum(row[:, :-1] + (texts != word), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - at, axis=1) + at
    end = row.argmin(axis=1)
    return row[np.arange(len(texts)), end], end


class Verifier:
    """The exact test of one item against stretches of the joined texts of a slice."""

    def __init__(self, item: np.ndarray, budget: int, symbols: int) -> None:
        self.item, self.budget = item, budget
        found, self.most = np.unique(item, return_counts=True)
        self.local = np.zeros(symbols, np.int32)
        self.local[found] = np.arange(1, len(found) + 1)
        self.width = len(item) + 5 * budget

    def leaks(self, joined: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """(document, edits, start, end) of every stretch within the budget, a bounded number of rows at a time."""
        step = max(1, CELLS // self.width)
        for at in range(0, len(doc), step):
            place = start[at : at + step, None] + np.arange(self.width)
            text = np.where(place < stop[at : at + step, None], joined[np.minimum(place, len(joined) - 1)], 0)
            # what item and stretch have in common, repeats counted, must reach the item less its edits
            size = len(self.most) + 1
            held = np.bincount((np.arange(len(text))[:, None] * size + self.local[text]).reshape(-1), minlength=len(text) * size)
            common = np.minimum(held.reshape(-1, size)[:, 1:], self.most).sum(axis=1)
            hopeful = np.flatnonzero(common >= len(self.item) - self.budget)
            edits, end = closest_stretches(self.item, text[hopeful])
            for k in np.flatnonzero(edits <= self.budget).tolist():
                back = closest_stretches(self.item[::-1], text[hopeful[k], : end[k]][None, ::-1])[1][0]
                row = at + int(hopeful[k])
                yield int(doc[row]), int(edits[k]), int(start[row] + end[k] - back), int(start[row] + end[k])


class Walks:
    """Random bits, sampled steps and indexed item windows of one size class."""

    def __init__(self, items: dict[int, np.ndarray], times: int, bits: int, seed: int, similarity: float = SIMILARITY):
        self.items, self.bits = items, bits
        shortest = min(map(len, items.values()))
        self.width, self.stride = window_shape(shortest, similarity)
        self.span = 2 * self.width
        generator = np.random.default_rng([seed, shortest])
        self.moves = generator.integers(0, 2, (times, self.span, _SLOTS), dtype=np.int8)
        # steps are drawn without repetition; where a walk has fewer, all are used
        self.steps = [np.sort(generator.choice(self.span, min(bits, self.span), replace=False)) for _ in range(times)]
        owners = [(k, at) for k, item in items.items() for at in range(len(item) - self.width + 1)]
        self.owner = np.array(owners, np.int64)
        text = np.concatenate([item for item in items.values()] + [np.zeros(self.span + 1, np.int64)])
        firsts = dict(zip(items, np.cumsum([0, *map(len, items.values())]).tolist()))
        starts = np.array([firsts[k] + at for k, at in owners], np.int32)
        self.tables = []
        for r in range(times):
            levels: list[np.ndarray] = []
            key, _ = self._walk(text, starts, r, levels, None)
            order = np.argsort(key, kind="stable")
            self.tables.append((levels, key[order], order))

    def _walk(self, text: np.ndarray, starts: np.ndarray, r: int, made: list | None, known: list | None):
        """Keys of the sampled words, and which starts remain. Fills ``made`` with one table
        of key slots per sampled step, or leaves windows that ``known`` rules out."""
        low = (text & (_SLOTS - 1)).astype(np.int16)
        alive = np.arange(len(starts))
        place, key, begun = starts.copy(), np.zeros(len(starts), np.uint64), 0
        for level, stop in enumerate(self.steps[r].tolist()):
            for step in range(begun, stop):
                place += self.moves[r, step].take(low.take(place))
            key = key * _SPREAD + text.take(place).astype(np.uint64) + np.uint64(1)
            slot = (key * _SPREAD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            if made is not None:
                table = np.zeros(1 << _TABLE_BITS, bool)
                table[slot] = True
                made.append(table)
            else:
                stay = known[level].take(slot)
                alive, place, key = alive[stay], place[stay], key[stay]
                if not len(alive):
                    break
            place += self.moves[r, stop].take(low.take(place))
            begun = stop + 1
        return key, alive

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and where they would begin in the text; ``text`` is followed by ``span`` zeros."""
        starts = np.arange(0, max(0, len(text) - self.span), self.stride, dtype=np.int32)
        # one number per (item, begin): an item begins before the text by its own length at most
        ahead = int(self.owner[:, 1].max())
        found, room = [], np.int64(len(text) + ahead + 1)
        for r, (levels, keys, order) in enumerate(self.tables):
            key, alive = self._walk(text, starts, r, None, levels)
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            count = (high - low)[: len(alive)]
            if not count.any():
                continue
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = self.owner[order[np.repeat(low, count) + step]]
            found.append(np.unique(owner[:, 0] * room + np.repeat(starts[alive], count) - owner[:, 1] + ahead))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // room, both % room - ahead


class Hopefuls:
    """From candidates of a class to the stretches worth the exact test.

    A document must have all distinct words of an item but for as many as there may be
    edits. The words' items are listed once, so a document costs its own distinct words,
    however many items share them and however many candidates it has.
    """

    def __init__(self, items: dict[int, np.ndarray], similarity: float, symbols: int) -> None:
        self.keys = np.array(list(items), np.int64)
        self.place = np.zeros(self.keys.max() + 1, np.int64)
        self.place[self.keys] = np.arange(len(items))
        self.lengths = np.array([len(i) for i in items.values()], np.int64)
        self.budgets = np.array([edits_allowed(n, similarity) for n in self.lengths.tolist()], np.int64)
        own = [np.unique(i) for i in items.values()]
        self.needed = np.array([len(w) for w in own]) - self.budgets
        word, item = np.concatenate(own), np.repeat(np.arange(len(own)), [len(w) for w in own])
        order = np.argsort(word, kind="stable")
        self.items_of = item[order]
        self.begin = np.searchsorted(word[order], np.arange(symbols + 1))

    def stretches(self, owners: np.ndarray, begins: np.ndarray, joined: np.ndarray, numbered: list[np.ndarray], firsts: np.ndarray, ends: np.ndarray):
        """(item, document, start, stop), ordered by item: stretches around candidates, cut at the documents' ends."""
        at = self.place[owners]
        order = np.lexsort((begins, at))
        at, begins = at[order], begins[order]
        apart = np.maximum(1, self.budgets[at])  # candidates that near each other see the same stretch
        new = np.concatenate(([True], (np.diff(at) > 0) | (np.diff(begins // apart) > 0)))
        at, begins = at[new], begins[new]
        low = np.clip(begins - 2 * self.budgets[at], 0, len(joined))
        high = np.clip(low + self.lengths[at] + 5 * self.budgets[at], 0, len(joined))
        one, last = np.searchsorted(ends, low), np.minimum(np.searchsorted(ends, high - 1), len(ends) - 1)
        many = np.maximum(last - one + 1, 0)
        doc = np.repeat(one, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, low, high = np.repeat(at, many), np.repeat(low, many), np.repeat(high, many)
        start, stop = np.maximum(low, firsts[doc]), np.minimum(high, ends[doc])
        fits = stop - start >= self.lengths[at] - self.budgets[at]
        at, doc, start, stop = at[fits], doc[fits], start[fits], stop[fits]
        keep = np.zeros(len(at), bool)
        by_doc = np.argsort(doc, kind="stable")
        for rows in np.split(by_doc, np.flatnonzero(np.diff(doc[by_doc])) + 1) if len(doc) else ():
            own = np.unique(numbered[doc[rows[0]]])
            first, count = self.begin[own], self.begin[own + 1] - self.begin[own]
            listed = self.items_of[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)]
            held = np.bincount(listed, minlength=len(self.keys))
            keep[rows] = held[at[rows]] >= self.needed[at[rows]]
        return self.keys[at[keep]], doc[keep], start[keep], stop[keep]


def size_classes(items: list[np.ndarray], similarity: float = SIMILARITY) -> list[dict[int, np.ndarray]]:
    """Items by octaves of their length, octaves whose windows stand equally close together;
    items without a word are left out."""
    octaves: dict[int, dict[int, np.ndarray]] = {}
    for k, item in enumerate(items):
        if len(item):
            octaves.setdefault(len(item).bit_length(), {})[k] = item
    classes: dict[int, dict[int, np.ndarray]] = {}
    for octave in octaves.values():
        classes.setdefault(window_shape(min(map(len, octave.values())), similarity)[1], {}).update(octave)
    return list(classes.values())


def window_shape(shortest: int, similarity: float) -> tuple[int, int]:
    """Words of a window and of the stride for a class with this smallest item."""
    left = shortest - edits_allowed(shortest, similarity)
    width = max(1, min(WIDTH, (left + 1) // 2))
    return width, max(1, min(STRIDE, (left - width + 1) // 2))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    similarity: float = SIMILARITY, recall: float = RECALL, bits: int = BITS, agreement: float = AGREEMENT, seed: int = SEED,
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """key, item_key, edits, start_word, end_word, digest: one row per document and leaked
    item, at the nearest stretch found. ``digest`` is of the document's text."""
    times = repetitions(recall, bits, agreement)
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-items.count() // block))
    passes = []
    for number in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        passes.append(_one_pass(docs, mine.collect(), text, key, items.schema["item_id"].dataType, item_key, similarity, times, bits, seed))
    return reduce(DataFrame.unionAll, passes)


def _one_pass(docs, rows, text, key, item_type, item_key, similarity, times, bits, seed) -> DataFrame:
    split = [words(r["text"]) for r in rows]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s), 1)}
    ids = [r["item_id"] for r in rows]
    classes = [Walks(c, times, bits, seed, similarity) for c in size_classes([np.array([number[w] for w in s], np.int64) for s in split], similarity)]
    shared = docs.sparkSession.sparkContext.broadcast((number, [(c, Hopefuls(c.items, similarity, len(number) + 1)) for c in classes]))

    def slices(batch):
        """Row ranges of a batch of about ``SLICE_BYTES`` of text."""
        sizes = np.array([len(t.as_py() or "") for t in batch.column(1)], np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(low, high - low) for low, high in zip(cuts, cuts[1:]) if high > low)

    def search(batches):
        number, classes = shared.value
        get = number.get
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            texts = batch.column(1)
            numbered = [np.array([get(w, 0) for w in words(t.as_py())], np.int64) for t in texts]
            # texts stand in one row, parted by a word that no item has
            sizes = np.array([len(n) + 1 for n in numbered], np.int64)
            ends = np.cumsum(sizes) - 1
            firsts = ends + 1 - sizes
            joined = np.concatenate([x for n in numbered for x in (n, [0])])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for walks, hopefuls in classes:
                padded = np.concatenate((joined, np.zeros(walks.span + 1, np.int64)))
                owners, begins = walks.candidates(padded)
                owners, docs_at, starts, stops = hopefuls.stretches(owners, begins, joined, numbered, firsts, ends) if len(owners) else (owners,) * 4
                cuts = np.flatnonzero(np.diff(owners)) + 1
                for rows in np.split(np.arange(len(owners)), cuts) if len(owners) else ():
                    item = int(owners[rows[0]])
                    budget = edits_allowed(len(walks.items[item]), similarity)
                    verifier = Verifier(walks.items[item], budget, len(number) + 1)
                    for doc, edits, start, end in verifier.leaks(joined, docs_at[rows], starts[rows], stops[rows]):
                        if edits < best.get((doc, item), (budget + 1,))[0]:
                            best[doc, item] = (edits, start - int(firsts[doc]), end - int(firsts[doc]))
            for (doc, item), (edits, start, end) in best.items():
                found.append((doc, ids[item], edits, start, end))
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array([f[1] for f in found], item_kind), *(pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4)), batch.column(2).take(take)],
                ["key", "item", "edits", "start_word", "end_word", "digest"])

    item_kind = to_arrow_type(item_type)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    schema = T.StructType([
        T.StructField("key", narrow.schema["key"].dataType), T.StructField("item", item_type),
        *(T.StructField(c, T.IntegerType()) for c in ("edits", "start_word", "end_word")), T.StructField("digest", T.StringType())])
    return narrow.mapInArrow(search, schema).withColumnsRenamed({"key": key, "item": item_key})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    leaks = counted(find_leaks(docs, benchmark, text, key, **options).select(F.col("digest").alias("__digest")).distinct())
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("__digest", digest).join(leaks, "__digest", "left_anti").drop("__digest")
