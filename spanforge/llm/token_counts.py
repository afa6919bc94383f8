"""Token counts through a cache of content digests.

A text is normalised (null: empty; where the tokenizer drops white space, runs of blanks
become one space) and hashed. The digests are joined to the counts stored for this
tokenizer, whose version is the digest of its file. Only distinct texts without a stored
count are encoded, and their counts are appended to the cache, a Parquet table in a shared
folder with one partition per version; then every row takes its count from there.

Documents travel as narrow (key, bytes, digest) rows. Texts are shuffled only if their
digest is missing, once per map task and digest. Digests of very many rows, of which there
are ``HOT_DIGESTS`` at most, are joined by broadcast, so the rows of a frequent text stay
where they are. An append is committed as a whole; a run that failed before it has added
nothing, and counts that two runs stored are equal and count once.

A tokenizer whose pieces never hold or cross white space is fed blank-separated pieces,
with a bounded memo of their counts in each task; others are fed whole texts.

Cases: null and empty texts have no tokens; very long texts are encoded in slabs cut at
blanks (whole if the tokenizer keeps blanks); repeated rows, tied and null keys each give
their own row; an empty table gives an empty result and leaves the cache alone; columns
other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

from . import components

#: Raised when the normalisation or the way of counting changes.
RULES = 1
#: Characters of a slab, and pieces that a task remembers.
SLAB, MEMO = 1 << 20, 1 << 18
#: A digest is hot from this many rows, or from a share of rows that few digests can have.
HOT_ROWS, HOT_DIGESTS = 10_000, 100_000
CACHE = "digest binary, n_tokens long, tokenizer string"
_PIECE = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def version(blob: bytes, kind: str, blanks: bool) -> str:
    """Digest of a tokenizer's file and of how it is used."""
    return hashlib.sha256(f"{RULES}:{kind}:{blanks}:".encode() + blob).hexdigest()


def encoder(blob: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts: no added tokens, no truncation, no padding."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(blob.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for tokenizer files of type {kind!r}")


def slabs(text: str, size: int = SLAB) -> Iterator[str]:
    """The text in stretches of about ``size`` characters that end at a blank."""
    at = 0
    while len(text) - at > size:
        found = _BLANK.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class PieceCounts:
    """Token counts of blank-separated pieces, remembered up to ``MEMO`` of them."""

    def __init__(self, encode: Callable[[list[str]], list[int]]) -> None:
        self.encode, self.memo = encode, {}

    def __call__(self, text: str) -> int:
        total = 0
        for slab in slabs(text):
            pieces = _PIECE.findall(slab)
            new = [p for p in set(pieces) if p not in self.memo]
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = list(set(pieces))
            self.memo.update(zip(new, self.encode(new)))
            total += sum(map(self.memo.__getitem__, pieces))
        return total


def normalised(text: Column, blanks: bool) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return whole if blanks else F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " "))


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty where there is no cache yet."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE)
    return table.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(texts: DataFrame, cache: str, blob: bytes, kind: str, blanks: bool) -> None:
    """Encodes the distinct ``texts`` (digest, body) and appends their counts to the cache."""
    held = texts.sparkSession.sparkContext.broadcast(blob)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value, kind)
        one = (lambda text: encode([text])[0]) if blanks else PieceCounts(encode)
        for batch in batches:
            counts = [one(text.as_py()) for text in batch.column("body")]
            yield pa.record_batch([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = texts.select("digest", "body").mapInArrow(count, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version(blob, kind, blanks))).write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text", key: str = "doc_id", blanks: bool = True) -> DataFrame:
    """key, digest (of the normalised text), n_bytes (of the text itself), n_tokens: one row per document.

    ``path`` is the tokenizer's file on the driver, ``cache`` a folder that all executors
    share. ``blanks=False`` says that the tokenizer drops white space and that no token or
    special string spans it; only then are blanks normalised and pieces counted alone.
    """
    with open(path, "rb") as file:
        blob = file.read()
    kind = os.path.splitext(path)[1]
    spark, name = docs.sparkSession, version(blob, kind, blanks)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    body = normalised(F.col("text"), blanks)
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    rows = cut_lineage(source.select("key", digest, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    missing = cut_lineage(rows.select("digest").distinct().join(stored_counts(spark, cache, name), "digest", "left_anti"))
    wanted = missing.count()
    if wanted:
        texts = source.select(body.alias("body"), digest)
        if wanted <= components.BROADCAST_KEYS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        add_missing(texts, cache, blob, kind, blanks)
    counts = stored_counts(spark, cache, name)
    bound = max(HOT_ROWS, rows.count() // HOT_DIGESTS)
    hot = cut_lineage(rows.groupBy("digest").count().filter(F.col("count") > bound).select("digest"))
    hot_counts = cut_lineage(counts.join(F.broadcast(hot), "digest"))
    often = rows.join(F.broadcast(hot_counts), "digest")
    rest = rows.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest", "left")
    return often.unionByName(rest).withColumnRenamed("key", key).select(key, "digest", "n_bytes", "n_tokens")
