"""The registered queries of the operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import shared_folder

from . import (
    byte_dedup, chat_format, conversation_repair, decontaminate, merkle, mixing, quality_rules, sharding, simhash, token_counts, url_filter, warc,
    word_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@register()
def op1_decontamination(spark, sf_dir):
    """One row per document and benchmark item that leaks into it."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    leaks = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return leaks.select("doc_id", "item_id", "edits", "start_word", "end_word")


@register()
def op2_sharding(spark, sf_dir):
    """Where each document lands in the shuffled shards."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_shards(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_STOP = "|".join(dict.fromkeys(quality_rules.STOP_WORDS))
_BLANK = r"\x20\x09-\x0D"


@register(rf"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^{_BLANK}]')] AS lines
  FROM documents),
s AS (
  SELECT *, len(words) AS n_words, length(regexp_replace(text, '[{_BLANK}]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS grams
  FROM w),
g AS (SELECT k AS doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS pos FROM s),
t AS (SELECT doc_id, pos FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS word FROM t) GROUP BY doc_id),
r AS (
  SELECT s.*, coalesce(c.n, 0) AS n_repeat_words, greatest(n_words, 1) AS per_word, greatest(len(lines), 1) AS per_line,
         len([x FOR x IN words IF regexp_full_match(lower(x), '(?:{_STOP})[.,;:]?')]) AS n_stop
  FROM s LEFT JOIN c ON c.doc_id = s.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / per_word BETWEEN 2.0 AND 12.0 AND n_symbols / per_word <= 0.1
         AND (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) / per_word <= 0.15
         AND n_stop / per_word >= 0.04 AND n_dup_lines / per_line <= 0.3
         AND len([x FOR x IN lines IF regexp_matches(x, '^ *[-*•]')]) / per_line <= 0.9
         AND len([x FOR x IN lines IF regexp_matches(x, '(\.\.\.|…) *$')]) / per_line <= 0.3 AS kept
FROM r""")
def op3_quality_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    return quality_rules.verdicts(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l)
SELECT t.conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
       any_value(copies) AS copies
FROM t JOIN m USING (conv_id) GROUP BY t.conv_id, floor(turn / 256)""")
def op4_chat_formatting(spark, sf_dir):
    """The maximal conversations, rendered."""
    return chat_format.format_chats(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register()
def op5_suffix_dedup(spark, sf_dir):
    """What each document loses to repeated 200-byte strings."""
    rows = byte_dedup.drop_repeated_bytes(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))


@register(f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w),
v AS (SELECT *, max(CASE WHEN rest * weight <= room * sharing THEN rest::DOUBLE / sharing END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(room::DOUBLE, coalesce(level * weight, room::DOUBLE)) ELSE 0.0 END AS target FROM v),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""")
def op6_mixing(spark, sf_dir):
    """How many words of each document the mix takes."""
    mixed = mixing.repetitions(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


@register()
def op7_url_filter(spark, sf_dir):
    """Rule and verdict of every page's url."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@register("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""")
def op8_warc(spark, sf_dir):
    """Writes all pages as WARC archives and reads them back."""
    path = f"{shared_folder(spark)}/warc"
    warc.write_warc(warc.with_records(_table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return warc.read_warc(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@register(rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}') AS w FROM documents),
g AS (SELECT k, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS pos FROM r),
l AS (SELECT k, list(pos) AS gone FROM c GROUP BY k),
o AS (SELECT d.k, list(x.word ORDER BY x.pos) AS kept FROM (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) AS x
      JOIN d ON d.k = x.k LEFT JOIN c ON c.k = x.k AND c.pos = x.pos WHERE c.pos IS NULL GROUP BY d.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN l ON l.k = d.k LEFT JOIN o ON o.k = d.k""")
def op9_substring_dedup(spark, sf_dir):
    """What each document loses to repeated 35-word windows."""
    rows = word_dedup.drop_repeated_words(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


@register()
def op10_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def _crc32(value: str) -> str:
    """CRC-32 of an ASCII string in SQL: each byte is mixed in, then shifted out bit by bit (-1)."""
    steps = f"flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({value}, '')])"
    # 4294967295: all bits set; 3988292384: the reversed polynomial
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda a, x:
      CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in _FIELDS)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, * FROM documents),
l AS (SELECT k, doc_id, lang, sha256({_LEAF}) AS leaf,
             CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_LEAF.replace("text", _LOWER)}) END AS forged FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (
  SELECT lang, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL
  SELECT lang, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, idx // 8),
r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos AS idx, subroot AS h, count(*) OVER () AS n FROM r
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, idx // 8),
s AS (
  SELECT p.k, u.level, u.idx, u.h, u.idx - p.pos // (8 ** u.level)::BIGINT AS side FROM p
  JOIN up AS u ON u.lang IS NOT DISTINCT FROM p.lang AND u.n > 1 AND u.idx // 8 = p.pos // (8 ** (u.level + 1))::BIGINT
  UNION ALL
  SELECT p.k, 100 + u.level, u.idx, u.h, u.idx - r.pos // (8 ** u.level)::BIGINT FROM p
  JOIN r ON r.lang IS NOT DISTINCT FROM p.lang JOIN top AS u ON u.n > 1 AND u.idx // 8 = r.pos // (8 ** (u.level + 1))::BIGINT),
f AS (SELECT k, level, coalesce(string_agg(h, '' ORDER BY idx) FILTER (side < 0), '') AS before,
             coalesce(string_agg(h, '' ORDER BY idx) FILTER (side > 0), '') AS after FROM s GROUP BY k, level),
w AS (SELECT k, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS steps FROM f GROUP BY k),
o AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(forged, leaf), coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN w ON w.k = p.k)
SELECT *, folded_root = root AS verified FROM o""")
def op11_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of every document, and what a tampered text folds to."""
    docs = _table(spark, sf_dir, "documents", *_FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = [F.translate("text", upper, lower) if c == "text" else F.col(c) for c in _FIELDS]
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(lowered))
    rows = docs.select("doc_id", "lang", merkle.leaf_digest([F.col(c) for c in _FIELDS]).alias("leaf"), forged.alias("forged"))
    proofs = merkle.manifest(rows, "leaf", "lang", "doc_id", ["doc_id", "forged"])
    found = merkle.folded(F.coalesce("forged", "leaf"), F.col("siblings"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), found.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The tokenizer of the token-count query, and its limit of tokens.
TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


@register()
def op12_token_counts(spark, sf_dir):
    """Tokens of every document, by way of a new cache."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    counts = token_counts.count_tokens(docs, f"{shared_folder(spark)}/counts", public_tokenizers.path(TOKENIZER), blanks=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@register(rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations),
x AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE draw <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c FROM x),
f AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ends,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM r),
g AS (SELECT *, CASE WHEN ends = '' THEN 'b' WHEN again THEN 'd' WHEN ends NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault FROM f),
n AS (
  SELECT conv_id, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
step(st, op, letter, nx) AS (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3),
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
  (0, 'R', 'u', 2), (1, 'R', 'u', 2), (2, 'R', 'a', 3), (3, 'R', 'u', 2)),
added(fr, too, marks, lines) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 3, 'I', chr(10) || 'assistant:'), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, 2, 'I', chr(10) || 'user:'), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
w AS (
  SELECT conv_id, 0::BIGINT AS i, too AS st, {{'cost': 2 * length(marks), 'audit': marks, 'out': lines}} AS v FROM n, added WHERE fr = 0
  UNION ALL
  SELECT w.conv_id, g.i, too, min({{
           'cost': w.v.cost + 2 * length(marks) + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 't' THEN 1 ELSE 0 END,
           'audit': w.v.audit || op || marks,
           'out': w.v.out || CASE op WHEN 'D' THEN '' ELSE chr(10) || CASE WHEN op = 'K' THEN role WHEN letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END || lines}})
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1
  JOIN step ON step.st = w.st AND (op = 'D' OR fault NOT IN ('b', 'd') AND (op = 'R' AND letter <> c OR op = 'K' AND letter = c))
  JOIN added ON fr = nx GROUP BY w.conv_id, g.i, too),
best AS (SELECT w.conv_id, min(v) AS v FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i WHERE st IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(substr(v.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found, segments = conversation_repair.repair(conversation_repair.damaged(turns))
    found = found.join(conversation_repair.repaired_hashes(segments).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
