"""WARC archives from and to a chunked record table.

A payload is written as rows of (record, chunk number, chunk): the first chunk is the
response record, each further one a continuation record of its own id that names the first
one (the format's way to cut large records; the last gives the total length). A reader holds
one chunk, never a whole record; a writer holds the column value that Spark hands it and its
UTF-8 bytes, from which it cuts one chunk at a time. Every segment carries the running SHA-256
up to its end; the last one is the payload's digest. Of records with equal payloads the first
is the response, the others are revisits without a body that refer to its record id.

Chunks end at character borders, and no chunk holds the line that opens a record: where
a payload has it, the chunk ends inside it, so that line alone parts the records. Archives
are gzip files of one stream each, read by one task each.

Cases: a null payload is empty; a null url is an empty target; rows that are equal in
id and payload are written alike (all responses if the first one is); null ids count as
the largest and are kept as such; an empty table makes an empty archive; other columns
are not written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
MIN_REVISIT_BYTES = 100
OPENING = "WARC/1.1\r\nWARC-Type: "
#: Fixed values of the format: the profile of a revisit, and a date where the source has none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
_CUT = OPENING.encode()


def with_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """record_id, target, payload, payload_bytes, payload_digest, record_type, refers_to.

    Only digests meet to find the first of equal payloads; there is one row per digest
    on the side that is joined back, so a hot digest is split by the skew join.
    """
    rows = pages.select(
        F.col(key).alias("record_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("target"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("record_id").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("record_id"))
    return rows.join(firsts, "payload_digest", "left").withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("first")


def chunks(payload: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (4 more at most, for a character) that do not hold the opening line."""
    at, view = 0, memoryview(payload)
    stops = [m.start() + len(_CUT) // 2 for m in re.finditer(re.escape(_CUT), payload)] + [len(payload)]
    for stop in stops:
        while at < stop:
            end = min(at + size, stop)
            while end < stop and payload[end] & 0xC0 == 0x80:
                end += 1
            yield bytes(view[at:end])
            at = end
    if not payload:
        yield b""


def write_warc(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, date: str = NO_DATE) -> None:
    """Writes gzip-compressed archives; each task writes one. ``date`` is that of all records."""

    def headers(name: str, target: str, size: int, kind: str, refers, digest: str, number: int, last: bool) -> list[str]:
        own = f"<urn:page:{name}:{digest}>"
        if number > 1:
            head = [OPENING + "continuation", f"WARC-Record-ID: <urn:page:{name}:{digest}:{number}>", f"WARC-Date: {date}", f"WARC-Segment-Origin-ID: {own}"]
            total = [f"WARC-Segment-Total-Length: {size}"] if last else []
            return head + [f"WARC-Segment-Number: {number}", *total]
        head = [OPENING + kind, f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
        if refers is not None:  # an equal payload, so an equal digest
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}:{digest}>"]
        return head + ([] if last else ["WARC-Segment-Number: 1"])

    def segments(batches):
        out: list[bytes] = []
        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "target", "payload", "payload_bytes", "record_type", "refers_to", "payload_digest")]
            for row in range(batch.num_rows):
                record, target, _, size, kind, refers, digest = (None if i == 2 else c[row].as_py() for i, c in enumerate(columns))
                name = "null" if record is None else str(record)
                target = re.sub(r"[\r\n]", " ", target)
                if kind == "revisit":
                    parts: Iterator[bytes] = iter((b"",))
                else:
                    parts = chunks(columns[2][row].as_py().encode(), chunk_bytes)
                running = hashlib.sha256()
                part, number = next(parts), 0
                while part is not None:
                    following, number = next(parts, None), number + 1
                    running.update(part)
                    head = headers(name, target, size, kind, refers, digest, number, following is None)
                    head += [f"X-Running-Digest: sha256:{running.hexdigest()}", f"Content-Length: {len(part)}"]
                    out.append("\r\n".join(head).encode() + b"\r\n\r\n" + part + b"\r\n")
                    held += len(out[-1])
                    part = following
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    records.mapInArrow(segments, "value string").write.text(path, compression="gzip", lineSep="\r\n")


def read_segments(spark, path: str) -> DataFrame:
    """record_id, name (of the record), segment, record_type, target, declared (payload digest), payload_length,
    refers_to, running (digest), length and body of each record in the archives."""
    pieces = spark.read.text(path, lineSep=OPENING).filter("value <> ''")
    value = F.col("value")
    head = F.substring_index(value, "\r\n\r\n", 1)
    body = F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")

    def field(name: str, pattern: str) -> F.Column:
        found = F.regexp_extract("head", f"\r\n{name}: {pattern}", 1)
        return F.when(found != "", found)

    # the last piece of a file keeps the blank line that other pieces keep, too: each ends in CRLF CRLF
    return pieces.select(value, head.alias("head")).select(
        F.regexp_extract("head", "^([a-z]+)", 1).alias("record_type"), field("WARC-Record-ID", "<urn:page:(.*):[0-9a-f]{64}(?::[0-9]+)?>").alias("record_id"),
        F.coalesce(field("WARC-Segment-Origin-ID", "<([^\r]*)>"), field("WARC-Record-ID", "<([^\r]*)>")).alias("name"),
        F.coalesce(field("WARC-Segment-Number", "([0-9]+)").cast("int"), F.lit(1)).alias("segment"), field("WARC-Target-URI", "([^\r]*)").alias("target"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("declared"), field("X-Payload-Length", "([0-9]+)").cast("long").alias("payload_length"),
        field("WARC-Refers-To", "<urn:page:(.*):[0-9a-f]{64}>").alias("refers_to"), field("X-Running-Digest", "sha256:([0-9a-f]+)").alias("running"),
        field("Content-Length", "([0-9]+)").cast("long").alias("length"), body.alias("body"))


def read_warc(spark, path: str) -> DataFrame:
    """record_id (text), record_type, target, payload_bytes, payload_digest, refers_to.

    Digests come from the bytes read: of a record with one segment directly, of longer
    ones in one pass over its segments in order, which holds one batch of chunks. A
    revisit has no bytes and keeps what its header declares. A record whose segments do
    not add up to its running digests fails.
    """
    parts = read_segments(spark, path)
    firsts = parts.filter("segment = 1").withColumn("digest", F.sha2("body", 256))
    whole = (F.col("record_type") == "revisit") | (F.col("length") == F.col("payload_length"))
    checked = F.when(F.col("record_type") == "revisit", F.col("declared")).when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("digest of record "), "record_id")))
    single = firsts.filter(whole).select("record_id", "record_type", "target", F.col("payload_length").alias("payload_bytes"), checked.alias("payload_digest"), "refers_to")
    return single.unionByName(_long_records(parts))


def _long_records(parts: DataFrame) -> DataFrame:
    long = parts.filter("segment > 1 or record_type <> 'revisit' and length < payload_length")

    def digests(batches):
        now, running, row, done = None, None, {}, []

        def close():
            if row.get("size") != row.get("length") or running.hexdigest() != row.get("declared"):
                raise ValueError(f"record {now} is incomplete")
            done.extend([(row["record"], "response", row["target"], row["size"], running.hexdigest(), None)] * row["times"])

        for batch in batches:
            names = ("name", "record_id", "segment", "target", "declared", "payload_length", "running", "body")
            for name, record, segment, target, declared, length, state, body in zip(*(batch.column(c).to_pylist() for c in names)):
                if name != now:
                    if now is not None:
                        close()
                    now, running = name, hashlib.sha256()
                    row = {"record": record, "target": target, "declared": declared, "length": length, "size": 0, "times": 0, "segment": 0}
                row["times"] += segment == 1
                if segment == row["segment"]:
                    continue  # a repeated row has written the same segments again
                raw = body.encode()
                running.update(raw)
                row["size"] += len(raw)
                if segment != row["segment"] + 1 or running.hexdigest() != state:
                    raise ValueError(f"segment {segment} of record {name} does not follow")
                row["segment"] = segment
        if now is not None:
            close()
        names = ["record_id", "record_type", "target", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*done)) if done else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return long.repartition("name").sortWithinPartitions("name", "segment").mapInArrow(
        digests, "record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string")
