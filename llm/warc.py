"""WARC archives with a chunked record table.

Writing: a task walks through each payload in slices of ``chunk_bytes`` without
copying it, feeds incremental digests and hands out the chunk table: one row for
each record and chunk number, with the digest up to and including the chunk.
Each row becomes a WARC record of its own (first segment, then ``continuation``
records with segment numbers).  Spark's text sink writes the rows, so archives
land in any store Spark can write to; an archive holds the records of one input
partition and is one gzip stream.  Of equal payloads of at least ``min_revisit``
bytes the largest id is a response, the others are revisit records without payload.

Reading: lines end in CRLF and stream through the task in file order; a parser
takes payload bytes by Content-Length and feeds an incremental SHA-1, so neither
a file nor a record is ever held whole.  Records of any type and origin are read;
a digest or length that a foreign record does not declare is null or that of its
block.  Gzip files are not split; a plain archive that Spark splits into several
partitions (spark.sql.files.maxPartitionBytes), and one that ends inside a record,
raise an error instead of losing records.

Edge cases: a null payload is empty; a null id is written as a response that
nothing refers to; rows with equal id and payload are each a response; of equal
payloads the largest id wins ties; control characters and spaces in a URL are
percent-encoded, a null URL is left out; payloads of any length are chunked; an
empty table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import saved, shared_dir, table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


CHUNKS = "id long, url string, number int, last int, size long, body binary, running_digest string, digest string, key string, refers_to long"


def _chunked(chunk_bytes: int, bodies: bool):
    """The chunk table of rows(id, url, payload[, again]); without bodies only the first chunk of each record, for its digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.string()] * 3, pa.int64()]
        out: list[tuple] = []
        held = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        for b in batches:
            known = b.column("again").to_pylist() if "again" in b.schema.names else [None] * b.num_rows
            for id_, url, payload, again in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), known, strict=True):
                view = memoryview(payload.as_buffer())  # no copy
                sha, key, running = hashlib.sha1(), hashlib.sha256(), []
                for at in range(0, max(1, len(view)), chunk_bytes):
                    piece = view[at : at + chunk_bytes]
                    sha.update(piece)
                    key.update(piece)
                    running.append(sha.hexdigest())
                target = next((x["refers_to"] for x in again or () if x["digest"] == running[-1]), None)
                last = len(running) - 1 if target is None else 0
                for n in range(last + 1 if bodies else 1):
                    body = (bytes(view[n * chunk_bytes : (n + 1) * chunk_bytes]) if target is None else b"") if bodies else None
                    out.append((id_, url, n, last, len(view), body, running[n], running[-1], key.hexdigest(), target))
                    held += len(body or b"")
                    if held > 1 << 23 or len(out) >= 4000:
                        yield packed()
                        out, held = [], 0
        if out:
            yield packed()

    return run


def _payloads(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))


def chunk_table(rows: DataFrame, chunk_bytes: int = 1 << 16, bodies: bool = True) -> DataFrame:
    """id, url, number, last, size, body, running_digest, digest and key: a row for each chunk of rows(id, url, payload)."""
    return _payloads(rows).mapInArrow(_chunked(chunk_bytes, bodies), CHUNKS).drop("refers_to")


def revisits(heads: DataFrame, min_revisit: int) -> DataFrame:
    """revisit_id and again, the digests under which it repeats another record with that record's id, of heads(id, size, digest, key)."""
    long = heads.where((F.col("size") >= min_revisit) & F.col("id").isNotNull()).select("id", "digest", "key")
    keep = long.groupBy("key").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to").select(F.col("key").alias("of"), "refers_to")
    found = long.join(keep, F.col("key") == F.col("of")).where("id < refers_to").groupBy(F.col("id").alias("revisit_id")).agg(F.collect_set(F.struct("digest", "refers_to")).alias("again"))
    return saved(found, "revisits")  # narrow; its size is known to the planner from here on


def write_warc(rows: DataFrame, path: str, chunk_bytes: int = 1 << 16, min_revisit: int = 1000) -> None:
    """Write rows(id long, url string, payload binary) as gzipped WARC files under path."""
    heads = saved(chunk_table(rows, chunk_bytes, bodies=False).select("id", "size", "digest", "key"), "heads")
    again = revisits(heads, min_revisit)
    known = _payloads(rows).join(again, F.col("id") == F.col("revisit_id"), "left").select("id", "url", "payload", "again")
    parts = known.mapInArrow(_chunked(chunk_bytes, True), CHUNKS)  # the chunks of a record stay together
    name = F.coalesce(F.concat(F.lit("urn:record:"), F.col("id")), F.lit("urn:record:null"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def line(key: str, value, when=None):
        text = F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    first, revisit, cut = F.col("number") == 0, F.col("refers_to").isNotNull(), F.col("last") > 0
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise("continuation")),
        line("WARC-Record-ID", F.concat(F.lit("<"), name, F.when(first, "").otherwise(F.concat(F.lit("/"), (F.col("number") + 1).cast("string"))), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url, first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">")), revisit),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("X-Payload-Length", F.col("size").cast("string"), revisit),
        line("WARC-Segment-Number", (F.col("number") + 1).cast("string"), cut),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), name, F.lit(">")), ~first),
        line("WARC-Segment-Total-Length", F.col("size").cast("string"), cut & (F.col("number") == F.col("last"))),
        line("Content-Type", F.lit("text/html"), first),
        line("Content-Length", F.length("body").cast("string")),
    )
    record = F.concat(head, F.lit(CRLF), F.col("body").cast("string"), F.lit(CRLF))  # the sink adds the second CRLF
    parts.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class Parser:
    """Feed lines without their CRLF; yields (header, payload piece, whether the record ends)."""

    def __init__(self) -> None:
        self.header: dict[bytes, bytes] | None = None
        self.left = -1
        self.tail = False

    def feed(self, line: bytes) -> tuple[dict[bytes, bytes], bytes, bool] | None:
        if self.left >= 0:  # in a payload
            piece = line if len(line) == self.left else line + b"\r\n"
            self.left -= len(piece)
            if self.left < 0:
                raise ValueError("a payload does not end where Content-Length says")
            if len(piece) == len(line):
                header, self.header, self.left, self.tail = self.header, None, -1, True
                return header, piece, True
            return self.header, piece, False
        if self.tail:  # the empty line after a record
            if line:
                raise ValueError("no empty line after a record")
            self.tail = False
        elif self.header is None:
            if not line.startswith(b"WARC/1."):
                raise ValueError("no WARC record where one should begin")
            self.header = {}
        elif line:
            key, _, value = line.partition(b":")
            self.header[key.strip().lower()] = value.strip()
        else:
            self.left = int(self.header.get(b"content-length", b"0"))
        return None

    def close(self) -> None:
        if self.header is not None:
            raise ValueError("the archive ends inside a record")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield from b.column(0).slice(i, 512).cast(pa.binary()).to_pylist()


def _text(value: bytes | None) -> str | None:
    return value.decode("utf-8", "replace") if value is not None else None


def _urn(value: bytes | None) -> str | None:
    return _text(value).strip("<>") if value is not None else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    parser, sha, size, head = Parser(), hashlib.sha1(), 0, {}
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "declared_digest"]
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for line in _lines(batches):
        if (got := parser.feed(line)) is None:
            continue
        header, piece, ends = got
        if header.get(b"warc-type") != b"continuation" and (head is not header):
            sha, size, head = hashlib.sha1(), 0, header
        sha.update(piece)  # the digest runs on over the chunks of a record
        size += len(piece)
        whole = b"warc-segment-number" not in header or b"warc-segment-total-length" in header
        if ends and whole:
            declared = _text(head.get(b"warc-payload-digest"))
            declared = declared.removeprefix("sha1:") if declared is not None else None
            revisit = head.get(b"warc-type") == b"revisit"
            length = head.get(b"x-payload-length")  # only known of revisits that this module wrote
            bytes_of = (int(length) if length is not None else None) if revisit else size
            rows.append((_urn(head.get(b"warc-record-id")), _text(head.get(b"warc-type")), _text(head.get(b"warc-target-uri")), _urn(head.get(b"warc-refers-to")), bytes_of, declared if revisit else sha.hexdigest(), declared))
            if len(rows) >= 2000:
                yield packed()
                rows = []
    parser.close()
    if rows:
        yield packed()


def _read_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    parser, sha, head, buffer, number, held = Parser(), hashlib.sha1(), {}, [], 0, 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["record_id", "chunk_no", "chunk", "running_digest"])

    for line in _lines(batches):
        if (got := parser.feed(line)) is None:
            continue
        header, piece, ends = got
        if header.get(b"warc-type") != b"continuation" and head is not header:
            sha, head, number = hashlib.sha1(), header, 0
        buffer.append(piece)
        held += len(piece)
        if ends or held >= chunk_bytes:  # a foreign record of any length is cut, too
            body = b"".join(buffer)
            at = 0
            while at < len(body) or (ends and at == 0):
                if len(body) - at < chunk_bytes and not ends:
                    break
                sha.update(body[at : at + chunk_bytes])
                rows.append((_urn(head.get(b"warc-record-id")), number, body[at : at + chunk_bytes], sha.hexdigest()))
                number, at = number + 1, at + chunk_bytes
            buffer = [body[at:]] if at < len(body) else []
            held = len(body) - at if at < len(body) else 0
            if sum(len(r[2]) for r in rows) > 1 << 22 or len(rows) >= 2000:
                yield packed()
                rows = []
    parser.close()
    if rows:
        yield packed()


def _archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string").option("lineSep", CRLF).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path, digests recomputed from the payload."""
    return _archive(spark, path).mapInArrow(_records, "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, declared_digest string")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = 1 << 16) -> DataFrame:
    """The chunk table: record_id, chunk_no, chunk and the SHA-1 of the payload up to and including it."""
    return _archive(spark, path).mapInArrow(lambda batches: _read_chunks(batches, chunk_bytes), "record_id string, chunk_no int, chunk binary, running_digest string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages.select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload")), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) AS BIGINT)")  # noqa: E731  after "urn:record:"
    return read_records(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, strlen(html)::BIGINT AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM k
"""
