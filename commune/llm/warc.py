"""WARC archives: a deduplicating writer and a splittable reader.

Writer. Every row becomes one WARC record in one gzip member. Of rows with equal payloads of
at least ``min_revisit`` bytes, the one with the smallest id is written in full (``response``),
the others as ``revisit`` records that name it; only payload digests are grouped and joined.
Spark's text writer commits the files, so the archives can be in any store Spark writes to and
survive lost tasks. That writer puts a separator after every row: a member is cut where its
gzip header has a zero byte anyway (the end of the file name field), the separator is that
byte, and the one after the last row is zero padding, which the gzip format allows. The files
are plain multi-member gzip files.

Reader. Tasks scan byte ranges of the archives for gzip's magic bytes (Spark's splittable text
scan with the magic as record separator; a range owns what starts inside it, and reads on past
its end). Magic bytes can occur inside compressed data. A candidate is a member if its header
and the start of its content decode as a WARC record; a member that isn't complete at the next
candidate goes on through it. A member whose rest belongs to the next range, which happens
only where false magic bytes lie at a boundary, is put together in a small second step. Archives
must not have names ending in .gz: Spark would unpack such a file whole instead of splitting it.

Defined results: a null payload is empty; an empty payload, and any below ``min_revisit``
bytes, is a response. Rows that repeat an id with the same payload are all responses if the id
is the smallest. A null id is written as an empty id, read back as null, never chosen as the
smallest while there is another, and a response if all ids of its payload are null. An empty
table gives empty archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.llm.common import cut, scratch_path, table

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
#: gzip header after the magic: flags (file name follows), no time, no extra flags, unknown system.
_HEADER = MAGIC + b"\x08\x00\x00\x00\x00\x00\xff"
_LATIN = {"encoding": "ISO-8859-1"}
_FIELDS = re.compile(rb"([A-Za-z-]+): (.*)\r\n")
_DATE = "2000-01-01T00:00:00Z"


def record(page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {re.sub('[\r\n]', ' ', uri)}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "".join(h + "\r\n" for h in head).encode("utf-8") + b"\r\n" + body + b"\r\n\r\n"


def _writer(level: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = b""
        name = b"record.warc"
        begun = False
        for b in batches:
            out = []
            for page_id, uri, payload, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = record(page_id, uri, payload, digest, refers_to)
                z = zlib.compressobj(level, zlib.DEFLATED, -15)
                out.append(rest + _HEADER + name)
                rest = z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([rest], pa.binary())], ["value"])

    return rows


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   min_revisit: int = MIN_REVISIT, level: int = 1, max_records: int = 0) -> None:
    """Write ``pages`` as WARC files below ``path``, about as many as ``pages`` has partitions."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        body.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2(F.col("payload"), 256).alias("digest"))
    # Digests that occur more than once, with the id that the others refer to.
    firsts = cut(rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
                 .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select("digest", "first"))
    joined = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    members = joined.mapInArrow(_writer(level), "value binary")
    (members.select(F.col("value").cast("string").alias("value")).write.options(**_LATIN)
     .option("lineSep", "\x00").option("compression", "none").text(path))


def _open_member(chunk: bytes):
    """The decompressor and text so far if ``chunk`` (after the magic) starts a WARC member."""
    if len(chunk) < 7 or chunk[0] & 0xE0:
        return None
    z = zlib.decompressobj(31)
    try:
        data = z.decompress(MAGIC + chunk)
    except zlib.error:
        return None
    return (z, data) if data[:5] == b"WARC/" or (not z.eof and b"WARC/".startswith(data[:5])) else None


def parse_record(data: bytes) -> tuple:
    """(page_id, uri, payload, type, refers_to, declared digest, declared length) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELDS.findall(head + b"\r\n")}
    payload = rest[:int(f["content-length"])]
    number = lambda s: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", s)) else None
    return (number(f.get("warc-record-id", "")), f.get("warc-target-uri", ""), payload, f.get("warc-type", ""),
            number(f.get("warc-refers-to", "")), f.get("warc-payload-digest", "").removeprefix("sha256:"),
            int(f.get("warc-payload-length", len(payload))))


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()),
                   ("length", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("piece", pa.string()),
                   ("bytes", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _READ]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _READ)], schema=_READ)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each byte range; ``piece`` marks what other ranges need: 'open' or 'loose'.

    'loose' is what lies in a range before its first member: the rest of the range before's
    last member, if that one is 'open' (incomplete at its end).
    """
    none = (None,) * 7
    at, member, raw = None, None, b""

    def done(m) -> tuple:
        return (*parse_record(m[1]), None, None, None, None)

    for b in batches:
        out = []
        for chunk, file, start in zip(*(b.column(i).to_pylist() for i in range(3))):
            fresh = (file, start) != at
            if fresh:
                if member:
                    out.append((*none, *at, "open", raw))
                at, member, raw, first, before = (file, start), None, b"", True, False
            # What lies before a file's first magic: nothing.
            if first and start == 0:
                first = False
                if chunk:
                    raise ValueError(f"{file}: bytes before the first member")
                continue
            first = False
            if member and not before and len(member[1]) < 5 and (_open_member(chunk) or (0, b""))[1]:
                # A range's first candidate that showed nothing, before one that shows a record.
                out.append((*none, *at, "loose", raw))
                member = None
            if member:
                try:
                    member = (member[0], member[1] + member[0].decompress(MAGIC + chunk))
                    raw += MAGIC + chunk
                except zlib.error:
                    # A tentative candidate that showed nothing yet was no member after all.
                    if before or len(member[1]) >= 5:
                        raise
                    out.append((*none, *at, "loose", raw))
                    member = None
            if not member:
                if opened := _open_member(chunk):
                    member, raw = opened, MAGIC + chunk
                elif before:
                    raise ValueError(f"{file}: bytes that are no WARC member after offset {start}")
                else:
                    out.append((*none, *at, "loose", MAGIC + chunk))
                    continue
            before = before or len(member[1]) >= 5
            if member[0].eof:
                if member[0].unused_data.strip(b"\x00"):
                    raise ValueError(f"{file}: bytes between members after offset {start}")
                out.append(done(member))
                member, raw = None, b""
        yield _batch(out)
    if member:
        yield _batch([(*none, *at, "open", raw)])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that run over the end of their range, from one file's sorted pieces."""
    held, file = b"", None
    for b in batches:
        out = []
        for f, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            if f != file:
                held, file = b"", f
            # A piece goes on with what is held if that decodes; else a new member starts with it.
            for trial in (held + data, data) if held else (data,):
                try:
                    z = zlib.decompressobj(31)
                    text = z.decompress(trial)
                except zlib.error:
                    continue
                held = trial
                break
            else:
                raise ValueError(f"{f}: bytes that are no WARC member")
            if z.eof:
                out.append((*parse_record(text), None, None, None, None))
                held = b""
        yield _batch(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to, digest, length) of every record below ``path``."""
    schema = ", ".join(f"{f.name} {t}" for f, t in zip(_READ, (
        "bigint string binary string bigint string bigint string bigint string binary").split()))
    chunks = (spark.read.options(**_LATIN).option("lineSep", MAGIC.decode("latin-1")).text(path)
              .select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start"))
    scanned = chunks.mapInArrow(_scan, schema)
    return scanned


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, those across byte ranges included."""
    scanned = read_archives(spark, path)
    whole = scanned.where("piece IS NULL")
    pieces = cut(scanned.where("piece IS NOT NULL").select("file", "start", "piece", "bytes",
                                                           F.monotonically_increasing_id().alias("seq")))
    columns = ["page_id", "url", "payload", "record_type", "refers_to", "digest", "length"]
    if pieces.isEmpty():
        return whole.select(*columns)
    rest = (pieces.repartition("file").sortWithinPartitions("file", "start", "seq").select("file", "piece", "bytes")
            .mapInArrow(_stitch, scanned.schema))
    return whole.unionByName(rest).select(*columns)


def digest_rows(recs: DataFrame) -> DataFrame:
    """Payload length and digest of each record: computed for payloads that are there, else as declared."""
    full = F.col("record_type") == "response"
    return recs.select(
        "page_id", F.when(full, F.octet_length("payload")).otherwise(F.col("length")).cast("bigint")
        .alias("payload_bytes"),
        F.when(full, F.sha2(F.col("payload"), 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return digest_rows(records(spark, path))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f
  FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM r
"""
