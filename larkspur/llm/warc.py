"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The reader checks every member (gzip checksum, record syntax, block length,
block and payload digests). After a failed check it searches for the next gzip
member or version line that passes, goes on from there and reports the bytes
between as a quarantined gap. Within a decompressed member it does the same, so
records before and after a bad one, and those of a member that is cut short, are
kept.

Archives are rows (path, content), as Spark's binaryFile source gives them, or
(path, part, content) with an archive in pieces; so they may come from any store
that Spark reads. A task holds a piece and a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, materialize

#: Archives end at the first record beyond this size.
ARCHIVE_BYTES = 4 << 20
#: Parts of a group of equal payloads that are reduced on their own first.
SALTS = 64
RECORD_ID = "urn:page:"
#: Longest head of a record, and longest record; a head that asks for more is damaged.
HEAD_BYTES, RECORD_BYTES = 1 << 20, 1 << 30
#: Bytes that are decompressed at once, and bytes of an archive that are kept to search again when a member turns out to be damaged.
STEP, BACK_BYTES = 1 << 16, 16 << 20
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORDS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("inner_length", pa.int64()), ("reason", pa.string()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
RECORDS_DDL = (
    "path string, kind string, offset long, length long, inner long, inner_length long, reason string, record_type string, record_id string, "
    "headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, dated `date`; a revisit has no block and names the full payload's length and digest. Line breaks in a URL are percent-coded; a null URL or id has no header."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<{RECORD_ID}{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            head.append(("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>"))
    head += [("Content-Type", "text/html"), ("Content-Length", "0" if revisit else str(len(payload)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_responses(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to and revisit: the row of the largest page_id of equal payloads is the response.

    Payloads below min_revisit_bytes are all responses. A group of copies is
    reduced in SALTS parts, so that no task gets a hot group whole. Repeated
    rows of the largest id are all responses; null ids are never the largest
    unless all are null, and then all are responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("_digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    parts = p.groupBy("_digest", "_salt").agg(F.max("page_id").alias("_most"))
    winners = parts.groupBy("_digest").agg(F.max("_most").alias("_winner"))
    p = p.join(parts.join(winners, "_digest").select("_digest", "_salt", "_winner"), ["_digest", "_salt"])
    small = F.octet_length("html") < min_revisit_bytes
    revisit = ~small & F.col("_winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_winner"))
    return p.select("page_id", "url", "html", F.when(revisit, F.col("_winner")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, compress: bool = True, date: str | None = None) -> DataFrame:
    """Archives (path, content) of the rows of with_responses, each of about ARCHIVE_BYTES, a record longer than that alone counted.

    Records are dated `date` (UTC, ISO 8601), or now. An empty table makes no
    archive; repeated and equal rows are records of their own; pages are written whole.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            name = f"part-{part:05d}-{n:05d}.warc" + ".gz" * compress
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for b in batches:
            for page_id, url, html, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                data = record(page_id, url, html.encode(), refers_to, revisit, date)
                parts.append(member(data) if compress else data)
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    n, parts, size = n + 1, [], 0
        if parts:
            yield archive()

    return bound_batches(records).mapInArrow(pack, "path string, content binary")


class Pieces:
    """Bytes that come in pieces, at absolute positions; only those not yet dropped are held."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.data, self.base, self.ended = iter(pieces), b"", 0, False

    def need(self, upto: int) -> bool:
        """Loads pieces up to a position; whether there are so many bytes."""
        more, have = [], self.base + len(self.data)
        while have < upto and not self.ended:
            piece = next(self.pieces, None)
            if piece is None:
                self.ended = True
            else:
                more.append(piece)
                have += len(piece)
        if more:
            self.data = b"".join([self.data, *more])
        return have >= upto

    def get(self, start: int, end: int) -> bytes:
        self.need(end)
        return self.data[start - self.base : end - self.base]

    def drop(self, upto: int) -> None:
        """Forgets what is before a position, once that is worth a copy."""
        if upto - self.base > max(STEP, len(self.data) // 2):
            self.data, self.base = self.data[upto - self.base :], upto

    def find(self, what: bytes, start: int, limit: int) -> int:
        """The first place of `what` in [start, start + limit), or -1."""
        size = STEP
        while True:
            enough = self.need(start + min(size, limit))
            at = self.data.find(what, start - self.base, start - self.base + min(size, limit))
            if at >= 0 or not enough or size >= limit:
                return at + self.base if at >= 0 else -1
            size *= 4

    def search(self, pattern: re.Pattern, start: int) -> int | None:
        """The first match from start on; what lies before it is forgotten as it goes."""
        while self.need(start + 1):
            self.need(start + STEP)
            found = pattern.search(self.data, start - self.base)
            if found:
                return found.start() + self.base
            start = max(start, self.base + len(self.data) - 16)  # longer than any start
            self.drop(start)
            if not self.need(self.base + len(self.data) + 1):
                return None
        return None


def _matches(want: str, data: bytes) -> bool:
    """Whether a digest as headers have it (algorithm:base32 or hex) is that of data; other algorithms aren't checked."""
    algorithm, _, value = want.partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5"):
        return True
    got = hashlib.new(algorithm.lower(), data).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(got).decode().rstrip("="), got.hex().upper())


def payload_of(headers: dict, block: bytes) -> bytes:
    """What the payload digest covers: of an HTTP message what follows its head, else the block."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block
    ends = [(at, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (at := block.find(x)) >= 0]
    return block[sum(min(ends)) :] if ends else b""


def _record(source: Pieces, at: int) -> tuple[dict, bytes, int] | str:
    """(headers with lower-case names, payload, end) of the record at `at`, or what is wrong."""
    source.need(at + 10)
    if not VERSION.match(source.data, at - source.base) or (end := source.find(b"\r\n\r\n", at, HEAD_BYTES)) < 0:
        return "header"
    try:
        lines = [(k.strip().lower(), v.strip()) for k, v in (line.split(":", 1) for line in source.get(at, end).decode().split("\r\n")[1:])]
        headers = dict(lines)
        if len(headers) < len(lines) and len({k for k, _ in lines if k != "warc-concurrent-to"}) < sum(k != "warc-concurrent-to" for k, _ in lines):
            return "header"  # two records run into each other
        length = int(headers["content-length"])
    except (ValueError, KeyError):
        return "header"
    if not 0 <= length <= RECORD_BYTES or not source.need(end + 8 + length) or source.get(end + 4 + length, end + 8 + length) != b"\r\n\r\n":
        return "length"
    block = source.get(end + 4, end + 4 + length)
    whole, part = headers.get("warc-block-digest"), headers.get("warc-payload-digest")
    payload = payload_of(headers, block)
    if whole is not None:
        if not _matches(whole, block):
            return "digest"
    elif part is not None and headers.get("warc-type") != "revisit" and not _matches(part, payload):
        return "digest"
    return headers, payload, end + 8 + length


class _Member:
    """The content of the gzip member at a position; `end` is set once it has passed its checksum. `position`: where its last piece began."""

    def __init__(self, source: Pieces, at: int):
        self.source, self.position, self.end = source, at, None
        self.content = Pieces(self._decompressed())

    def _decompressed(self) -> Iterator[bytes]:
        z, at = zlib.decompressobj(31), self.position
        while not z.eof:
            self.source.drop(at - BACK_BYTES)
            piece = self.source.get(at, at + STEP)
            if not piece:
                return
            self.position, before, left = at, z.copy(), piece
            at += len(piece)
            try:
                while left and not z.eof:
                    out, left = z.decompress(left, 16 * STEP), z.unconsumed_tail
                    if out:
                        yield out
                        before = None
            except zlib.error:
                for i in range(0, len(piece) if before else 0, 64):  # what comes before the fault, in small steps
                    try:
                        out = before.decompress(piece[i : i + 64])
                    except zlib.error:
                        break
                    if out:
                        yield out
                return
        self.end = at - len(z.unused_data)


def _member_rows(member: _Member) -> Iterator[tuple]:
    """(kind, inner, inner_length, reason, headers, payload) of a member's records and gaps."""
    source, at, gap, reason = member.content, 0, 0, None
    while source.need(at + 1):
        got = _record(source, at)
        if not isinstance(got, str):
            headers, payload, end = got
            if gap < at:
                yield "gap", gap, at - gap, reason, None, None
            yield "record", at, end - at, None, headers, payload
            at = gap = end
            reason = None
            source.drop(at)
            continue
        reason = reason or got
        following = source.search(VERSION, at + 1)
        at = following if following is not None else source.base + len(source.data)
    if gap < at:
        yield "gap", gap, at - gap, reason or "syntax", None, None


def salvage(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    """(kind, offset, length, reason, headers, payload, inner, inner_length) of an archive's records and gaps, in order, without overlap.

    offset and length are of the archive's bytes; inner and inner_length are a
    record's place in the content of its gzip member, null elsewhere. A member's
    bytes count with the last of its records; a gap inside a sound member has
    none. The records of a damaged member have none either, and a gap from its
    beginning to the next start that passes follows them.
    """
    source = Pieces([data] if isinstance(data, bytes) else data)
    at = gap = 0
    reason = None
    while source.need(at + 1):
        source.need(at + 10)
        again = at + 1
        if START.match(source.data, at - source.base):
            if source.get(at, at + 2) == b"\x1f\x8b":
                member, held, sound, again = _Member(source, at), None, False, at + 1
                for kind, inner, size, why, headers, payload in _member_rows(member):
                    if kind == "record" and gap < at:
                        yield "gap", gap, at - gap, reason or "syntax", None, None, None, None
                        gap, reason = at, None
                    if held is not None:
                        yield held
                    held = (kind, at, 0, why, headers, payload, inner, size)
                    if kind == "record":
                        sound, again = True, max(again, member.position)
                ok = member.end is not None and sound
                if ok:
                    if gap < at:
                        yield "gap", gap, at - gap, reason or "syntax", None, None, None, None
                    yield (held[0], at, member.end - at, *held[3:])
                    at = gap = member.end
                    reason = None
                    source.drop(at)
                    continue
                if held is not None and sound and held[0] == "record":
                    yield held
                reason = reason or ("gzip" if member.end is None else held[3] if held else "syntax")
            else:
                got = _record(source, at)
                if not isinstance(got, str):
                    headers, payload, end = got
                    if gap < at:
                        yield "gap", gap, at - gap, reason or "syntax", None, None, None, None
                    yield "record", at, end - at, None, headers, payload, None, None
                    at = gap = end
                    reason = None
                    source.drop(at)
                    continue
                reason = reason or got
        reason = reason or "syntax"
        following = source.search(START, max(again, source.base))
        at = following if following is not None else source.base + len(source.data)
    if gap < at:
        yield "gap", gap, at - gap, reason or "syntax", None, None, None, None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives (path, content), as in RECORDS_DDL; see salvage.

    With a column `part`, rows of a path are its pieces in that order, and a
    record may pass from one to the next; else each row is an archive, equal
    ones too. kind is record or gap; a gap has its place and reason only. Null
    or empty content has no rows. payload_bytes and payload_digest are of the
    payload, or of a revisit as its headers say. A record of more than
    RECORD_BYTES is quarantined. Other columns are dropped.
    """
    parts = "part" in archives.columns

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, bytes]]:
        n = 0
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                n += 1
                yield (path if parts else n), path, content.as_py() or b""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(contents(batches), lambda x: x[0]):
            first = next(pieces)
            path, rows, size = first[1], [], 0
            chain = (content for _, _, content in [first, *pieces]) if not parts else (content for x in ((first,), pieces) for _, _, content in x)
            for kind, offset, length, reason, headers, payload, inner, inner_length in salvage(chain):
                row = {"path": path, "kind": kind, "offset": offset, "length": length, "inner": inner, "inner_length": inner_length, "reason": reason}
                if headers is not None:
                    revisit = headers.get("warc-type") == "revisit"
                    row |= {
                        "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "headers": list(headers.items()),
                        "payload_bytes": int(headers.get("x-payload-length", 0)) if revisit else len(payload),
                        "payload_digest": headers.get("warc-payload-digest", "")[5:] if revisit else digest(payload),
                        "payload": payload if payloads else None,
                    }
                    size += len(payload) if payloads else 0
                rows.append(row)
                if len(rows) >= 2000 or size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    source = archives.repartition("path").sortWithinPartitions("path", "part") if parts else archives
    return bound_batches(source).select("path", "content").mapInArrow(read, RECORDS_DDL)


def broken_off(archives: DataFrame, n_bytes: int = 100) -> DataFrame:
    """archives as a writer leaves them that broke off after n_bytes, began again, and broke off once more at the end: no record is lost."""
    start = F.substring("content", 1, n_bytes)
    return archives.withColumn("content", F.concat(start, F.col("content"), start))


def _id(c):
    return F.try_to_number(F.regexp_extract(c, rf"^<{RECORD_ID}(-?\d+)>$", 1), F.lit("S9999999999999999999")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, damages them without losing a record, reads them back with salvage and reports each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = materialize(write_archives(with_responses(pages)))
    back = read_archives(broken_off(archives), payloads=False).where("kind = 'record'")
    return back.select(
        _id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _id(F.coalesce(F.element_at("headers", "warc-refers-to"), F.lit(""))).alias("refers_to"),
    )


ORACLE_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT hex, max(page_id) AS winner FROM p GROUP BY hex),
bits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (CAST('0x' || substr(hex, 1 + CAST(floor(5 * i / 4) AS INTEGER), 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31), 1), '' ORDER BY i) AS b32
  FROM w, (SELECT CAST(range AS INTEGER) AS i FROM range(32)) GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = winner OR winner IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM p JOIN w USING (hex) JOIN bits USING (hex)"""
