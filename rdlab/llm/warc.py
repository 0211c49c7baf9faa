"""WARC archives: write records, read them back, salvage what can be read from damaged files.

Archives are written by Spark's text writer, a gzip member for each record. The last byte of a member is 0 as long as the
record has less than 16 MiB, so it is the line separator; larger records are plain, and end with two line ends as theirs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rdlab.llm.common import written

END = "\r\n\r\n"
MEMBER_BYTES = 1 << 24  #: members of fewer bytes before compression end in a byte 0
_START = re.compile(rb"WARC/\d\.\d\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_GZIP, _STOP = re.compile(re.escape(_MEMBER)), re.compile(rb"\r?\n\r?\n")
READ = "file string, offset long, length long, kind string, headers map<string,string>, payload binary, reason string"


def base32_sha1(data: str | Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes, without padding; null stays null."""
    return base32_of(F.sha1(data))


def base32_of(sha1: Column) -> Column:
    """The same of a SHA-1 in hexadecimal."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    # lambda variables hold the hash and its bits, which are else computed again for each digit
    bits = F.transform(F.array(sha1), lambda h: F.concat(*[F.lpad(F.conv(F.substring(h, i, 10), 16, 2), 40, "0") for i in (1, 11, 21, 31)]))
    out = F.transform(bits, lambda x: F.concat(*[F.substring(digits, F.conv(F.substring(x, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]))
    return F.get(out, 0)


def with_revisits(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """df with digest, record_type, refers_to (replacing columns so named): of rows with equal payloads of at least min_bytes bytes that with the largest id is the response, the others revisit it.

    A null payload is empty. Rows with a null id, and rows that repeat the response's id, are responses. Equal payloads meet
    by their ids and hashes alone; payloads move once, dealt by id and hash, so that copies of one payload spread.
    """
    body = F.coalesce(F.col(payload_col), F.lit("").cast("binary"))
    narrow = df.select(F.col(id_col).alias("id"), F.octet_length(body).alias("size"), F.unhex(F.sha1(body)).alias("sha")).where(F.col("size") >= min_bytes).select("id", "sha")
    narrow = written(narrow, "hashes")
    # written, so that the join with a hash that many rows have can be split, and what follows reads it as often as it likes
    last = written(narrow.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("m")).where("m > 1").select("sha", "last"), "last")
    old = written(narrow.join(last, "sha").where("id < last").select("id", "sha", "last").distinct(), "older")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("own"), F.sha1(body).alias("hex"), (F.octet_length(body) >= min_bytes).alias("large"))
    both = rows.join(old, (rows["own"] == old["id"]) & (F.unhex("hex") == old["sha"]) & F.col("large"), "left")
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("digest", "record_type", "refers_to")]
    kind = F.when(F.col("last").isNotNull(), "revisit").otherwise("response")
    return both.select(*own, base32_of(F.col("hex")).alias("digest"), kind.alias("record_type"), F.col("last").alias("refers_to"))


def record_text(id_col: Column, url: Column, payload: Column, digest: Column, kind: Column, refers_to: Column) -> Column:
    """A WARC/1.1 record without its final line ends: an HTTP response block; a revisit has its headers only."""
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(kind == "revisit", 0).otherwise(size)
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    name = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), name(id_col)), F.concat(F.lit("WARC-Target-URI: "), clean), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest), F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: "), name(refers_to)), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(head, F.lit(END), http, F.when(kind == "revisit", F.lit("")).otherwise(payload.cast("string")))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record with its end as a gzip member without its last byte, which is 0."""
    for b in batches:
        out = []
        for x in b.column("value"):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append((z.compress(x.as_py() + END.encode()) + z.flush())[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload", min_bytes: int = 0, per_file: int = 4096, file_bytes: int = 64 << 20) -> None:
    """Write a record for each row into archives under path, of at most per_file records and about file_bytes bytes before compression (or one record).

    An id that is null gives a record without a WARC-Record-ID. Large records go to archives of fewer records; an empty table gives an empty archive.
    """
    given = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("").cast("binary")).alias("payload"))
    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) + 1024  # more than the record has
    steps = [max(1, per_file >> k) for k in (0, 4, 8, 12)]
    tier = F.lit(len(steps))
    for i in reversed(range(len(steps))):
        tier = F.when(size < (MEMBER_BYTES if steps[i] == 1 else min(file_bytes // steps[i], MEMBER_BYTES)), i).otherwise(tier)
    rows = with_revisits(given, "id", "payload", min_bytes)
    text = record_text(*[F.col(c) for c in ("id", "url", "payload", "digest", "record_type", "refers_to")]).alias("value")
    used = given.agg(F.collect_set(tier)).first()[0] or [0]
    for i in sorted(used):
        out = (rows.where(tier == i) if len(used) > 1 else rows).select(text)
        if i < len(steps):
            out = out.select(F.col("value").cast("binary")).mapInArrow(_zipped, "value binary").select(F.col("value").cast("string"))
        out.write.option("lineSep", "\0" if i < len(steps) else END).option("maxRecordsPerFile", steps[i] if i < len(steps) else 1).text(f"{path}/tier-{i}")


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out.setdefault(k.strip().decode("utf-8", "replace").lower(), v.strip().decode("utf-8", "replace"))
    return out


class _Marks:
    """The next place of a pattern at or behind a place that only grows: each byte is searched once, however often it is asked for."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern, self.found = data, pattern, pattern.search(data)

    def at(self, place: int) -> re.Match | None:
        if self.found and self.found.start() < place:
            self.found = self.pattern.search(self.data, place)
        return self.found


def _record(data: bytes, at: int, stops: _Marks, last: bool = False) -> tuple[int, dict[str, str], bytes] | str:
    """(end, headers, payload) of the plain record at a place, or why it can't be taken. With `last` a record up to the very end of data may lack its line ends."""
    m = _START.match(data, at)
    if not m:
        return "no version line"
    stop = stops.at(m.end() - 1)
    if not stop:
        return "no end of headers"
    head = _headers(data[m.end() : stop.start()])
    size = head.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    end = stop.end() + int(size)
    if end > len(data):
        return "cut short"
    ends = 4 if data[end : end + 4] == END.encode() else 2 if data[end : end + 2] == b"\n\n" else 0
    if not ends and not (last and end == len(data)):
        return "no end of record"
    block = data[stop.end() : end]
    if head.get("content-type", "").startswith("application/http"):
        first, gap, body = block.partition(b"\r\n\r\n")
        if not gap:
            return "no end of HTTP headers"
        head |= {f"http:{k}": v for k, v in _headers(first).items()}
        block = body
    said = head.get("warc-payload-digest", "")
    if said.lower().startswith("sha1:") and head.get("warc-type") != "revisit":
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != said[5:].upper():
            return "wrong digest"
    return end + ends, head, block


def _member(data: bytes, at: int) -> tuple[int, bytes] | str:
    """(end, content) of the gzip member at a place, or why it can't be taken. It is read in pieces, so that many members take linear time."""
    z, view, out, step = zlib.decompressobj(31), memoryview(data), [], 1 << 16
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + step]))
            at = min(at + step, len(data))
        out.append(z.flush())
    except zlib.error as e:
        return f"bad member: {e}"
    return (at - len(z.unused_data), b"".join(out)) if z.eof else "member cut short"


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, str, dict[str, str] | None, bytes | None, str | None]]:
    """(offset, length, kind, headers, payload, reason): records in order, and a row of kind gap for each run of bytes that was given up.

    A record that fails a check (version line, lengths, line ends, payload digest, gzip checksum) is left, and the
    search goes on at the next version line or gzip member behind its first byte. A member may hold several
    records, searched in the same way: its records and gaps all have its offset, the first of them its length, the
    others length 0. Lines and records may end in LF alone. A member without any record is a gap; only its last record may lack its line ends. With members false no gzip
    members are looked for: data is the content of one. Data without a byte gives no row.
    """
    at, gap, why, n = 0, None, "", len(data)
    starts, zipped, stops = _Marks(data, _START), _Marks(data, _GZIP), _Marks(data, _STOP)
    while at < n:
        got: str | Iterator = "no record"
        end = None
        if members and data.startswith(_MEMBER, at):
            m = _member(data, at)
            if isinstance(m, str):
                got = m
            else:
                end = m[0]
                inner, early = salvage(m[1], False), []
                for x in inner:
                    early.append(x)
                    if x[2] == "record":
                        got = ((at, 0 if i else end - at, *x[2:]) for i, x in enumerate(chain(early, inner)))
                        break
                else:
                    got = early[0][5] if early else "empty member"
        elif data.startswith(b"WARC/", at):
            r = _record(data, at, stops, not members)
            if isinstance(r, str):
                got = r
            else:
                end = r[0]
                got = iter([(at, end - at, "record", r[1], r[2], None)])
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            if end is None:
                end = min([m.start() for m in (starts.at(at + 1), zipped.at(at + 1) if members else None) if m], default=n)
            at = end
            continue
        if gap is not None:
            yield gap, at - gap, "gap", None, None, why
            gap = None
        yield from got
        at = end
    if gap is not None:
        yield gap, n - gap, "gap", None, None, why


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of READ from all archives under path: records, and quarantined gaps with the reason. An empty archive gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for x in salvage(data.as_py()):
                    rows.append((name, *x))
                    size += max(x[1], len(x[4] or b""))
                    if size > 8_000_000:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, READ)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    columns = [*zip(*rows, strict=True)]
    columns[4] = [None if x is None else [*x.items()] for x in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "offset", "length", "kind", "headers", "payload", "reason"])
