"""Legacy ARC archives to WARC, and WARC written and read on a cluster.

The converter parses the version block and the header lines that its version declares, takes each record's
declared length, and synthesises what WARC asks for and ARC lacks: identifiers (from the address, the time and
the payload), ISO times, types and digests.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import stored
from halflife.sources.scratch import scratch_path

#: The header fields of ARC's two versions, as its version blocks list them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 100
#: Up to so many repeated payloads are broadcast; more are joined by a shuffle.
BROADCAST_PAYLOADS = 200_000
#: Compressed bytes of a WARC file; a reader loads a file whole.
FILE_BYTES = 32 << 20
#: Bytes of records that a worker passes on at once.
SENT = 8 << 20

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:halflife:arc-records")
_END = b"\r\n\r\n"
_BLANK = re.compile(rb"\n\r?\n")
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


class ArcError(ValueError):
    """The bytes are no ARC, end before a declared length, or have no date."""


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]

    @property
    def date(self) -> str:
        return self.fields["Archive-date"]


def arc_line(version: int, values: dict[str, str], content: bytes) -> bytes:
    """A record's header line; fields without a value are "-"."""
    values = values | {"Archive-length": str(len(content))}
    return (" ".join(values.get(f) or "-" for f in ARC_FIELDS[version]) + "\n").encode()


def write_arc(version: int, name: str, records) -> bytes:
    """An ARC of (values, content) pairs, version block first."""
    about = f"{version} 0 halflife\n{' '.join(ARC_FIELDS[version])}\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain"}
    return b"\n".join([arc_line(version, first, about) + about, *(arc_line(version, v, c) + c for v, c in records)]) + b"\n"


class _Stream:
    """Bytes that come in chunks, read by line or by length."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), b"", 0

    def _more(self, least: int = 0) -> bool:
        parts, size = [self.held[self.at :]], len(self.held) - self.at
        self.at, before = 0, size
        for chunk in self.chunks:
            parts.append(chunk)
            size += len(chunk)
            if size > before and size >= least:
                break
        self.held = b"".join(parts)
        return size > before

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the bytes."""
        searched = self.at
        while (end := self.held.find(b"\n", searched)) < 0:
            searched = len(self.held) - self.at
            # Twice as much each time, so that a long line is not copied for every chunk.
            if not self._more(2 * searched):
                if self.at >= len(self.held):
                    return None
                end = len(self.held)
                break
        out, self.at = self.held[self.at : end], end + 1
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more(n):
            pass
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def _header(line: bytes, version: int | None) -> dict[str, str] | None:
    """The fields of a header line, or None where the line is none: another number of fields, or a length that is no number."""
    parts = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
    names = ARC_FIELDS[version] if version else next((f for f in ARC_FIELDS.values() if len(f) == len(parts)), ())
    return dict(zip(names, parts, strict=True)) if len(parts) == len(names) and parts[-1].isascii() and parts[-1].isdigit() else None


def read_arc(chunks: Iterable[bytes], errors: list[str] | None = None) -> Iterator[ArcRecord]:
    """All records of an ARC that comes in chunks, the version block as the first; one record is held at a time.

    The first header line has the fields of version 1, or all ten; its block tells the version, whose fields the
    lines after it must have. Empty lines between records are passed over. Raises ArcError where a line has
    another number of fields, a length is no number, or the bytes end before it. With a list of errors only a broken
    start is raised: after a broken header line the next one that can be a header with a date goes on, and a record
    that ends early is left out; each is noted in the list.
    """
    stream, version, lost = _Stream(chunks), None, False
    while (line := stream.line()) is not None:
        if not line.strip(b"\r"):
            continue
        fields = _header(line, version)
        if lost and (fields is None or not (fields["Archive-date"].isdigit() and len(fields["Archive-date"]) == 14)):
            continue
        if fields is None:
            if errors is None or version is None:
                raise ArcError(f"bad header line {line[:80]!r}")
            errors.append(f"bad header line {line[:80]!r}")
            lost = True
            continue
        lost, length = False, int(fields["Archive-length"])
        content = stream.read(length)
        if len(content) < length:
            if errors is None or version is None:
                raise ArcError(f"{fields['URL']} ends early")
            errors.append(f"{fields['URL']} ends early")
            return
        if version is None:
            if not fields["URL"].startswith("filedesc://"):
                raise ArcError("no version block")
            number = content.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else None
            if version not in ARC_FIELDS:
                raise ArcError(f"unknown version {number[:20]!r}")
            if len(fields) != len(ARC_FIELDS[version]):
                fields = {f: fields.get(f, "-") for f in ARC_FIELDS[version]}
        yield ArcRecord(version, fields, content)
    if version is None:
        raise ArcError("empty archive")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """read_arc() of bytes."""
    return read_arc([data])


def iso_date(digits: str) -> str:
    """ARC's 14 digits, or the first of them, as WARC's time; what lacks is that of 1970-01-01. Raises ArcError for no date."""
    whole = "".join(c for c in digits if c != "-")[:14]
    try:
        then = datetime.strptime(whole + "19700101000000"[len(whole) :], "%Y%m%d%H%M%S")
    except ValueError:
        raise ArcError(f"no date: {digits!r}") from None
    return then.replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{url} {date} {digest}')}>"


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response, blank line included, and its payload; content of another kind is all payload.

    Lines end in CR LF or, as in many old archives, in LF alone; the head ends at the first empty line of either kind.
    """
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = _BLANK.search(content)
    return (content, b"") if end is None else (content[: end.end()], content[end.end() :])


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = [*headers.items(), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8", "surrogateescape") + block


def convert(record: ArcRecord, refers: tuple[str, str, dict[str, str]] | None = None) -> bytes:
    """The WARC record of an ARC record.

    The version block becomes a warcinfo record, an HTTP response a response record, anything else a resource
    record. refers (url, date and further headers of an earlier record with the same payload) makes a revisit
    record of a response: it keeps the HTTP head, the digest and the payload's length, not the payload.
    """
    head, payload = http_parts(record.content)
    digest = hashlib.sha256(payload).hexdigest()
    url = record.url
    headers = {"WARC-Date": iso_date(record.date), "WARC-Record-ID": record_id(url, record.date, digest)}
    if url.startswith("filedesc://"):
        return warc_record({"WARC-Type": "warcinfo", **headers, "WARC-Filename": url[11:], "Content-Type": "application/warc-fields"},
                           f"software: halflife\r\nformat: WARC File Format 1.1\r\nsource-format: ARC/{record.version}.0\r\n".encode())
    headers |= {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
    if record.fields["IP-address"] not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = record.fields["IP-address"]
    if not head:
        return warc_record({"WARC-Type": "resource", **headers, "Content-Type": record.fields["Content-type"]}, payload)
    headers["Content-Type"] = "application/http; msgtype=response"
    if refers is None:
        return warc_record({"WARC-Type": "response", **headers}, head + payload)
    first_url, first_date, more = refers
    return warc_record({
        "WARC-Type": "revisit", **headers, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": record_id(first_url, first_date, digest), "WARC-Refers-To-Target-URI": first_url,
        "WARC-Refers-To-Date": iso_date(first_date), "X-Payload-Length": str(len(payload)), **more,
    }, head)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("record ends early")
        yield headers, block


def member(record: bytes) -> bytes:
    """The record with its two line ends as a gzip member of its own, which a reader can begin at, without its last byte, a zero.

    The last byte of a member is the highest of its length. Where that is not zero, an empty member follows.
    """
    out = gzip.compress(record + _END, 6, mtime=0)
    return (out if not out[-1] else out + gzip.compress(b"", mtime=0))[:-1]


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes the binary column `record` as gzip WARC files of about file_bytes at most, or of one record, in subfolders of a folder.

    Every record is a gzip member. Spark's own text sink writes the bytes as they are and commits whole files, so retried
    or lost tasks leave no half archives; its line separator is the zero byte in which a member ends. The files' names end in .txt.
    """
    def run(batches):
        number, size = 0, 0
        for b in batches:
            out, bytes_, files = [], 0, []
            for r in b.column(0):
                out.append(member(r.as_py()))
                if size and size + len(out[-1]) > file_bytes:
                    number, size = number + 1, 0
                size += len(out[-1])
                bytes_ += len(out[-1])
                files.append(number)
                if bytes_ > SENT:
                    yield rows(out, files)
                    out, bytes_, files = [], 0, []
            if out:
                yield rows(out, files)

    def rows(out, files):
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], ["value", "file"])

    made = records.select("record").mapInArrow(run, "value binary, file int")
    with _conf(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "64"):  # else all records are sorted by file
        made.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


@contextmanager
def _conf(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, payload_bytes, payload_digest, http_head) of every record of a folder of WARC files.

    Digest and length are computed from the payload that is there; a revisit has those of its headers.
    """
    schema = [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http_head", pa.string())]

    def rows(batch_rows):
        out = []
        for h, block in batch_rows:
            head, payload = http_parts(block)
            if h["WARC-Type"] == "revisit":
                known = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
            else:
                known = len(payload), hashlib.sha256(payload).hexdigest()
            out.append((list(h.items()), *known, head.decode("utf-8", "replace")))
            if len(out) == 1_000:
                yield out
                out = []
        yield out

    def run(batches):
        for b in batches:
            for content in b.column(0):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))
                for out in rows(parse_warc(stream)):
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)], [n for n, _ in schema])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "headers map<string,string>, payload_bytes long, payload_digest string, http_head string")


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str) -> DataFrame:
    """Converts a folder of ARC files (plain, or gzip with names in .gz) to WARC; returns (path, n_records, n_errors, error) for each file.

    A file's bytes reach a worker line by line, in order, and one record is held at a time, so a file may be of any size
    and has one task. A file that is no ARC gives its error and no records; of one that is broken later the good records are kept.
    Empty files have no lines and no row.
    """
    # The text reader unzips; LF as the separator leaves every other byte alone. A plain file may be read in parts.
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(arc_path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("line"))
    kinds = {"path": pa.string(), "record": pa.binary(), "n_records": pa.int64(), "n_errors": pa.int64(), "error": pa.string()}

    def out(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], list(kinds))

    def rows(batches):
        for b in batches:
            yield from zip(b.column("path").to_pylist(), b.column("line"), strict=True)

    def run(batches):
        for path, group in groupby(rows(batches), key=itemgetter(0)):
            errors: list[str] = []
            held, size, n = [], 0, 0
            try:
                for record in read_arc((x.as_py() + b"\n" for _, x in group), errors):
                    try:
                        held.append(convert(record))
                    except ArcError as e:
                        errors.append(f"{record.url}: {e}")
                        continue
                    n, size = n + 1, size + len(held[-1])
                    if size > SENT:
                        yield out(path=[path] * len(held), record=held)
                        held, size = [], 0
            except ArcError as e:
                errors.append(str(e))
            if held:
                yield out(path=[path] * len(held), record=held)
            yield out(path=[path], n_records=[n], n_errors=[len(errors)], error=[errors[0] if errors else None])

    dealt = lines.repartition("path").sortWithinPartitions("path", "part", "n").select("path", "line")
    made = stored(dealt.mapInArrow(run, "path string, record binary, n_records long, n_errors long, error string"), "converted")
    write_warc(made.where("record is not null").select("record"), warc_path)
    return made.where("n_records is not null").select("path", "n_records", "n_errors", "error")


def page_date(page_id: int | None) -> str:
    """Pages have no time of their own: one second apart, from their number."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 315_360_000)).strftime("%Y%m%d%H%M%S")


def _url(url: str | None) -> str:
    return quote(url or "urn:page:unknown", safe="%/:=&?~#+!$,;'@()*[]")


def archive_pages(pages: DataFrame, path: str) -> None:
    """Puts pages (page_id, url, html) into ARCs of both versions, converts them, and writes the WARC files.

    Of pages with equal payloads of MIN_REVISIT_BYTES or more, the one with the smallest page_id (null last) is
    stored in full and the others, null ids included, refer to it; rows that repeat that page_id are stored too.
    Null texts are empty payloads. A null url gets a placeholder.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = rows.where(F.length("payload") >= MIN_REVISIT_BYTES)
    # Counts and minima are combined before the shuffle, so a payload that fills the crawl is no burden.
    firsts = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("low"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    firsts = stored(firsts.where("n > 1").select("digest", F.coalesce("first", "low").alias("first")), "payloads")
    few = firsts.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS
    marked = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left").select(
        "page_id", "url", "payload", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))

    def run(batches):
        for number, b in enumerate(batches):
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                kept = list(zip(*(part.column(c).to_pylist() for c in range(5)), strict=True))
                version = 1 + (number + at // 200) % 2

                def content(i, body):
                    own = "" if i is None else f"X-Page-Id: {i}\r\n"
                    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body

                arc = write_arc(version, f"pages-v{version}.arc", (
                    ({"URL": _url(u), "IP-address": "192.0.2.1", "Archive-date": page_date(i), "Content-type": "text/html", "Result-code": "200"}, content(i, body))
                    for i, u, body, _, _ in kept))
                records = parse_arc(arc)
                made = [convert(next(records))]
                for r, (i, _, _, first, first_url) in zip(records, kept, strict=True):
                    refers = None if first is None or first == i else (_url(first_url), page_date(first), {"X-Refers-To-Page": str(first)})
                    made.append(convert(r, refers))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    write_warc(marked.mapInArrow(run, "record binary"), path)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_warc(spark, path).where(F.col("headers")["WARC-Type"] != "warcinfo")
    own = F.regexp_extract("http_head", "X-Page-Id: (-?[0-9]+)\r\n", 1)
    return back.select(
        F.when(own != "", own).cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", F.col("headers")["WARC-Type"].alias("record_type"),
        F.col("headers")["X-Refers-To-Page"].cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
