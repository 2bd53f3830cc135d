"""Web archives: ARC files parsed, converted to WARC, written and read (operator 3).

An ARC file begins with a version block that names the fields of the header
lines that follow; each record is such a line and as many bytes as the line
declares.  The converter gives every record a WARC identifier, timestamp, type
and digests.  Records reach the disk through Spark's text writer, whose line
separator is the last byte of a WARC record, so that archives can be written to
any file system that Spark knows; they are read back as whole files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, flat, prepare, remove, scratch, settle

#: Fields of header lines by version; fixed by the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SOFTWARE = "threadloom"
#: Bytes of an archive file, about.
FILE_BYTES = 8 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    fields: dict[str, str]
    content: bytes


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    lead = f"{version} 0 {SOFTWARE}\n{' '.join(FIELDS[version])}\n\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(lead))}
    out = [" ".join(first[f] for f in FIELDS[version]).encode() + b"\n", lead]
    at = sum(map(len, out))
    for r in records:
        line = {"Result-code": "200", "Checksum": "-", "Location": "-", "Filename": name, **r.fields, "URL": r.url, "IP-address": r.ip, "Archive-date": r.date, "Content-type": r.mime, "Offset": str(at), "Archive-length": str(len(r.content))}
        out += [" ".join(line[f] for f in FIELDS[version]).encode() + b"\n", r.content, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block; header lines are read by the fields that it names.

    A header line with other than the named fields, or a declared length beyond
    the end, is an error; blank lines between records are skipped.
    """
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("ARC header line without end")
        line = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r")
        size = line.rpartition(" ")[2]
        if not size.isdigit() or stop + 1 + int(size) > len(data):
            raise ValueError(f"ARC record without a valid length: {line[:80]}")
        content = data[stop + 1 : stop + 1 + int(size)]
        at = stop + 1 + int(size)
        if fields is None:
            head = content.decode("utf-8", "replace").splitlines()
            version = int(head[0].split()[0]) if head and head[0].split() and head[0].split()[0].isdigit() else 0
            fields = head[1].split() if len(head) > 1 and head[1].strip() else FIELDS.get(version)
            if not fields or not line.startswith("filedesc:"):
                raise ValueError("ARC file without a version block")
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"ARC header line with {len(values)} of {len(fields)} fields: {line[:80]}")
        own = dict(zip(fields, values))
        yield ArcRecord(own["URL"], own["IP-address"], own["Archive-date"], own["Content-type"], own, content)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    """ARC's YYYYMMDDhhmmss, or a beginning of it, as a WARC timestamp."""
    full = arc_date + "00000101000000"[len(arc_date) :] if len(arc_date) < 14 else arc_date[:14]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, arc_date: str, digest: str) -> str:
    """The same for the same capture wherever it is converted."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{url}\n{arc_date}\n{digest}'.encode('utf-8', 'surrogateescape')).digest()[:16], version=4)}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and body; content without a head is all body."""
    if content.startswith(b"HTTP/"):
        for end in (b"\r\n\r\n", b"\n\n"):
            if (k := content.find(end)) >= 0:
                return content[: k + len(end)], content[k + len(end) :]
    return b"", content


def to_warc(r: ArcRecord, refers_to: str | None = None) -> bytes:
    """A response (resource where there is no HTTP head), or a revisit of the record `refers_to`, which holds the head alone."""
    head, payload = split_http(r.content)
    digest = digest32(payload)
    block = head if refers_to else r.content
    kind = "revisit" if refers_to else "response" if head else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(r.url, r.date, digest)}", f"WARC-Date: {warc_date(r.date)}", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Type: {'application/http; msgtype=response' if head else r.mime}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {IDENTICAL}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields in lower case and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        size = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is cut off")
        yield head, block
        at = stop + 8 + size


def _page(page_id: int | None, url: str | None, payload: bytes) -> ArcRecord:
    """A page as a capture; its id is a header of the archived response, its date follows from its id."""
    when = datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 3_000_000_000)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    return ArcRecord(quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]"), "0.0.0.0", when.strftime("%Y%m%d%H%M%S"), "text/html", {}, head.encode() + payload)


def archive(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a WARC record per row of page_id, url, html to files in `folder`.

    The rows pass through ARC, those of odd ids through version 2.  Of records with equal
    payloads of at least `least` bytes the smallest page_id is the response (every
    row of that id, should it repeat), others are revisits of it; null ids count
    as largest, null html as empty.
    """
    text = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    groups = rows.filter(F.col("bytes") >= least).groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = settle(groups.select("sha", "copies", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    dealt = attach_groups(rows, groups, "sha", "copies", seen["n"])

    def convert(batches):
        for batch in batches:
            ids, urls, first_ids, first_urls, copies = (batch.column(c).to_pylist() for c in ("page_id", "url", "first_id", "first_url", "copies"))
            buf, at = flat(batch.column("html"))
            raw, at = buf.tobytes(), at.tolist()
            made = {1: [], 2: []}
            for k, page_id in enumerate(ids):
                payload = raw[at[k] : at[k + 1]]
                refers = None
                if copies[k] and page_id != first_ids[k]:
                    r = _page(first_ids[k], first_urls[k], payload)
                    refers = record_id(r.url, r.date, digest32(payload))
                made[1 + (page_id or 0) % 2].append((_page(page_id, urls[k], payload), refers))
            out = []
            for version, pairs in made.items():
                for r, (_, refers) in zip(read_arc(write_arc([p[0] for p in pairs], version)), pairs, strict=True):
                    out.append(to_warc(r, refers)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    per_file = max(1, FILE_BYTES * max(seen["n"], 1) // (seen["bytes"] + 600 * max(seen["n"], 1)))
    dealt.drop("sha", "bytes").mapInArrow(convert, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(folder)


def records(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id, target_uri, warc_date of every record of WARC files."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for head, block in read_warc(data.as_py()):
                    http, payload = split_http(block)
                    fields = dict(line.split(": ", 1) for line in http.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
                    page = fields.get("X-Page-Id")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if digest32(block) != head["warc-block-digest"].removeprefix("sha1:") or not revisit and digest32(payload) != digest:
                        raise ValueError(f"digest of {head['warc-record-id']} is wrong")
                    out.append((int(page) if page else None, int(fields["Content-Length"]) if revisit else len(payload), digest, head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), head["warc-target-uri"], head["warc-date"]))
                cols = list(zip(*out)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.string()] * 6])], ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id", "target_uri", "warc_date"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, target_uri string, warc_date string")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the record's own fields, read back from archives just written.

    An empty table gives no rows.  See archive() for nulls, ties and repeats.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch(spark)
    archive(pages, folder, least)
    back = settle(records(spark, folder))
    remove(spark, folder)
    total = back.count()
    asked = back.filter("refers_to_id is not null").groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("asked"))
    named = back.filter("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    groups = settle(asked.join(named, "refers_to_id"))
    out = attach_groups(back, groups, "refers_to_id", "asked", total)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date")
