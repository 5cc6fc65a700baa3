"""Legacy ARC archives: writing, parsing by version, and conversion to WARC files that are read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, scratch_path

#: The field lines of the two ARC versions, and the WARC profile of identical payloads.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A line that may head an ARC record, for going on after one that can't be read.
ARC_LINE = re.compile(rb"^\S+ [0-9A-Fa-f.:]+ \d{14} \S+ (?:[^\n]* )?\d+$", re.M)
#: The blank line that ends http headers; old servers leave out the carriage returns.
BLANK = re.compile(rb"\r?\n\r?\n")
PAGE = re.compile(rb"\r?\nX-Page-Id: (-?\d+)")
RECORD = "page_id long, uri string, ip string, date string, mime string, http boolean, head binary, payload binary, size long, digest string, error string"
BACK = "record_id string, record_type string, refers_to_id string, page_id long, payload_bytes long, payload_digest string, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_url(url: str | None) -> str:
    """One field of a header line: blanks and control characters are escaped; no url is "-"."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_date(n: int) -> str:
    """Fourteen digits decided by a number alone, for pages that have no date."""
    n = abs(n) % (10 * 365 * 86400)
    day, s = divmod(n, 86400)
    return f"{2005 + day // 365:04d}{day % 365 // 31 + 1:02d}{day % 365 % 28 + 1:02d}{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}"


def arc_member(version: int, records: list[tuple[str, str, str, bytes]], name: str) -> bytes:
    """An ARC file of (url, date, content type, network document) records, with its version block."""
    out = io.BytesIO()
    about = f"{version} 0 readloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    for url, date, mime, doc in [(f"filedesc://{name}", "20050101000000", "text/plain", about), *records]:
        values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": hashlib.md5(doc).hexdigest(), "Location": "-", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(doc))}
        fields = ARC_FIELDS[1] if url.startswith("filedesc:") else ARC_FIELDS[version]
        out.write((" ".join(values[f] for f in fields) + "\n").encode() + doc + b"\n")
    return out.getvalue()


def parse_arc(data: bytes, salvage: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of each record but the version block. The block's second line names the fields of the
    rest; without a block a line's number of fields tells the version. A line or length that is wrong raises ValueError; with
    salvage it gives ({"error": why}, the bytes up to the next line that may head a record), and reading goes on there."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        values = data[at:end].decode(errors="replace").split(" ") if end >= 0 else []
        names = ARC_FIELDS[1] if values and values[0].startswith("filedesc:") else fields or {len(f): f for f in ARC_FIELDS.values()}.get(len(values))
        head = dict(zip(names, values, strict=True)) if names and len(values) == len(names) else {}
        start, wrong = end + 1, None
        stop = start + int(values[-1]) if head and values[-1].isascii() and values[-1].isdigit() else len(data)
        if not head or not values[-1].isdigit() or not re.fullmatch("[0-9]{14}", head["Archive-date"]):
            wrong = f"no ARC header line at byte {at}"
        elif stop > len(data) or data[stop : stop + 1] not in (b"\n", b""):
            wrong = f"the length declared at byte {at} doesn't end at a record"
        if wrong:
            if not salvage:
                raise ValueError(wrong)
            next_ = ARC_LINE.search(data, start) if end >= 0 else None
            stop = next_.start() if next_ else len(data)
            yield {"error": wrong}, data[at:stop]
            at = stop
            continue
        if values[0].startswith("filedesc:"):
            fields = data[start:stop].decode().split("\n")[1].split(" ")
        else:
            yield head, data[start:stop]
        at = stop + 1
        while data[at : at + 1] == b"\n":
            at += 1


def pages_to_arc(pages: DataFrame, member_bytes: int = 1 << 22) -> DataFrame:
    """(name, data): ARC files of at most about member_bytes, versions 1 and 2 in turn, of the http responses of page_id, url and html."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n = [], 0, 0
        for batch in batches:
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                body = b"" if html is None else bytes(html)
                page = "" if pd.isna(page) else int(page)
                doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                held.append((arc_url(url), arc_date(page or 0), "text/html", doc))
                size += len(doc)
                if size >= member_bytes:
                    yield pd.DataFrame({"name": [f"part-{n}.arc"], "data": [arc_member(n % 2 + 1, held, f"part-{n}.arc")]})
                    held, size, n = [], 0, n + 1
        if held:
            yield pd.DataFrame({"name": [f"part-{n}.arc"], "data": [arc_member(n % 2 + 1, held, f"part-{n}.arc")]})

    # ids as text: pandas would make floats of longs beside nulls
    slim = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    return slim.mapInPandas(pack, "name string, data binary")


def halves(doc: bytes) -> tuple[bytes, bytes]:
    """(http headers with the blank line that ends them, payload)."""
    blank = BLANK.search(doc)
    return (doc[: blank.end()], doc[blank.end() :]) if blank else (doc, b"")


def arc_records(arcs: DataFrame) -> DataFrame:
    """RECORD's columns of the records of ARC files (data: their bytes, such as binaryFile's content, gzipped or not). What can't
    be read is a row of its own, with error and the bytes as payload. A document that isn't http is its own payload."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                rows = []
                for h, doc in parse_arc(data, salvage=True):
                    if "error" in h:
                        rows.append((None, None, None, None, None, False, b"", doc, len(doc), digest(doc), h["error"]))
                        continue
                    http = doc.startswith(b"HTTP/")
                    head, body = halves(doc) if http else (b"", doc)
                    page = PAGE.search(head)
                    d = h["Archive-date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((int(page[1]) if page else None, h["URL"], h["IP-address"], date, h["Content-type"], http, head, body, len(body), digest(body), None))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in RECORD.split(", ")]).astype({"page_id": "Int64"})

    return arcs.select("data").mapInPandas(parse, RECORD)


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {payload_digest}'.encode()).digest()[:16], version=5)}>"


def warc_text(records: DataFrame, first: DataFrame) -> DataFrame:
    """(value): a WARC record for each ARC record, but for the blank lines that end it. first: page_id, digest, first_id, first_uri, first_date of revisits."""

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            names = ("page", "uri", "ip", "date", "mime", "http", "head", "payload", "digest", "first_id", "first_uri", "first_date")
            for page, uri, ip, date, mime, http, head, body, dig, to, to_uri, to_date in zip(*(batch[c] for c in names), strict=True):
                block = bytes(head) + (bytes(body) if to is None else b"")
                kind = "revisit" if to is not None else "response" if http else "resource"
                lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, dig)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"Content-Type: {'application/http; msgtype=response' if http else mime}", f"WARC-Payload-Digest: sha1:{dig}", f"WARC-Block-Digest: sha1:{digest(block)}"]
                if ip != "0.0.0.0":
                    lines.append(f"WARC-IP-Address: {ip}")
                if to is not None:
                    lines += [f"WARC-Refers-To: {record_id(to, dig)}", f"WARC-Refers-To-Target-URI: {to_uri}", f"WARC-Refers-To-Date: {to_date}", f"WARC-Profile: {SAME_PAYLOAD}"]
                out.append("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block)
            yield pd.DataFrame({"value": out})

    # ids as text: pandas would make floats of longs beside nulls
    f = first.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first_id").cast("string").alias("first_id"), "first_uri", "first_date")
    rows = records.join(f, records.page_id.eqNullSafe(f.p) & (records.digest == f.d) & records.http, "left")
    rows = rows.select(F.col("page_id").cast("string").alias("page"), "uri", "ip", "date", "mime", "http", "head", "payload", "digest", "first_id", "first_uri", "first_date")
    return rows.mapInPandas(form, "value binary").select(F.col("value").cast("string").alias("value"))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the length declared at byte {at} doesn't end at a record")
        yield head, data[end + 4 : stop]
        at = stop + 4


def read_warc(spark, path: str) -> DataFrame:
    """BACK's columns of every record under path; a revisit's payload_bytes is what its http headers declare, if they do; intact says whether block and payload digests hold."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                rows = []
                for h, block in parse_warc(data):
                    head, body = (b"", block) if h["WARC-Type"] == "resource" else halves(block)
                    page, size = PAGE.search(head), re.search(rb"(?i)\r?\nContent-Length: *(\d+)", head)
                    dig = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    full = h["WARC-Type"] != "revisit"
                    intact = h["WARC-Block-Digest"] == f"sha1:{digest(block)}" and (not full or digest(body) == dig)
                    rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), int(page[1]) if page else None, len(body) if full else int(size[1]) if size else None, dig, intact))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in BACK.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, BACK)


def to_warc(arcs: DataFrame, path: str | None = None, min_bytes: int = 0, file_bytes: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(what is read back from the gzipped WARC files written under path, what couldn't be read of the archives).

    The first has page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) and intact; the second
    error and payload. Of http records with equal payloads of at least min_bytes, the one with the smallest page_id is a
    response and the others revisit it, without a body; smaller ones are all responses; what isn't http is a resource.

    Archives are parsed once, into a table that is removed when the files are written. Only ids, addresses and digests are
    grouped, summed up before they meet, so a payload with very many copies weighs no more than another; payloads are shuffled
    once. A file has as many records as make file_bytes on average, and no more than 4,096.
    """
    spark = arcs.sparkSession
    with scratch(spark):
        every = materialize(arc_records(arcs), "arc-records", codec="zstd")
        bad = materialize(every.where("error is not null").select("error", "payload"), "arc-errors", keep=True)
        records = every.where("error is null")
        ids = records.where(F.col("http") & (F.col("size") >= min_bytes)).select("page_id", "digest", "uri", "date")
        first = ids.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri", "date"))).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and f is not null")
        first = first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.uri").alias("first_uri"), F.col("f.date").alias("first_date"))
        again = ids.select("page_id", "digest").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
        mean = records.agg(F.avg(F.col("size") + 1024)).first()[0] or 1024
        path = path or scratch_path(spark, "warc")
        per_file = int(min(4096, max(1, file_bytes // mean)))
        warc_text(records, again).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        back = materialize(read_warc(spark, path), "warc-read", keep=True)
    owners = back.where("record_type = 'response'").select(F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n")).distinct()
    rows = back.join(owners, F.col("refers_to_id") == F.col("r"), "left")
    return rows.select("page_id", F.coalesce("n", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact"), bad


def convert(pages: DataFrame, path: str | None = None, min_bytes: int = 0, file_bytes: int = 1 << 26) -> DataFrame:
    """Write pages (page_id, url, html) as ARC, convert to gzipped WARC files under path, and return what is read back, as to_warc does.

    Null html: empty payload. Null url: "-". Null page_id: kept, after all numbers. Rows that repeat a response's page_id and
    payload are responses too. No rows: no records. Raises ValueError if an archive just written can't be read.
    """
    back, bad = to_warc(pages_to_arc(pages), path, min_bytes, file_bytes)
    if not bad.isEmpty():
        raise ValueError(f"an archive can't be read: {bad.first()['error']}")
    return back
