"""Operator 8: WARC derivatives.  Response records become linked metadata and plain-text conversion records.

A response has a record id, a target URI, a date, an HTTP header block and a payload.  From it are made
- a metadata record (application/warc-fields: title, language, links, payload digest, and the source's HTTP status line and every header as
  source-http-status and source-http-header),
- a conversion record (text/plain; charset=utf-8) of the payload's visible text.
Both carry WARC-Refers-To with the response's id, WARC-Target-URI, WARC-Date, the digest of their own block, and the
response's payload digest and Content-Type (as WARC-Source-Payload-Digest and WARC-Source-Content-Type).  Ids are name-based (SHA-1 of type and source id), so a repeated or
retried run gives the same records.  `serialise` turns records into bytes, one gzip member each; `parse` reads them back.

A null payload gives empty blocks; a null URI is left out of the headers; repeated responses give repeated records under the same ids (ties); very long
payloads are converted whole, in time that grows with their length; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map

DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head|svg)(?=[\s/>])[^>]*(?:>|\Z)", re.I)
_CLOSE = {"--": re.compile("-->")} | {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "title")}
#: What a head is made of: hidden parts, titles, other tags that may stand in it, its own end, and whatever else.
_IN_HEAD = re.compile(r"\s+|<!--|<(script|style|noscript|template|title)(?=[\s/>])[^>]*(?:>|\Z)|<(/head)\s*>|<(body)(?=[\s/>])|</?(?:meta|link|base|basefont|bgsound|noframes|noscript|template|title|script|style|head)(?=[\s/>])[^<>]*>|<[!?][^<>]*>|(<|[^\s<]+)", re.I)
_TITLE = re.compile(r"<title(?=[\s/>])[^<>]*>", re.I)
_LANG = re.compile(r"<html(?=[\s/>])[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
#: A start tag ends at the next angle bracket of either kind, so nothing is read twice.
_LINK = re.compile(r"<a(?=[\s/])[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>]+))", re.I)
_REFERENCE = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]*)|0*([0-9]*));?")
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main|blockquote|pre|hr|dl|dt|dd|form|body|html|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_BLANK = re.compile(r"[^\S\n]+")

COLUMNS = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block binary, block_digest string, payload_digest string, source_content_type string, http_headers string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{source}')}>"


def _after(page: str, m: re.Match, unclosed: set[str]) -> int:
    """Where a hidden part ends.  Without its closing tag a comment, script or style goes on to the end of the page, any other is its tag alone."""
    name = (m[1] or "--").lower()
    if name == "svg" and m[0].endswith("/>"):
        return m.end()
    end = None if name in unclosed else _CLOSE[name].search(page, m.end())
    if end:
        return end.end()
    unclosed.add(name)
    return len(page) if name in ("--", "script", "style") else m.end()


def _after_head(page: str, at: int, unclosed: set[str]) -> tuple[int, int]:
    """Where a head ends, and how far was read: at its closing tag, or, if <body or the page's end comes first, at the first thing that can't stand in a head."""
    first = None
    while m := _IN_HEAD.match(page, at):
        if m[2]:
            return m.end(), m.end()
        if m[3]:
            break
        if m[4] and first is None:
            first = at
        at = _after(page, m, unclosed) if m[1] or m[0] == "<!--" else m.end()
    return at if first is None else first, at


def _without_hidden(page: str) -> str:
    """The page with a blank for each comment, script, style, noscript, template, svg and head."""
    out, at, read = [], 0, 0
    unclosed: set[str] = set()  # names without a closing tag further on
    while m := _HIDDEN.search(page, at):
        out += [page[at : m.start()], " "]
        if (m[1] or "").lower() != "head":
            at = _after(page, m, unclosed)
        elif m.start() < read:  # inside a head that was read before and has no closing tag
            at = m.end()
        else:
            at, read = _after_head(page, m.end(), unclosed)
    return "".join([*out, page[at:]])


def resolved(text: str) -> str:
    """Entities resolved; a number beyond Unicode, however long, is the replacement character."""
    short = _REFERENCE.sub(lambda m: "\ufffd" if len(m[2] or m[3] or "") > 7 else m[0], text)
    return html.unescape(short)


def plain_text(page: str) -> str:
    """Visible text: no comments, scripts, styles or head; block tags break lines; entities resolved; blank runs closed up."""
    shown = _without_hidden(page)
    last = shown.rfind(">") + 1  # no tag ends after it
    shown = resolved(_TAG.sub("", _BREAK.sub("\n", shown[:last])) + shown[last:])
    lines = (_BLANK.sub(" ", x).strip() for x in shown.split("\n"))
    return "\n".join(x for x in lines if x)


def page_title(page: str) -> str:
    begin = _TITLE.search(page)
    end = begin and _CLOSE["title"].search(page, begin.end())
    return " ".join(resolved(page[begin.end() : end.start()]).split()) if end else ""


def header_lines(headers: str) -> list[str]:
    """The lines of an HTTP header block, folded ones made one."""
    return re.sub(r"\r?\n[ \t]+", " ", headers).split("\n")


def metadata_block(page: str, content_type: str, payload: str, headers: str = "") -> bytes:
    lang = _LANG.search(page)
    links = [resolved(next((x for x in m if x), "")) for m in _LINK.findall(page)]
    source = [("source-http-status" if x[:5].upper() == "HTTP/" else "source-http-header", x.strip()) for x in header_lines(headers)]
    fields = [("title", page_title(page)), ("language", lang[1] if lang else ""), ("source-content-type", content_type), ("source-payload-digest", payload), *source, *(("outlink", " ".join(x.split())) for x in links)]
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode()


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Pages as response records: record_id, target_uri, warc_date, http_headers, payload."""
    source = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")))
    rows = pages.select(F.col(key).alias("key"), source.alias("source"), F.col(url).alias("target_uri"), F.lit(DATE).alias("warc_date"), F.lit(HTTP_HEADERS).alias("http_headers"), F.col(page).cast("binary").alias("payload"))

    def name(batch: pa.RecordBatch) -> dict:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        return {c: cols[c] for c in ("key", "target_uri", "warc_date", "http_headers", "payload")} | {"record_id": [record_id("response", s) for s in cols["source"].to_pylist()]}

    return arrow_map(rows, name, f"key {rows.schema['key'].dataType.simpleString()}, record_id string, target_uri string, warc_date string, http_headers string, payload binary", text="payload").withColumnRenamed("key", key)


def derive(sources: DataFrame, keep: str | None = None) -> DataFrame:
    """Metadata and conversion records (COLUMNS) of response records; `keep` names a column of theirs to carry along."""
    rows = sources.select(*([F.col(keep).alias("keep")] if keep else [F.lit(None).cast("string").alias("keep")]), "record_id", "target_uri", "warc_date", "http_headers", "payload")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c.split()[0]: [] for c in ["keep", *COLUMNS.split(", ")]}
        for keep_, rid, uri, date, headers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = payload or b""
            page, payload_digest = raw.decode("utf-8", "replace"), digest(raw)
            found = re.search(r"(?im)^content-type:[ \t]*([^\r\n]*)", headers or "")
            kind = found[1].strip() if found else ""
            for what, mime, block in (("metadata", "application/warc-fields", metadata_block(page, kind, payload_digest, headers or "")), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
                for c, v in zip(out, (keep_, record_id(what, rid or ""), what, rid, uri, date, mime, block, digest(block), payload_digest, kind, headers), strict=True):
                    out[c].append(v)
        return out

    made = arrow_map(rows, run, f"keep {rows.schema['keep'].dataType.simpleString()}, {COLUMNS}", text="payload")
    return made.withColumnRenamed("keep", keep) if keep else made.drop("keep")


def one_record(r: dict) -> bytes:
    headers = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["payload_digest"]), ("WARC-Source-Content-Type", r["source_content_type"]), ("Content-Type", r["content_type"]), ("Content-Length", str(len(r["block"])))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v).encode() + b"\r\n" + r["block"] + b"\r\n\r\n"


def serialise(records: DataFrame) -> DataFrame:
    """record_id and the record's bytes as one gzip member; members written one after another are a WARC file."""
    rows = records.select(*[c.split()[0] for c in COLUMNS.split(", ")])
    return arrow_map(rows, lambda b: {"record_id": b.column(0), "member": [gzip.compress(one_record(r), 6, mtime=0) for r in b.to_pylist()]}, "record_id string, member binary", text="block")


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one by one (commonly one for each record), or the file itself if it isn't packed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view = memoryview(raw)
    while len(view):
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(view) + unpack.flush()
        view = view[len(view) - len(unpack.unused_data) :]


def records(raw: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, plain or gzip, one by one: headers in lower case, and the block."""
    for data in members(raw):
        at = 0
        while (at := data.find(b"WARC/", at)) >= 0:
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            yield {k.lower(): v for k, v in head.items()} | {"block": data[end + 4 : end + 4 + size]}
            at = end + 4 + size


def parse(raw: bytes) -> list[dict]:
    return list(records(raw))


def read(spark, path: str) -> DataFrame:
    """Response records of WARC files in any store that Spark reads.  A task holds one file as it is stored (Spark's limit for it is 2 GB), a
    member of it unpacked, and responses of about CHUNK_BYTES."""
    rows = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("http_headers", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for raw in (x.as_py() for batch in batches for x in batch.column(0)):
            for r in records(raw):
                if r.get("warc-type") == "response":
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    held.append((r.get("warc-record-id"), r.get("warc-target-uri"), r.get("warc-date"), head.decode("latin-1"), body))
                    size += len(r["block"])
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "record_id string, target_uri string, warc_date string, http_headers string, payload binary")
