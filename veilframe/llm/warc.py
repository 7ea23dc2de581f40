"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To and name its target URI and date. The metadata record keeps
the response's HTTP headers, its block and payload digests, title, charset, language and outlinks as
warc-fields; the conversion record holds the readable text. Every record is given whole, as the bytes of
a WARC/1.1 record, so that writing the bytes one after another makes a WARC file; read_warc() reads such
files back through Spark.

Defined results: a null or empty payload gives records with empty text; a null URI gives records without
WARC-Target-URI; malformed HTML is read as far as it goes, whole and never cut; repeated rows give equal records with equal ids;
an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

CRLF = "\r\n"
# A script or style that is not closed runs to the end of the page, as in a browser; a head that is not closed
# before the body ends at the first thing no head holds; of any other unclosed element only the tag goes.
_SKIP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<svg\b[^>]*/>|<(noscript|template|svg)\b[^>]*>(?:.*?</\2\s*>)?"
    r"|<head\b[^>]*>(?:(?:(?!<body\b).)*?</head\s*>|(?:\s+|<!--.*?-->|<(title|script|style|noscript|template)\b[^>]*>.*?</\3\s*>|<(?:meta|link|base|basefont|bgsound)\b[^>]*>)*+)",
    re.I | re.S,
)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|h[1-6]|section|article|header|footer|nav|aside|main|form|pre|blockquote|title|figure|figcaption)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I | re.S)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_HTTP_CHARSET = re.compile(r"^content-type:[^\r\n]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I | re.M)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([\w-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" *\n[ \n]*")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable id: equal parts give equal ids, whichever executor makes them."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def decoded(body: bytes, head: str | None) -> str:
    """The page's text: by its byte order mark, the HTTP charset, the meta charset, or else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    said = _HTTP_CHARSET.search(head or "")
    meta = None if said else _CHARSET.search(body[:4096].decode("latin-1"))
    name = (said or meta)[1].lower() if said or meta else "utf-8"
    if name in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):  # what browsers take them for
        name = "cp1252"
    elif meta and name.startswith("utf-16"):  # it was read as bytes
        name = "utf-8"
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):  # no such charset
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """The readable text: no markup, scripts or styles; a line for each block; entities resolved."""
    s = _SKIP.sub(" ", page)
    s = s.replace("\n", " ").replace("\r", " ")
    s = _CELL.sub(" ", _BREAK.sub("\n", s))
    s = html.unescape(_TAG.sub("", s)).replace("\xa0", " ")
    return _LINES.sub("\n", _SPACE.sub(" ", s)).strip()


def outlinks(page: str, base: str | None) -> list[str]:
    found = []
    for m in _HREF.finditer(_SKIP.sub(" ", page) if "<!--" in page else page):
        link = html.unescape(next(x for x in m.groups() if x is not None)).strip()
        if not link or link.startswith(("#", "javascript:", "mailto:", "data:")):
            continue
        try:
            found.append(urljoin(base or "", link))
        except ValueError:  # not a URI
            continue
    return list(dict.fromkeys(found))


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    shown = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers if v is not None]
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in [*shown, ("Content-Length", str(len(block)))]) + CRLF
    return head.encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of every record of a WARC file; gzip members are opened."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode().split(CRLF)[1:]]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload binary, block_digest string, payload_digest string"
DERIVED = "refers_to string, warc_type string, record_id string, target_uri string, date string, content_type string, block binary, block_digest string, refers_to_block_digest string, refers_to_payload_digest string, record binary"


def responses_from_pages(pages: DataFrame, date: str = "2025-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of fetched pages, which has no headers of its own."""
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("target_uri"), payload.alias("payload"))

    def run(batches):
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for page, uri, body in zip(*(c.to_pylist() for c in b.columns)):
                head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}"
                digest = sha1_digest(body)
                for c, v in zip(cols, (page, record_id("response", str(page), uri or "", digest), uri, date, head, body, sha1_digest(head.encode() + body), digest)):
                    c.append(v)
            kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", *(x.split()[0] for x in RESPONSE.split(", "))])

    return rows.mapInArrow(run, "page_id long, " + RESPONSE)


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The two derived records of each response, with the response's columns in keep beside them."""
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    kept = [F.col(f"`{c}`") for c in keep]
    schema = responses.select(*kept).schema
    for x in DERIVED.split(", "):
        schema = schema.add(*x.split())
    n = len(keep)

    def run(batches):
        for b in slices(batches, 64):
            picked: list[int] = []
            rows: list[tuple] = []
            for i, (rid, uri, date, head, body, block_digest, payload_digest) in enumerate(zip(*(b.column(n + k).to_pylist() for k in range(len(names))))):
                body = body or b""
                page = decoded(body, head)
                title = _TITLE.search(page)
                charset, lang = _CHARSET.search(page), _LANG.search(page)
                fields = [("via-record", rid), ("payload-digest", payload_digest), ("block-digest", block_digest), ("payload-length", str(len(body)))]
                fields += [(k, v) for k, v in (("title", _SPACE.sub(" ", html.unescape(title[1]).replace("\n", " ")).strip() if title else None), ("charset", charset and charset[1]), ("language", lang and lang[1])) if v]
                fields += [("http-header", h) for h in (head or "").split(CRLF) if h]
                fields += [("outlink", x) for x in outlinks(page, uri)]
                meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}{CRLF}" for k, v in fields if v is not None).encode()
                for kind, content, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
                    own, digest = record_id(kind, rid or "", payload_digest or ""), sha1_digest(block)
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest), ("Content-Type", content)]
                    picked.append(i)
                    rows.append((rid, kind, own, uri, date, content, block, digest, block_digest, payload_digest, record_bytes(headers, block)))
            cols = list(zip(*rows)) or [()] * 11
            kinds = [pa.binary() if x.endswith("binary") else pa.string() for x in DERIVED.split(", ")]
            left = b.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(left.column(k) for k in range(n)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep, *(x.split()[0] for x in DERIVED.split(", "))])

    return responses.select(*kept, *names).mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, headers map, block) of every record of the WARC files under path."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            for data in b.column(0):
                found = parse_records(data.as_py())
                for i in range(0, len(found), 256):
                    part = found[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([dict(h).get("WARC-Type") for h, _ in part]), pa.array([h for h, _ in part], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in part], pa.binary())], names=["warc_type", "headers", "block"])

    return files.mapInArrow(run, "warc_type string, headers map<string,string>, block binary")
