"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives a metadata record (application/warc-fields: title, character set, source headers
and digests, out-links) and a conversion record (text/plain). Both carry WARC-Refers-To with the
response's record id, its target URI and date, and digests of their own block; the response's HTTP headers and
payload digest go along with both. Record ids are name-based (page, URI, date and payload digest), so a run can
be repeated and joined, and two captures of a page are told apart.

Defined results: null html is an empty page, null url an empty URI; repeated rows of one content give records with the
same ids; markup that is never closed is read as far as it goes; an empty table gives an empty result; other columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches

DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:vidkin:warc")
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|hr|title|dd|dt|dl|form|body|html|head|main|aside)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
# Attributes are searched between one "<" and the next, so unclosed tags don't cost more than their length.
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_META, _CHARSET = re.compile(r"<meta\b([^<>]*)", re.I), re.compile(r"\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b([^<>]*)", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, source_digest string, source_headers string, content_length long, content string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """Visible text: one line per block, white space collapsed, character references resolved."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", page))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): page_id, target_uri, date, http_headers, payload."""
    payload = F.coalesce("html", F.lit(""))
    head = F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n", F.octet_length(payload))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its conversion record."""
    bound_batches(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, uri, date, head, payload in zip(batch["page_id"].astype("Int64"), batch["target_uri"], batch["date"], batch["http_headers"], batch["payload"], strict=True):
                raw = payload.encode("utf-8", "surrogatepass")
                source_digest = digest(raw)
                source = record_id("response", page_id, uri, date, source_digest)
                title, charset = _TITLE.search(payload), next((c for m in _META.finditer(payload) if (c := _CHARSET.search(m[1]))), None)
                fields = [f"source-payload-digest: {source_digest}", f"source-length: {len(raw)}"]
                fields += [f"source-header: {h}" for h in head.split("\r\n") if h]
                if title:
                    fields.append(f"title: {' '.join(html.unescape(title[1]).split())}")
                if charset:
                    fields.append(f"charset: {charset[1]}")
                for m in filter(None, (_HREF.search(x[1]) for x in _ANCHOR.finditer(payload))):
                    link = html.unescape(m[1] or m[2] or m[3] or "").strip()
                    try:
                        link = urljoin(uri, link)
                    except ValueError:
                        pass
                    fields.append(f"outlink: {' '.join(link.split())}")
                for kind, media, content in (("metadata", "application/warc-fields", "\r\n".join(fields) + "\r\n"), ("conversion", "text/plain; charset=utf-8", plain_text(payload))):
                    block = content.encode("utf-8", "surrogatepass")
                    out.append((page_id, kind, record_id(kind, source), source, uri, date, media, digest(block), source_digest, head, len(block), content))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame

    return records.mapInPandas(run, RECORD)


def serialise(row: dict) -> bytes:
    """One derived record as WARC/1.1 bytes."""
    block = row["content"].encode("utf-8", "surrogatepass")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Refers-To: {row['refers_to']}", f"WARC-Target-URI: {row['target_uri']}",
        f"WARC-Date: {row['date']}", f"WARC-Refers-To-Date: {row['date']}", f"WARC-Refers-To-Target-URI: {row['target_uri']}", f"WARC-Block-Digest: {row['block_digest']}",
        f"WARC-Payload-Digest: {row['source_digest']}", *[f"WARC-Source-Header: {h}" for h in row["source_headers"].split("\r\n") if h], f"Content-Type: {row['content_type']}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, path: str) -> None:
    """Parts of WARC bytes, one row per record, as Parquet (record_id, warc) for any downstream concatenation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record_id": batch["record_id"], "warc": [serialise(r) for r in batch.to_dict("records")]})

    records.mapInPandas(run, "record_id string, warc binary").write.parquet(path)
