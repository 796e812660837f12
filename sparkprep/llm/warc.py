"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response is one archived page: target address, date, header block and body. From
each, two records are derived: ``metadata`` (fetch facts, title and out-links) and
``conversion`` (the page's plain text). Both carry ``WARC-Refers-To`` with the
response's record id, its target address and date, and the digest of the body they
were derived from; each has a digest of its own block. Record ids are version 5
UUIDs of address, kind and body, so reruns agree.

Records are rows; ``save`` renders them as WARC 1.1 text, one file per task, with
Spark's text writer, and ``read`` takes such files apart again.

Defined results: a null page body counts as empty and still yields both records; a
null address becomes ``urn:page:<id>``; long pages are handled whole; equal rows
yield equal records. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|blockquote|pre|hr|title|dd|dt|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>?")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
_LINK = re.compile(r"""<(a|area|link|img|script|iframe|source)\b[^>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.S | re.I)


def plain_text(page: str) -> str:
    """Text of a page: hidden parts and tags removed, blocks on lines of their own, entities resolved."""
    body = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", _HEAD.sub(" ", page))))
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(body))).strip()


def title(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(entities.unescape(_TAG.sub("", found[1])).split()) if found else ""


def links(page: str, base: str) -> list[tuple[str, str]]:
    """(place, address) of every link in page order, made absolute; addresses that cannot be joined stay as they are."""
    found = []
    for m in _LINK.finditer(_HIDDEN.sub(lambda h: h[0] if h[0][:7].lower() == "<script" else " ", page)):
        raw = entities.unescape(m[3] or m[4] or m[5] or "").strip()
        try:
            found.append((f"{m[1].upper()}@/{m[2].lower()}", urljoin(base, raw)))
        except ValueError:
            found.append((f"{m[1].upper()}@/{m[2].lower()}", raw))
    return found


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, address: str, body: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {address} {hashlib.sha256(body).hexdigest()}')}>"


COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_headers map<string,string>, content string"


def responses(pages: DataFrame, key: str = "page_id", address: str = "url", body: str = "html", date: str = DATE) -> DataFrame:
    """A response record per page: its key and the record columns; ``content`` is the body."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, uri, text in zip(frame["key"], frame["uri"], frame["body"]):
                text = text if isinstance(text, str) else ""
                uri = uri if isinstance(uri, str) and uri else f"urn:page:{k}"
                data = text.encode("utf-8", "surrogatepass")
                headers = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(data))}
                block = http_head(headers).encode() + data
                out.append(("response", record_id("response", uri, data), None, uri, date, "application/http; msgtype=response", digest(block), digest(data), headers, text))
            done = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            done.insert(0, "key", frame["key"].to_numpy())
            yield done

    return pages.select(F.col(key).alias("key"), F.col(address).alias("uri"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)


def http_head(headers: dict[str, str]) -> str:
    return "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in sorted(headers.items())) + "\r\n"


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The metadata and conversion records of every response in ``records``."""
    kind = records.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                page = row.content if isinstance(row.content, str) else ""
                headers = dict(row.source_headers or {})
                found = links(page, row.target_uri if urlsplit_ok(row.target_uri) else "")
                facts = [f"title: {title(page)}", f"source-content-type: {headers.get('Content-Type', '')}", f"source-content-length: {headers.get('Content-Length', '')}"]
                facts += [f"outlink: {uri} {place}" for place, uri in found]
                for type_, media, text in (("metadata", "application/warc-fields", "\r\n".join(facts) + "\r\n"), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                    data = text.encode("utf-8", "surrogatepass")
                    body = page.encode("utf-8", "surrogatepass")
                    out.append((row.key, type_, record_id(type_, row.target_uri, body), row.record_id, row.target_uri, row.date, media, digest(data), row.payload_digest, headers, text, len(found)))
            yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in COLUMNS.split(", ")), "n_links"])

    chosen = records.where("record_type = 'response'").withColumnRenamed(key, "key").select("key", "record_id", "target_uri", "date", "payload_digest", "source_headers", "content")
    return chosen.mapInPandas(run, f"key {kind}, {COLUMNS}, n_links long").withColumnRenamed("key", key)


def urlsplit_ok(address: str) -> bool:
    try:
        return bool(urlsplit(address).scheme)
    except ValueError:
        return False


def rendered(records: DataFrame) -> DataFrame:
    """``value``: each record as WARC 1.1 text, without the two line ends that close it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": [_record(r) for r in frame.itertuples(index=False)]})

    return records.select(*(c.split()[0] for c in COLUMNS.split(", "))).mapInPandas(run, "value string")


def _record(r) -> str:
    block = (http_head(dict(r.source_headers)) if r.record_type == "response" else "") + r.content
    fields = [("WARC-Type", r.record_type), ("WARC-Record-ID", r.record_id), ("WARC-Refers-To", r.refers_to), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.date)]
    fields += [("WARC-Block-Digest", r.block_digest), ("WARC-Payload-Digest", r.payload_digest), ("Content-Type", r.content_type)]
    if r.record_type != "response":
        fields += [(f"WARC-Source-{k}", v) for k, v in sorted(dict(r.source_headers).items())]
    fields.append(("Content-Length", str(len(block.encode("utf-8", "surrogatepass")))))
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n" + block


def save(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one per task, through Spark's text writer."""
    rendered(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` (header map) and ``block`` of every record in WARC files; one file is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                yield pd.DataFrame(list(_split(bytes(data))), columns=["fields", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "fields map<string,string>, block binary")


def _split(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
