"""WARC derivatives: from every response record, a metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To, with its target URI and date in WARC-Refers-To-Target-URI and -Date, and carry
these on as their own; the metadata record keeps the
response's WARC and HTTP headers and its digests as fields, and says whether the digests still hold. Record ids
are name-based UUIDs of the response's id, so a rerun, or a task that is run again, makes the same records.
Every record is made from its own row; nothing is shuffled.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared

DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def sha1(data: bytes) -> str:
    """A digest as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def _blank_line(data: bytes) -> tuple[int, int]:
    """Where the head ends and the body starts."""
    at = [(i, i + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (i := data.find(x)) >= 0]
    return min(at, default=(len(data), len(data)))


def _length(headers: list[tuple[str, str]]) -> int | None:
    """The stated length of the block; None if it is no number."""
    stated = _get(headers, "content-length") or ""
    return int(stated) if stated.isascii() and stated.isdigit() and len(stated) < 19 else None


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """(headers, block) of a record, None if it is none. Content-Length cuts the block, if it is given."""
    if not data.startswith(b"WARC/"):
        return None
    end, begin = _blank_line(data)
    headers = _fields(data[data.find(b"\n") + 1 : end])
    return headers, data[begin:][: _length(headers)]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size) or not int(size, 16):
            break
        n = int(size, 16)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def _decoded(body: bytes, headers: list[tuple[str, str]]) -> bytes:
    if "chunked" in (_get(headers, "transfer-encoding") or "").lower():
        body = _dechunked(body)
    coding = (_get(headers, "content-encoding") or "").lower()
    try:
        if "gzip" in coding:
            return gzip.decompress(body)
        if "deflate" in coding:
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # a body that is not what its header says stays as it is
    return body


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: Codecs that Python knows and that are no page's character set.
_NO_CHARSETS = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape"}
#: Elements of which nothing is text, and comments.
_DROPPED = re.compile(r"<!--|<(script|style|noscript|template|svg|title)\b", re.I)
_BREAKS = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|main|nav|header|footer|aside|body|html|head|blockquote|pre|form|figure)\b[^>]*>", re.I)
_TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINKS = re.compile(r"<a\b[^<>]*\bhref\s*=", re.I)


def _without(tags: re.Pattern, new: str, markup: str) -> str:
    """markup with the tags replaced. Behind the last > there are none; up to it the search for an end never fails, so it is linear."""
    end = markup.rfind(">") + 1
    return tags.sub(new, markup[:end]) + markup[end:]


def _line(s: str) -> str:
    return " ".join(html.unescape(_without(_TAGS, "", s)).split())


def _kept(markup: str) -> str:
    """markup without the elements that are dropped and comments; one that never ends goes up to the end. Linear in its length."""
    out, at, lowered = [], 0, markup.lower()
    if len(lowered) != len(markup):  # a few letters grow when they are lowered
        lowered = "".join(c.lower() if c.isascii() else c for c in markup)
    while m := _DROPPED.search(markup, at):
        out.append(markup[at : m.start()])
        close = "-->" if not m[1] else f"</{m[1].lower()}"
        stop = lowered.find(close, m.end())
        stop = lowered.find(">", stop) if stop >= 0 else -1
        if stop < 0:
            return "".join(out)
        at = stop + 1
    return "".join([*out, markup[at:]])


def _title(markup: str) -> str:
    start = re.search(r"<title\b[^<>]*>", markup, re.I)
    stop = re.compile("</title", re.I).search(markup, start.end()) if start else None
    return _line(markup[start.end() : stop.start()]) if stop else ""


def _language(markup: str) -> str:
    tag = re.search(r"<html\b[^<>]*>", markup, re.I)
    named = _LANG.search(tag[0]) if tag else None
    return named[1] if named else ""


def plain_text(markup: str) -> str:
    """The text of a page: one line a block, blanks collapsed, entities resolved, no script, style, title or comment."""
    lines = (" ".join(x.split()) for x in html.unescape(_without(_TAGS, "", _without(_BREAKS, "\n", _kept(markup)))).split("\n"))
    return "\n".join(x for x in lines if x)


def response(key: str, url: str | None, markup: str | None) -> bytes:
    """A response record for a page that was kept without one."""
    body = (markup or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"response:{key}:{url or ''}")), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", " ".join(url.split()))] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", sha1(block)), ("WARC-Payload-Digest", sha1(body))]
    return record(headers, block)


def derivatives(data: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record; of any other record or bytes, none."""
    parsed = parse(data)
    if not parsed or (_get(parsed[0], "warc-type") or "").lower() != "response":
        return []
    headers, block = parsed
    end, begin = _blank_line(block)
    status_line, _, http = block[:end].partition(b"\n")
    http_headers, payload = _fields(http), block[begin:]
    body = _decoded(payload, http_headers)
    content_type = _get(http_headers, "content-type") or ""
    named = _CHARSET.search(content_type) or _CHARSET.search(body[:1024].decode("latin-1"))
    charset = named[1] if named and named[1].lower().replace("-", "_") not in _NO_CHARSETS else "utf-8"
    try:
        markup = body.decode(charset, "replace")
    except (LookupError, UnicodeError, ValueError):  # no codec of that name, or one that refuses all input
        markup = body.decode("utf-8", "replace")
    source = _get(headers, "warc-record-id") or ""
    digests = {"block": (_get(headers, "warc-block-digest"), block), "payload": (_get(headers, "warc-payload-digest"), payload)}
    holds = {k: None if d is None or not d.startswith("sha1:") else d.upper() == sha1(b).upper() for k, (d, b) in digests.items()}
    status = re.match(rb"HTTP/\S+\s+(\d{3})", status_line)
    is_html = "html" in content_type.lower() or bool(re.search(r"<(html|body|p)\b", markup[:2000], re.I))
    text = plain_text(markup) if is_html else markup

    fields = [("source-status", status[1].decode() if status else ""), ("title", _title(markup) if is_html else ""), ("language", _language(markup) if is_html else "")]
    fields += [("outlinks", str(len(_LINKS.findall(markup)) if is_html else 0)), ("text-characters", str(len(text)))]
    fields += [(f"source-{k}-digest-holds", {None: "unknown", True: "yes", False: "no"}[v]) for k, v in holds.items()]
    fields += [(f"source-warc-{k}", v) for k, v in headers] + [(f"source-http-{k}", v) for k, v in http_headers]
    refers = [(f"WARC-Refers-To-{k}", v) for k in ("Target-URI", "Date") if (v := _get(headers, f"warc-{k.lower()}"))]
    kept = [(k, v) for k, v in headers if k.lower() in ("warc-target-uri", "warc-date", "warc-warcinfo-id")]
    out = []
    for kind, mime, new in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own, digest = record_id(f"{kind}:{source}"), sha1(new)
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *refers, *kept, ("Content-Type", mime), ("WARC-Block-Digest", digest)]
        out.append(
            {
                "record_type": kind, "record_id": own, "refers_to": source, "target_uri": _get(headers, "warc-target-uri"), "warc_date": _get(headers, "warc-date"),
                "source_status": int(status[1]) if status else None, "source_block_digest": digests["block"][0], "source_payload_digest": digests["payload"][0],
                "source_digests_hold": None if None in holds.values() else all(holds.values()), "block_digest": digest, "content_length": len(new), "record": record(lines, new),
            }
        )
    return out


FIELDS = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_status int, source_block_digest string, "
    "source_payload_digest string, source_digests_hold boolean, block_digest string, content_length bigint, record binary"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = [(n, _TYPES[t]) for n, t in (f.split(" ") for f in FIELDS.split(", "))]


def _responses(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
        yield pa.record_batch([batch.column(0), pa.array([response(str(i), u, p) for i, u, p in zip(ids, urls, pages, strict=True)], pa.binary())], names=["id", "record"])


def responses(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, record): a response record for every row of pages; null urls and pages give records without them."""
    prepared(pages.sparkSession)
    kind = dict(pages.dtypes)[id_column]
    return pages.select(F.col(id_column).alias("id"), "url", "html").mapInArrow(_responses, f"id {kind}, record binary")


def _derived(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        at, rows = [], []
        for i, r in enumerate(batch.column(1).to_pylist()):
            for d in derivatives(r or b""):
                at.append(i)
                rows.append(d)
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[n] for r in rows], t) for n, t in _SCHEMA]], names=["id", *[n for n, _ in _SCHEMA]])


def derive(records: DataFrame, id_column: str = "id", column: str = "record") -> DataFrame:
    """(id, FIELDS): two rows, metadata and conversion, for each row whose record is a response; else none.

    Null records and records of other types give no rows. Repeated rows give repeated records with equal ids.
    An empty table gives an empty result; other columns are not read.
    """
    prepared(records.sparkSession)
    kind = dict(records.dtypes)[id_column]
    return records.select(F.col(id_column).alias("id"), F.col(column).alias("record")).mapInArrow(_derived, f"id {kind}, {FIELDS}")


def write_files(derived: DataFrame, path: str) -> None:
    """Write the records as gzipped WARC files, one a partition. Their blocks are text, so Spark's text sink does."""
    whole = F.col("record").cast("string")
    derived.select(F.substring(whole, F.lit(1), F.length(whole) - 2).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, at, offsets, found = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0, [], []
            while (at := data.find(b"WARC/", at)) >= 0:
                end, begin = _blank_line(data[at : at + (1 << 20)])
                stop = min(len(data), at + begin + (_length(_fields(data[at : at + end])) or 0))
                offsets.append(at)
                found.append(data[at:stop] + b"\r\n\r\n")
                at = stop
            yield pa.record_batch([pa.array([path] * len(found)), pa.array(offsets, pa.int64()), pa.array(found, pa.binary())], names=["path", "offset", "record"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record) of the records in WARC files, plain or gzipped; a file is read by one task."""
    prepared(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, "path string, offset bigint, record binary")
