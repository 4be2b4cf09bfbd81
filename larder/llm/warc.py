"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record becomes two records that refer to it: `metadata`
(application/warc-fields: title, language, sizes, links, and the source's own
headers) and `conversion` (text/plain).  Both keep the source's target URI,
date and payload digest; identifiers are UUIDs of version 5 made from the
source's identifier, so a task that runs again makes the same records.  Record
files are sequences of gzip members, one per record.

Defined results: a null page is an empty payload; a null URL leaves the target
header out; rows that repeat a page give equal records; malformed records raise
ValueError; very long pages and pages of tags that are never closed take time in
proportion to their length; an empty table makes no file.  Other input columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.sstable import filesystem
from larder.llm.staging import Stage

VERSION = b"WARC/1.1"
_SPACE = uuid.UUID("6f2c3f0e-8f3b-5d0a-9b43-5a6c2f3f7d11")

_SKIPPED = re.compile(r"<(?:(!--)|(script|style|noscript|template|head)\b)", re.I)
_CLOSERS = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "head", "title")} | {"!--": re.compile("-->")}
_TITLE = re.compile(r"<title\b", re.I)
_HTML, _ANCHOR = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"<a\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|main|aside|blockquote|pre|form|dl|dt|dd|figure|body|html)|br|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?A-Za-z][^>]*>")
_ZEROS, _HUGE = re.compile(r"&#(x?)0+(?=[0-9A-Fa-f])", re.I), re.compile(r"&#(?:[0-9]{8,}|x[0-9A-Fa-f]{7,});?", re.I)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(map(str, parts)))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(headers.get("content-length", -1))
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("bad length of a WARC record")
    return headers, rest[:n]


def visible(page: str) -> str:
    """The page without comments, scripts, styles, templates and head.  What is never closed is no such element.

    One pass: an opener without a closer after it shows that later ones of its kind have none either.
    """
    kept, at, no_more = [], 0, len(page)
    open_ended: set[str] = set()
    opener = _SKIPPED.search(page)
    while opener is not None:
        name = opener[1] or opener[2].lower()
        to = None
        if name not in open_ended:
            body = opener.end() if opener[1] else page.find(">", opener.end(), no_more) + 1
            if body == 0:  # no tag ends from here on
                no_more = opener.end()
            closer = _CLOSERS[name].search(page, body) if body else None
            if closer is None:
                open_ended.add(name)
            else:
                to = closer.end()
        if to is None:
            opener = _SKIPPED.search(page, opener.end())
            continue
        kept += [page[at : opener.start()], " "]
        at = to
        opener = _SKIPPED.search(page, at)
    return "".join([*kept, page[at:]])


def _decoded(text: str) -> str:
    """Character references resolved; numbers beyond all characters are U+FFFD however long they are."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return entities.unescape(text)


def _without_tags(text: str) -> str:
    end = text.rfind(">") + 1  # what starts after it is never closed and no tag
    return _TAG.sub("", text[:end]) + text[end:]


def to_text(page: str) -> str:
    """Visible text: a line per block element, entities decoded, spaces collapsed.  Linear in the page's length."""
    return _lines(visible(page))


def _lines(page: str) -> str:
    page = page.replace("\n", " ")
    end = page.rfind(">") + 1
    page = _decoded(_without_tags(_BREAK.sub("\n", page[:end]) + page[end:]))
    lines = (" ".join(line.split()) for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str:
    """The text of the first title element that is closed, else nothing."""
    opener = _TITLE.search(page)
    start = page.find(">", opener.end()) + 1 if opener else 0
    closer = _CLOSERS["title"].search(page, start) if start else None
    return " ".join(_decoded(_without_tags(page[start : closer.start()])).split()) if closer else ""


def language_of(page: str) -> str:
    end = page.rfind(">") + 1
    return next((m[1] for tag in _HTML.finditer(page[:end]) if (m := _LANG.search(tag[0]))), "")


def links_of(page: str) -> list[str]:
    """Targets of the links in what is visible, in their order."""
    return _targets(visible(page))


def _targets(page: str) -> list[str]:
    found = (_HREF.search(tag[0]) for tag in _ANCHOR.finditer(page[: page.rfind(">") + 1]))
    return [_decoded(next((x for x in m.groups() if x), "")) for m in found if m]


def response(key: object, url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = [("WARC-Target-URI", url)] if url is not None else []
    return serialise(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, date)), *target, ("WARC-Date", date),
            ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response")
        ],
        http
    )


def derive(raw: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record."""
    source, block = parse(raw)
    if source.get("warc-type") != "response":
        raise ValueError("not a response record")
    head, _, payload = block.partition(b"\r\n\r\n")
    page = payload.decode("utf-8", "replace")
    seen = visible(page)
    text = _lines(seen)
    me = source["warc-record-id"]
    kept = [(name, source[name.lower()]) for name in ("WARC-Target-URI", "WARC-Date") if name.lower() in source]
    meta_id, text_id = record_id("metadata", me), record_id("conversion", me)
    body = text.encode()
    fields = [("title", title_of(page)), ("language", language_of(page)), ("text-length", str(len(text))), ("conversion-record", text_id)]
    fields += [("outlink", x) for x in _targets(seen)] + [(f"source-{k}", v) for k, v in source.items()] + [("source-http", x) for x in head.decode("latin-1").split("\r\n")]
    meta = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    common = [*kept, ("WARC-Source-Payload-Digest", source.get("warc-payload-digest", ""))]
    return (
        serialise(
            [
                ("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), ("WARC-Refers-To", me), *common, ("WARC-Block-Digest", digest(meta)),
                ("Content-Type", "application/warc-fields")
            ],
            meta
        ),
        serialise(
            [
                ("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), ("WARC-Refers-To", me), *common, ("WARC-Block-Digest", digest(body)),
                ("Content-Type", "text/plain; charset=utf-8")
            ],
            body
        ),
    )


def response_records(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw response records of a table of pages: key, record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                k, u, h = (c.to_pylist() for c in batch.slice(at, 512).columns)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([response(*x, date) for x in zip(k, u, h, strict=True)], pa.binary())], names=["key", "record"])

    return pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page")
    ).mapInArrow(run, "key long, record binary")


FILES = "path string, records long"


def write_derivatives(responses: DataFrame, root: str) -> list[dict]:
    """Writes the derivatives of response records (key, record), a file per task; returns the manifest, a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, "", 0
        for batch in batches:
            for raw in batch.column("record"):
                if out is None:  # each attempt has a file of its own; the manifest names the one that counts
                    system, folder = filesystem(root)
                    system.create_dir(folder, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(name, compression=None)
                for record in derive(raw.as_py()):
                    z = zlib.compressobj(1, wbits=31)
                    out.write(z.compress(record) + z.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name.rsplit('/', 1)[1]}"], "records": [n]})

    return [r.asDict() for r in responses.mapInArrow(run, FILES).collect()]  # a row per file


def members(stream) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time."""
    left, z, parts = b"", zlib.decompressobj(wbits=31), []
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                break
        parts.append(z.decompress(left))
        left = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(wbits=31), []
    if any(parts):
        raise ValueError("a WARC file ends within a record")


def read_records(spark, manifest: list[dict]) -> DataFrame:
    """All records of the files: headers and block."""
    files = spark.createDataFrame([(m["path"],) for m in manifest], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = filesystem(name)
                with system.open_input_stream(place, compression=None) as f:
                    heads, blocks, size = [], [], 0
                    for raw in members(f):
                        head, block = parse(raw)
                        heads.append(list(head.items()))
                        blocks.append(block)
                        size += len(raw)
                        if size > 4 << 20:
                            yield _rows(heads, blocks)
                            heads, blocks, size = [], [], 0
                    if heads:
                        yield _rows(heads, blocks)

    return files.repartition(max(1, len(manifest))).mapInArrow(run, "headers map<string,string>, block binary")


def _rows(heads: list, blocks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["headers", "block"])


def op7_warc_derivatives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_derivatives(response_records(pages), Stage(spark, "op7").path("warc"))
    h = lambda name: F.element_at("headers", name)
    return read_records(spark, manifest).select(
        h("warc-record-id").alias("record_id"), h("warc-type").alias("warc_type"), h("warc-refers-to").alias("refers_to"), h("warc-target-uri").alias("target_uri"), h("warc-date").alias("warc_date"),
        h("warc-source-payload-digest").alias("source_payload_digest"), h("warc-block-digest").alias("block_digest"), h("content-type").alias("content_type"),
        F.octet_length("block").cast("long").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )
