"""Operator 10: WARC derivatives.

Every ``response`` record yields two linked records:

* ``metadata`` (application/warc-fields): the source's HTTP status and headers, its
  payload type, length and digest, all its WARC headers (``source-...`` lines) and the id of
  the conversion,
* ``conversion`` (text/plain): the visible text of an HTML or plain-text payload, with
  scripts, styles and markup removed and character references decoded.

Both keep ``WARC-Target-URI`` and ``WARC-Date`` of the source and point to it by
``WARC-Refers-To``; the metadata names the conversion by ``WARC-Concurrent-To``.
``WARC-Block-Digest`` is the SHA-1 (base 32) of the record's own block. A payload or
block digest that the source declares is carried as it is (``WARC-Source-Payload-Digest``,
``WARC-Source-Block-Digest``); without one the payload's digest is computed from its bytes. The
text is decoded with the charset of the HTTP header (UTF-8 if there is none or it is unknown).
Record ids are name-based (from the source id, the kind and the block), so a task that
runs again gives the same records, and the job is one narrow pass over the responses.

Records are ``(record_id, record_type, refers_to, target_uri, warc_date, headers,
block)``: ``headers`` is an array of (name, value), ``block`` binary. ``write_warc``
writes them as WARC/1.1 files with Spark's text writer (optionally gzip).

``read_warc`` reads WARC/1.0 and 1.1 files, responses as well as derivatives, plain or gzip, by
their Content-Length. Files are cut at ``CRLF CRLF WARC/1.``, which is a record's end
unless it stands within a block; then the block is shorter than its header says. Only the
pieces of files in which that happens are dealt by file, put back in order and joined up to the
length, record by record; all others are read in place.

Edge cases: a null block is an empty one; a response without an HTTP header has no
status and headers and its whole block as payload; payloads of other types (or a
status other than 200) get metadata without a conversion; a null target or date leaves
its header out; a null record id is replaced by one made from target and block; repeated
responses give repeated records; other columns are not read. Empty tables give empty
results. A record cut off at the end of its file is read with ``complete`` false; one without
Content-Length ends where the next record seems to start.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, written
from .markup import blocks, parse

RECORD = ("record_id string, record_type string, refers_to string, target_uri string, warc_date string, "
          "headers array<struct<name:string,value:string>>, block binary")
_HEADER = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = (pa.string(),) * 5 + (_HEADER, pa.binary())
_NAMES = ("record_id", "record_type", "refers_to", "target_uri", "warc_date", "headers", "block")
INVISIBLE = frozenset("head script style noscript template iframe svg object textarea select title xmp".split())
CRLF = "\r\n"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def header_lines(head: bytes) -> list:
    """[(name, value)] of header lines; a folded line goes on with the one before."""
    fields: list = []
    for line in head.decode("utf-8", "replace").split(CRLF):
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif colon:
            fields.append((name.strip(), value.strip()))
    return fields


def split_http(block: bytes) -> tuple:
    """(status line, [(name, value)], payload) of a response block."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    return status.decode("utf-8", "replace"), header_lines(lines), payload


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s;\"']+)", re.IGNORECASE)


def decoded(payload: bytes, content_type: str) -> str:
    """The payload's text in the charset of its content type."""
    m = _CHARSET.search(content_type)
    try:
        codec = codecs.lookup(m[1]) if m else None
    except (LookupError, ValueError):
        codec = None
    name = codec.name if codec is not None and getattr(codec, "_is_text_encoding", True) else "utf-8"
    return payload.decode(name, "replace")


def visible_text(payload: str, media_type: str) -> str:
    """Lines of visible text; plain text as it is."""
    if media_type == "text/plain":
        return payload
    return "\n".join(blocks(parse(payload), lambda e, _: e.tag in INVISIBLE))


CONVERTED = ("text/html", "application/xhtml+xml", "text/plain")


def derive(source: str | None, target: str | None, date: str | None, block: bytes | None, headers: list | None = None) -> list:
    """The records (columns of ``RECORD``) derived from one response; ``headers`` are the
    (name, value) pairs of the source record, if it has any."""
    block = block or b""
    headers = [(h["name"], h["value"] or "") for h in headers or () if h and h["name"]]
    declared = {n.lower(): v for n, v in reversed(headers)}
    source = source or record_id("response", target or "", block.decode("utf-8", "surrogateescape"))
    status, fields, payload = split_http(block)
    content_type = {n.lower(): v for n, v in fields}.get("content-type", "")
    media_type = content_type.split(";")[0].strip().lower() or ("text/html" if not status else "")
    code = status.split(" ")[1] if status.count(" ") else ""
    source_digest = declared.get("warc-payload-digest") or digest(payload)
    common = [(n, v) for n, v in (("WARC-Target-URI", target), ("WARC-Date", date)) if v is not None]
    origin = [("WARC-Source-Payload-Digest", source_digest)]
    if "warc-block-digest" in declared:
        origin.append(("WARC-Source-Block-Digest", declared["warc-block-digest"]))
    if "warc-warcinfo-id" in declared:
        common.append(("WARC-Warcinfo-ID", declared["warc-warcinfo-id"]))
    out: list = []

    def record(kind: str, media: str, text: str, more: list) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        own = record_id(source, kind, text)
        out.append((own, kind, source, target, date, [
            ("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", source), *more,
            *origin, ("WARC-Block-Digest", digest(raw)),
            ("Content-Type", media), ("Content-Length", str(len(raw)))], raw))
        return own

    linked = []
    if media_type in CONVERTED and code in ("", "200"):
        own = record("conversion", "text/plain; charset=utf-8", visible_text(decoded(payload, content_type), media_type), [])
        linked = [("WARC-Concurrent-To", own)]
    lines = ([("http-status", status)] if status else []) + [(f"http-{n.lower()}", v) for n, v in fields]
    lines += [("payload-type", media_type), ("payload-length", str(len(payload))), ("payload-digest", source_digest)]
    lines += [(f"source-{n.lower()}", v) for n, v in headers]
    record("metadata", "application/warc-fields", "".join(f"{n}: {v}{CRLF}" for n, v in lines), linked)
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """The derived records (``RECORD``) of responses with the columns record_id,
    target_uri, warc_date, block (binary or string) and, if they have it, headers (array
    of name and value), as ``read_warc`` gives them."""
    prepare(responses.sparkSession)
    given = dict(responses.dtypes).get("headers", "").startswith("array<struct<name:string,value:string")
    columns = ["record_id", "target_uri", "warc_date", "block", *(["headers"] if given else [])]

    def run(batches):
        for b in batches:
            rows = [r for x in zip(*(b.column(c).to_pylist() for c in columns)) for r in derive(*x)]
            cols = zip(*rows) if rows else ((),) * len(_NAMES)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], names=list(_NAMES))

    return map_batches(responses.withColumn("block", F.col("block").cast("binary")).select(*columns), run, RECORD)


def header_value(name: str) -> Column:
    """Value of the first header of that name."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def digests(records: DataFrame) -> DataFrame:
    """Records with their links, lengths and digests, without the texts."""
    return records.select(
        "record_id", "record_type", "refers_to", "target_uri",
        header_value("WARC-Concurrent-To").alias("concurrent_to"),
        header_value("WARC-Source-Payload-Digest").alias("source_digest"),
        header_value("WARC-Block-Digest").alias("block_digest"),
        header_value("Content-Length").cast("long").alias("content_length"),
        F.length(F.col("block").cast("string")).cast("long").alias("n_chars"))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stand-in input: each page as the response of a crawl at ``date``."""
    html = F.coalesce("html", F.lit(""))
    name = F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), "url"), 256)
    part = lambda a, n: F.substr(name, F.lit(a), F.lit(n))
    uid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(uid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
                        F.concat(head, html).cast("binary").alias("block"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """One WARC/1.1 file per partition; records end with two line breaks."""
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    head = F.concat(F.lit("WARC/1.1\r\n"), F.array_join(lines, CRLF), F.lit(CRLF * 2))
    # Bytes in a string column: Spark's text writer puts them out as they are.
    value = F.concat(head.cast("binary"), F.coalesce(F.col("block").cast("binary"), F.lit(b""))).cast("string")
    records.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


_VERSION = re.compile(rb"\A(?:WARC/1\.)?[0-9]+\r\n")
_START = b"\r\n\r\nWARC/1."


def _length(fields: list) -> int | None:
    """The Content-Length of header pairs, if it is a number."""
    return next((int(v) for n, v in fields if n.lower() == "content-length" and v.isdigit() and len(v) < 18), None)


def _record(piece: bytes) -> tuple:
    """(headers, block, Content-Length, whether the block is as long) of a piece from its version line on.
    What stands after the declared length, the line breaks at a file's end, is cut off."""
    head, _, block = _VERSION.sub(b"", piece, 1).partition(b"\r\n\r\n")
    fields = header_lines(head)
    size = _length(fields)
    return (fields, block, None, False) if size is None else (fields, block[:size], size, len(block) >= size)


def _is_record(piece: bytes) -> bool:
    return bool(_VERSION.match(piece))


def _joined(pieces):
    """Records from (file, piece) in the order of the files: pieces are joined until the block is as
    long as its header says."""
    of, held = None, []

    def record(parts):
        return _record(_START.join(parts))

    need = 0
    for file, piece in pieces:
        if held and file == of and need > 0:
            held.append(piece)
            need -= len(_START) + len(piece)
            continue
        if held:
            yield record(held)
            held = []
        if not piece.strip():                            # line breaks between records
            continue
        of, held = file, [piece]
        _, block, size, _ = _record(piece)
        need = 0 if size is None else size - len(block)
    if held:
        yield record(held)


_READ = RECORD + ", complete boolean"


def _batch(rows: list) -> pa.RecordBatch:
    def of(fields, name):
        return next((v for n, v in fields if n.lower() == name), None)

    names = ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-date")
    cols = [pa.array([of(f, n) for f, *_ in rows], pa.string()) for n in names]
    cols += [pa.array([f for f, *_ in rows], _HEADER), pa.array([b for _, b, *_ in rows], pa.binary()), pa.array([ok for *_, ok in rows], pa.bool_())]
    return pa.record_batch(cols, names=[*_NAMES, "complete"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (``RECORD``) of WARC files, with ``complete``: the block has the length
    that its header gives."""
    raw = spark.read.option("lineSep", _START.decode()).text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))

    def torn(batches):
        """Files with a piece that is no whole record."""
        for b in batches:
            bad = {f for p, f in zip(b.column("piece").to_pylist(), b.column("file").to_pylist()) if not (_is_record(p) and _record(p)[3])}
            yield pa.record_batch({"file": pa.array(sorted(bad), pa.string())})

    def whole(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                yield _batch([_record(p) for p in b.column("piece").slice(k, 64).to_pylist()])

    def stitched(batches):
        rows = []
        for r in _joined((f, p) for b in batches for f, p in zip(b.column("file").to_pylist(), b.column("piece").to_pylist())):
            rows.append(r)
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    files = written(map_batches(pieces.select("piece", "file"), torn, "file string").distinct(), "torn")
    good = map_batches(pieces.join(files, "file", "left_anti").select("piece"), whole, _READ)
    if files.isEmpty():
        return good
    bad = pieces.join(files, "file", "left_semi").repartition("file").sortWithinPartitions("file", "at", "nth").select("file", "piece")
    return good.unionByName(map_batches(bad, stitched, _READ))
