"""Web archives: writing captures as WARC records, and assembling them from records.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Request
and metadata name the response in WARC-Concurrent-To; assembly joins them by it into one nested row.
Archives are gzip files of WARC/1.1 records that Spark writes and reads, so any shared store will do. A
reader holds one archive as it is stored and unpacks it as a stream, record by record.

Archives of other makers are read as well: one gzip member a record or many, or none at all; chunked
bodies and bodies without a Content-Length (the payload is what remains of the block); digests in base 32
or hex, of SHA-1 or another algorithm, or missing; blocks that aren't HTTP. ``payload_digest`` is always the hex SHA-1 of a
response's payload, and what a revisit declares, if that is SHA-1. ``verified`` says whether a response's
declared digest fits its payload as stored or without chunks (NULL without a usable one).

Of captures with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id
(then url) carries the payload, the others revisit it; they are told apart on narrow rows of digests.

Defined results: NULL html is an empty payload. A NULL page_id or url stays NULL. Each row is a capture
of its own, repeated rows too: they are told apart by their place in the input, which must
read alike twice, as tables do. Records that agree in id are one. A record without its partner has NULL there. An empty
table gives an empty archive. An archive that breaks off within a record or isn't WARC raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.session import scratch_dir

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 12_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, type string, uri string, date string, concurrent_to string, refers_to string, "
          "payload_digest string, payload_bytes long, verified boolean, block binary")


def captures(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, html, n, digest, refers_to (the rid of the response a revisit means)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn(
        "n", F.octet_length("html").cast("long"))
    own = F.struct("page_id", "url", "digest", F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("rid", F.md5(F.to_json(own).cast("binary")))
    narrow = rows.filter(F.col("n") >= REVISIT_BYTES).select("digest", F.struct("page_id", "url", "rid").alias("own"))
    top = narrow.groupBy("digest").agg(F.max("own").alias("top"), F.min("own").alias("low")).filter("top != low")
    again = narrow.join(top, "digest").filter("own.rid != top.rid").select(
        "own.rid", F.col("top.rid").alias("refers_to"))
    return rows.join(again, "rid", "left")


def _record(kind, rid: Column, block: Column, *headers: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
             F.lit(f"WARC-Date: {DATE}"), *headers,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _urn(rid: Column, part: str) -> Column:
    hex_ = F.md5(F.concat(rid, F.lit(part)).cast("binary"))
    cut = [F.substring(hex_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Three records a capture as gzip archives below ``path``."""
    # Header lines can't hold control characters; the metadata record has the url as it is.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    host, target = F.regexp_extract(url, "^[a-zA-Z]+://([^/]*)", 1), F.regexp_extract(url, "^[a-zA-Z]+://[^/]*(.*)$", 1)
    rid = F.col("rid")
    main, ask, about = _urn(rid, "response"), _urn(rid, "request"), _urn(rid, "metadata")
    uri = F.concat(F.lit("WARC-Target-URI: "), url)
    with_ = F.concat(F.lit("WARC-Concurrent-To: "), main)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), main,
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))), uri,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to"), "response"),
                                 F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"))
    request = _record(
        F.lit("request"), ask, F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target),
                                        F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
        uri, with_, F.lit("Content-Type: application/http; msgtype=request"))
    metadata = _record(F.lit("metadata"), about, F.to_json(F.struct("page_id", "url")), uri, with_,
                       F.lit("Content-Type: application/json"))
    captures(pages).select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _without_chunks(body: bytes) -> bytes:
    """A chunked body's payload; what isn't a chunk ends it."""
    out, at = [], 0
    while (stop := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            break
        out.append(body[stop + 2:stop + 2 + size])
        at = stop + 4 + size
        if size <= 0:
            break
    return b"".join(out)


def _http(block: bytes):
    """Payload as stored, payload without chunks, declared length (or None) of an HTTP message."""
    top, _, body = block.partition(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:])}
    size = head.get(b"content-length", b"")
    chunked = b"chunked" in head.get(b"transfer-encoding", b"").lower()
    return body, _without_chunks(body) if chunked else body, int(size) if size.isdigit() else None


def _declared(value: str | None):
    """Algorithm and hex digest of a digest header; None of what can't be checked."""
    name, _, digest = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None, None
    digest, width = digest.strip(), hashlib.new(name).digest_size
    if len(digest) == 2 * width:
        return name, digest.lower()
    try:
        raw = base64.b32decode(digest.upper().rstrip("=") + "=" * (-len(digest.rstrip("=")) % 8))
    except ValueError:
        return None, None
    return (name, raw.hex()) if len(raw) == width else (None, None)


def _head(stream) -> dict | None:
    """Header fields of the next record, names in lower case; None at the end of the archive."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    head, name = {}, None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:  # a folded line goes on with the one before
            head[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            head.setdefault(name, value.strip())
    return head


def parse_records(stream):
    """Rows of ``RECORD`` from an unpacked archive; blocks are cut by the record's Content-Length."""
    while (head := _head(stream)) is not None:
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"archive ends within {head.get('warc-record-id')}")
        kind, digest, size, verified = head.get("warc-type", "").lower(), None, None, None
        if kind in ("response", "revisit"):
            http = block.startswith(b"HTTP/")
            stored, payload, size = _http(block) if http else (block, block, None)
            name, digest = _declared(head.get("warc-payload-digest"))
            if kind == "response":
                own = hashlib.sha1(payload).hexdigest()
                if name:
                    verified = digest == own if name == "sha1" else hashlib.new(name, payload).hexdigest() == digest
                    if not verified and stored is not payload:
                        verified = hashlib.new(name, stored).hexdigest() == digest
                digest, size = own, len(payload)
            elif name != "sha1":
                digest = None
        yield (head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"),
               head.get("warc-concurrent-to"), head.get("warc-refers-to"), digest, size, verified, block)


def open_archive(content: pa.Buffer):
    """A stream over all gzip members of an archive, or over an archive that isn't packed."""
    raw = pa.BufferReader(content)
    if content.size >= 2 and content[:2].to_pybytes() == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 17)
    return io.BufferedReader(io.BytesIO(content.to_pybytes()))


def read_records(spark, path: str, strict: bool = False) -> DataFrame:
    """All records of the archives below ``path``; ``strict`` raises where a digest doesn't fit its payload."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for row in parse_records(open_archive(content.as_buffer())):
                    if strict and row[-2] is False:
                        raise ValueError(f"payload of {row[0]} isn't what its digest says")
                    out.append(row)
                    held += len(row[-1])
                    if held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata."""
    fields = ("record_id", "uri", "date", "block")
    answers = records.filter("type IN ('response', 'revisit')").dropDuplicates(["record_id"]).select(
        "record_id", F.struct("type", "uri", "date", "refers_to", "payload_digest", "payload_bytes",
                              "verified", "block").alias("response"))

    def partner(kind):
        return records.filter(F.col("type") == kind).dropDuplicates(["concurrent_to"]).select(
            F.col("concurrent_to").alias("record_id"), F.struct(*fields).alias(kind))

    return answers.join(partner("request"), "record_id", "left").join(partner("metadata"), "record_id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """The captures of ``pages``, written as archives to the shared folder and read back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return assemble(read_records(pages.sparkSession, path, strict=True))


def digest_rows(nested: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), uri of each capture."""
    about = F.from_json(F.col("metadata.block").cast("string"), "page_id long, url string")
    flat = nested.select("record_id", about["page_id"].alias("page_id"), "response.payload_bytes",
                         "response.payload_digest", F.col("response.type").alias("record_type"),
                         F.col("response.refers_to").alias("_refers"))
    meant = flat.filter("record_type = 'response'").select(
        F.col("record_id").alias("_refers"), F.col("page_id").alias("refers_to"))
    first = flat.filter("_refers IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                  F.lit(None).cast("long").alias("refers_to"))
    again = flat.filter("_refers IS NOT NULL").join(meant, "_refers", "left").select(*first.columns)
    return first.unionByName(again)
