"""Archives as other makers write them."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from pairloom.llm import warc


def record(kind, name, block, *more, uri="http://a.b/"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Target-URI: {uri}", *more,
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(raw):
    return hashlib.sha1(raw).digest()


def base32(raw):
    return "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1(raw)).decode()


BODY = b"<p>page</p>" * 200
CHUNKED = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(BODY[k:k + 300]), BODY[k:k + 300])
                   for k in range(0, len(BODY), 300)) + b"0\r\n\r\n"
TOP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"


def foreign():
    """name -> (record, payload or None, verified)."""
    chunks = TOP + b"Transfer-Encoding: chunked\r\n\r\n" + CHUNKED
    sha256 = "WARC-Payload-Digest: sha256:" + hashlib.sha256(BODY).hexdigest()
    return {
        "info": (record("warcinfo", "info", b"software: x\r\n"), None, None),
        "plain": (record("response", "plain", TOP + b"Content-Length: 2200\r\n\r\n" + BODY, base32(BODY)), BODY, True),
        "chunks": (record("response", "chunks", chunks, base32(BODY)), BODY, True),
        "stored": (record("response", "stored", chunks, base32(CHUNKED)), BODY, True),  # digest of the chunks
        "nolength": (record("response", "nolength", TOP + b"\r\n" + BODY), BODY, None),
        "other": (record("response", "other", TOP + b"\r\n" + BODY, sha256), BODY, True),
        "wrong": (record("response", "wrong", TOP + b"\r\n" + BODY, base32(b"x")), BODY, False),
        "odd": (record("response", "odd", TOP + b"\r\n" + BODY, "WARC-Payload-Digest: crc:12"), BODY, None),
        "dns": (record("response", "dns", b"20240101\r\n\r\n1.2.3.4", "Content-Type: text/dns", uri="dns:a.b"),
                b"20240101\r\n\r\n1.2.3.4", None),
        "empty": (record("response", "empty", b""), b"", None),
    }


@pytest.mark.parametrize("form", ["members", "one", "plain"])
def test_archives_of_other_makers(spark, tmp_path, form):
    parts = [r for r, _, _ in foreign().values()]
    parts.append(record("request", "ask", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:chunks>"))
    parts.append(record("revisit", "again", TOP + b"\r\n", base32(BODY), "WARC-Refers-To: <urn:plain>"))
    parts.append(record("revisit", "bare", b""))
    data = {"members": b"".join(gzip.compress(p) for p in parts), "one": gzip.compress(b"".join(parts)),
            "plain": b"".join(parts)}[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    (tmp_path / "nothing.warc.gz").write_bytes(b"")
    got = {r["record_id"][5:-1]: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert len(got) == len(parts)
    for name, (_, payload, verified) in foreign().items():
        assert got[name]["verified"] is verified
        if payload is not None:
            assert got[name]["payload_bytes"] == len(payload)
            assert got[name]["payload_digest"] == sha1(payload).hex()
    assert got["again"]["payload_digest"] == sha1(BODY).hex() and got["bare"]["payload_digest"] is None
    nested = {r["record_id"][5:-1]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert len(nested) == len(foreign()) - 1 + 2
    assert nested["chunks"]["request"]["record_id"] == "<urn:ask>" and nested["plain"]["request"] is None
    with pytest.raises(Exception, match="isn't what its digest says"):
        warc.read_records(spark, str(tmp_path), strict=True).collect()


@pytest.mark.parametrize("data", [record("response", "a", BODY)[:900], b"no archive"])
def test_broken_archives_raise(spark, tmp_path, data):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="archive ends within|no record begins"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_a_folded_header_goes_on():
    import io
    raw = record("response", "a", b"", "X-Note: one\r\n two").replace(b"\r\nContent", b"\nContent")
    assert [r[0] for r in warc.parse_records(io.BufferedReader(io.BytesIO(b"\r\n" + raw)))] == ["<urn:a>"]
