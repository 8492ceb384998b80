"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (each the longest known phrase and one byte
more). The set of phrases is hashed and kept as a one-permutation minimum-hash signature of 64 places;
the likeness of two fingerprints is the share of equal places among those that either has filled, an
estimate of how much of one text's dictionary helps to compress the other. The first bytes of a text and of
its edited form are parsed once.

Documents in ascending order of doc_id are dealt into ranges; a range is sorted by Spark and read as a
stream that holds two texts at a time. The first document of a range goes to the range before it as
well, so no range waits for another and no window spans the table.

Defined results: NULL text is empty; an empty text has all places open, and two empty texts are alike
(1), an empty and another one not (0). Of rows with one doc_id the order is by text digest. A NULL doc_id
has no place in the order: such a row is its own next. A single document is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

PLACES = 64
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15
OPEN = 0xFFFF
RANGES_PER_PARTITION = 8
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def parse(data: bytes, phrases: dict, hashes: list, node: int) -> int:
    """Extends the dictionary by the phrases of ``data``; returns the phrase that is still open.

    ``phrases`` maps 256 * parent + byte to 256 * phrase; ``hashes`` has a hash of each phrase's bytes.
    """
    known, n = phrases.get, 256 * len(hashes)
    for byte in data:
        key = node + byte
        found = known(key)
        if found is None:
            phrases[key] = n
            n += 256
            hashes.append(((hashes[node >> 8] + byte + 1) * MULTIPLIER) & MASK)
            node = 0
        else:
            node = found
    return node


def signature(hashes: list) -> np.ndarray:
    """Least 16-bit value in each place; ``OPEN`` where there is none."""
    x = np.array(hashes[1:], np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(30)
    out = np.full(PLACES, OPEN, np.uint16)
    value = np.minimum((x >> np.uint64(40)) & np.uint64(0xFFFF), np.uint64(OPEN - 1)).astype(np.uint16)
    np.minimum.at(out, (x >> np.uint64(58)).astype(np.int64), value)
    return out


def fingerprint(text: str) -> np.ndarray:
    hashes = [0]
    parse(text.encode(), {}, hashes, 0)
    return signature(hashes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != OPEN) | (b != OPEN)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def edited(text: str, following: str) -> tuple[int, str]:
    """Code points that stay, and the text with its last quarter from the following one's start."""
    quarter = len(text) // 4
    return len(text) - quarter, following[:quarter]


def _compare(text: str, following: str) -> tuple:
    stay, tail = edited(text, following)
    phrases, hashes = {}, [0]
    node = parse(text[:stay].encode(), phrases, hashes, 0)
    if tail == text[stay:]:
        other = hashes
    else:
        other = hashes.copy()
        parse(tail.encode(), phrases.copy(), other, node)
    parse(text[stay:].encode(), phrases, hashes, node)
    own, changed = signature(hashes), signature(other)
    digest = hashlib.sha256((text[:stay] + tail).encode()).hexdigest()
    return len(text), digest, own, changed


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to both neighbours."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    placed, parts = rows.filter("doc_id IS NOT NULL"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES_PER_PARTITION * parts
    cuts = sorted(set(placed.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)))
    cuts = [int(c) for c in cuts]
    # The range of a doc_id: how many cuts are not above it.
    at = pa.array(cuts, pa.int64())

    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at.to_numpy(), ids.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    bucket = F.arrow_udf(range_of, "int")("doc_id")
    heads = sorted(map(tuple, placed.select("doc_id").withColumn("r", bucket).groupBy("r").agg(
        F.min("doc_id")).collect()))  # one row a range
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw = [pack(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            digest = [int.from_bytes(hashlib.blake2b(r, digest_size=7).digest()) for r in raw]
            own = np.searchsorted(at.to_numpy(), ids, "right").tolist()
            out = [(r, 0, i, d, z) for r, i, d, z in zip(own, ids.tolist(), digest, raw)]
            out += [(before[i], 1, i, d, z) for i, d, z in zip(ids.tolist(), digest, raw) if i in before]
            r, tail, i, d, z = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int32()), pa.array(tail, pa.int32()), pa.array(i, pa.int64()),
                 pa.array(d, pa.int64()), pa.array(z, pa.binary())], names=["r", "tail", "doc_id", "d", "z"])

    def read(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                           (unpack(z).decode() for z in batch.column(4).to_pylist()))

    def run(batches):
        waiting, out = None, []  # the last document, its text, and what its own fingerprint was compared with
        for r, tail, doc_id, text in read(batches):
            if waiting and waiting[0] == r:
                out.append((waiting[1], *_compare(waiting[2], text), text if tail else None))
            waiting = None if tail else (r, doc_id, text)
            if len(out) > 500:
                yield _rows(out)
                out = [] if out[-1][-1] is not None else out[-1:]
        yield _rows(out)

    sorted_rows = placed.mapInArrow(deal, "r int, tail int, doc_id long, d long, z binary").repartition(
        parts, "r").sortWithinPartitions("r", "tail", "doc_id", "d")
    ordered = sorted_rows.mapInArrow(run, SCHEMA)

    def alone(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield _rows([(None, *_compare(t, t), t) for t in texts])

    return ordered.unionByName(rows.filter("doc_id IS NULL").mapInArrow(alone, SCHEMA))


def _rows(found: list) -> pa.RecordBatch:
    """Result rows; each is compared with the one after it unless it brings its next text along."""
    columns = [[] for _ in range(7)]
    for k, (doc_id, chars, digest, own, changed, text) in enumerate(found):
        if text is not None:
            following = fingerprint(text)
        elif k + 1 < len(found):
            following = found[k + 1][3]
        else:
            break
        for column, x in zip(columns, (doc_id, chars, digest, own.astype(">u2").tobytes().hex(),
                                       changed.astype(">u2").tobytes().hex(), likeness(own, changed),
                                       likeness(own, following))):
            column.append(x)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
