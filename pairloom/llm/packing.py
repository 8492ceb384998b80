"""Packing token pieces into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths,
as attention stays inside a document). Pieces are placed in descending length into the open sequence
that every capacity admits and that the rule likes best: ``norm`` takes the smallest weighted norm
of what would be left, ``dot`` the largest weighted dot product of demand and what is left.

A piece's demands follow from its length alone, so pieces of one length are alike. Only the counts
per length (at most ``capacity`` numbers, however large the corpus) go to the driver, where equal
sequences are handled as one pattern with a count. Every step uses up a length or a pattern, so there
are at most two new patterns a length, and a pattern holds less than sqrt(2 * capacity) lengths: that
bounds the table of places that is broadcast. Pieces find their place by their rank within their
length; a length that a third of all pieces share is ranked in many buckets.

Defined results: NULL text is empty, and an empty text is the end id alone. Rows are documents of
their own even where a doc_id is repeated or NULL. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.columns import bound_batches, flat, slices
from pairloom.llm.subwords import Subwords, default_path
from pairloom.session import materialize

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 20_000


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (with_ids) ids of every piece of every document."""
    path = tokenizer or default_path()

    def run(batches):
        coder = Subwords(path)
        for batch in batches:
            owners = batch.column(0)
            data, offsets = flat(batch.column(1))
            for i, j, part, at in slices(data, offsets, 1 << 19):
                ids, first = coder.ids(part, at)
                ids, ends = np.insert(ids, first[1:], end_id), first[1:] + np.arange(1, j - i + 1)
                begins = np.concatenate([[0], ends[:-1]])
                number = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(j - i), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                low = begins[row] + start
                high = np.minimum(low + capacity, ends[row])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(low.tolist(), high.tolist())]
                columns = [owners.take(pa.array(i + row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(high - low), pa.array(np.array(crc, np.int64))]
                if with_ids:
                    cuts = np.concatenate([low, high[-1:]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[:len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


def best_fit(counts: dict[int, int], capacity: int, max_documents: int, max_attention: int,
             weights: tuple, rule: str) -> dict[str, np.ndarray]:
    """Places of pieces by (length, rank): the row of the greatest first rank not above it holds."""
    room = np.array([capacity, max_documents, max_attention], np.int64)
    scale = np.sqrt(np.array(weights)) / room
    rest, bins = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    patterns: list[list[tuple[int, int]]] = []
    closed: list[tuple[int, list]] = []
    lengths = sorted(counts, reverse=True)
    for length in lengths:
        left, need = counts[length], np.array([length, 1, length * length], np.int64)
        if (need > room).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        live = rest[:, 0] >= lengths[-1]
        if not live.all():
            closed += [(int(m), p) for m, p, on in zip(bins, patterns, live) if not on]
            patterns = [p for p, on in zip(patterns, live) if on]
            rest, bins = rest[live], bins[live]
        while left:
            fits = np.flatnonzero((rest >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    badness = (((rest[fits] - need) * scale) ** 2).sum(axis=1)
                else:
                    badness = -((rest[fits] * scale) * (need * scale)).sum(axis=1)
                best = int(fits[badness.argmin()])
                state, held, own = rest[best], int(bins[best]), patterns[best]
            else:
                best, state, held, own = -1, room, left, []
            each = int((state // need).min())
            full = min(held, left // each)
            over = min(left - full * each, each) if full < held else 0
            new = [(full, each)] * bool(full) + [(1, over)] * bool(over)
            left -= full * each + over
            made = [(state - k * need, m, [*own, (length, k)]) for m, k in new]
            if best >= 0:
                bins[best] -= full + bool(over)
                if not bins[best]:
                    bins[best] = made[0][1]
                    rest[best], patterns[best] = made[0][0], made[0][2]
                    made = made[1:]
            for r, m, p in made:
                rest, bins = np.vstack([rest, r]), np.append(bins, m)
                patterns.append(p)
    rows, rank, sequence = [], dict.fromkeys(lengths, 0), 0
    for m, pattern in closed + list(zip(bins.tolist(), patterns)):
        offset = 0
        for length, k in pattern:
            rows.append((length, rank[length], k, sequence, offset))
            rank[length] += m * k
            offset += length * k
        sequence += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_documents: int = CAPACITY,
         max_attention: int = CAPACITY * CAPACITY, weights: tuple = (1.0, 0.001, 0.001),
         rule: str = "norm") -> DataFrame:
    """``pieces`` (written, narrow, with ``length``) with sequence_id and offset.

    The defaults for documents and attention bind no sequence that the tokens admit.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = best_fit(counts, capacity, max_documents, max_attention, weights, rule)
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    order = sorted(set(pieces.columns) - {"length"})
    cut = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = cut.join(offsets, ["length", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside) - 1)
    shared = pieces.sparkSession.sparkContext.broadcast(places)

    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        p = shared.value
        keys = (p["length"] << 44) + p["rank"]
        rank = rank.to_numpy(zero_copy_only=False)
        length = length.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
        turn, place = np.divmod(rank - p["rank"][at], p["each"][at])
        return pa.StructArray.from_arrays(
            [pa.array(p["sequence"][at] + turn), pa.array(p["offset"][at] + place * length)],
            names=["sequence_id", "offset"])

    found = F.arrow_udf(run, "sequence_id long, offset long")("length", "_rank")
    return ranked.withColumn("_at", found).select(*pieces.columns, "_at.*")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of whole sequences, from placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer, with_ids=False), "packing-pieces"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places."""
    bound_batches(spark)
    return pack_documents(docs)
