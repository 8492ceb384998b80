"""Exact sampling, replication, shards, batches and corpus capping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.draws import digest
from pairloom.functions.text import norm_query
from pairloom.operators.numbering import number_by_hash, number_rows
from pairloom.session import materialize

CUT_BITS = 13  # places of a hash that one pass over the keys looks at
CUT_ROWS = 10_000  # hashes that are ordered on the driver
HASH_BITS = 60


def _keys(df: DataFrame, seed: int, salt: str, pos: str, *more: str) -> DataFrame:
    """Positions with their digest and its first ``HASH_BITS`` bits as a number."""
    key = digest(seed, salt, F.col(pos))
    return df.select(F.col(pos).alias("_pos"), key.alias("_hash"),
                     F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("_h"), *more)


def _cut(keys: DataFrame, wanted) -> tuple[str, int] | None:
    """(digest, position) of the last key to keep, in order of digest and position; None: keep all.

    ``wanted`` maps the number of keys to the number to keep. ``keys`` is a written narrow table. Each
    pass counts the next bits of the hashes that share the cut's leading bits (at most 2^CUT_BITS
    counts), until few keys are left to order.
    """
    shift, part, before, n = HASH_BITS, keys, 0, None
    while True:
        shift = max(0, shift - CUT_BITS)
        counts = sorted(part.groupBy(F.shiftright("_h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if n is None:
            total = sum(r["n"] for r in counts)
            n = wanted(total)
            if n >= total:
                return None
            if n <= 0:
                return ("", 0)
        for row in counts:
            if before + row["n"] >= n:
                break
            before += row["n"]
        low = row["b"] << shift
        part = keys.filter((F.col("_h") >= low) & (F.col("_h") < low + (1 << shift)))
        if row["n"] <= CUT_ROWS or shift == 0:
            last = part.orderBy("_hash", "_pos").offset(int(n - before) - 1).limit(1).first()
            return (last["_hash"], last["_pos"])


def sample_exact(df: DataFrame, ratio: float | None = None, n: int | None = None, seed: int = 0,
                 salt: str = "sample", pos: str = "pos") -> DataFrame:
    """Exactly ``floor(rows * ratio)`` (or ``n``) rows without replacement.

    The rows with the smallest digests of ``pos`` are kept. The input is read twice: its positions once, to
    write their digests down and find the last one to keep, and then the rows, which are only filtered, never shuffled.
    """
    if (ratio is None) == (n is None):
        raise ValueError("give exactly one of ratio and n")
    keys = materialize(_keys(df, seed, salt, pos), "sample")
    last = _cut(keys, (lambda rows: n) if ratio is None else (lambda rows: math.floor(rows * ratio)))
    if last is None:
        return df  # fewer rows than wanted
    key = digest(seed, salt, F.col(pos))
    return df.filter((key < last[0]) | ((key == last[0]) & (F.col(pos) <= last[1])))


def copies_in_place(df: DataFrame, copies: int, pos: str = "pos") -> DataFrame:
    """The rows ``copies`` times, one full pass after the other, without a shuffle.

    ``pos = copy * span + pos``, where span is the width of the input's positions: unique, in order, with the
    input's gaps. Use :func:`replicate_k` where the numbers must be dense.
    """
    edge = df.agg(F.min(pos).alias("low"), F.max(pos).alias("high")).first()
    low, high = (edge["low"] or 0), (edge["high"] or 0)
    span = high - low + 1
    if copies * span >= 1 << 63:
        raise ValueError(f"positions from {low} to {high} leave no room for {copies} copies")
    copied = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return copied.withColumn(pos, F.col("copy") * F.lit(span) + (F.col(pos) - F.lit(low)))


def replicate_k(df: DataFrame, copies: int, seed: int | None = None, pos: str = "pos") -> DataFrame:
    """The rows ``copies`` times, one full pass after the other: ``pos = copy * rows + place``.

    The place is the row's rank in ``pos`` order, or in a seeded random order if a seed is given.
    """
    if seed is None:
        placed = number_rows(df, pos, name="_place", total="_rows")
    else:
        placed = number_by_hash(df, seed, "order", pos, name="_place", total="_rows")
    copied = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return copied.withColumn(pos, F.col("copy") * F.col("_rows") + F.col("_place")).drop(
        "_place", "_rows")


def dev_split(df: DataFrame, dev_ratio: float, seed: int, pos: str = "pos",
              train: DataFrame | None = None, disjoint: bool = False) -> DataFrame:
    """Second exact sample for the dev split.

    It is drawn from the full corpus, so it may overlap the train split. ``disjoint`` drops the
    rows of ``train`` first (an extension).
    """
    pool = df.join(train.select(pos), pos, "left_anti") if disjoint else df
    return sample_exact(pool, ratio=dev_ratio, seed=seed, salt="dev", pos=pos)


def shard_of(place: Column, rows: Column, shard_size: int) -> Column:
    """Shard of a row: ``max(rows // size, 1)`` even shards, the last takes the remainder."""
    shards = F.greatest(F.floor(rows / F.lit(shard_size)), F.lit(1))
    length = F.greatest(F.floor(rows / shards), F.lit(1))
    return F.least(F.floor(place / length), shards - 1).cast("int")


def shard_assign(df: DataFrame, shard_size: int, pos: str = "pos",
                 rows: int | None = None) -> DataFrame:
    """Adds ``shard_id``. If ``pos`` already counts 0..rows-1, give ``rows``: nothing moves then."""
    if rows is not None:
        return df.withColumn("shard_id", shard_of(F.col(pos), F.lit(rows), shard_size))
    placed = number_rows(df, pos, name="_place", total="_rows")
    return placed.withColumn(
        "shard_id", shard_of(F.col("_place"), F.col("_rows"), shard_size)).drop("_place", "_rows")


def shard_missing(shards: DataFrame, done: DataFrame) -> DataFrame:
    """Shard ids without output yet, the work left after an interruption."""
    wanted = shards.select("shard_id").distinct()
    return wanted.join(done.select("shard_id").distinct(), "shard_id", "left_anti")


class IncompleteShards(RuntimeError):
    pass


def shard_complete(shards: DataFrame, done: DataFrame) -> DataFrame:
    """One row with the shard counts of both sides and whether they match."""
    both = shards.select(F.col("shard_id"), F.lit(1).alias("w")).distinct().unionByName(
        done.select(F.col("shard_id"), F.lit(0).alias("w")).distinct())
    counts = both.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("shards"),
                      F.coalesce(F.sum(1 - F.col("w")), F.lit(0)).alias("done"))
    return counts.withColumn("complete", F.col("shards") == F.col("done"))


def require_complete(shards: DataFrame, done: DataFrame) -> None:
    row = shard_complete(shards, done).first()
    if not row["complete"]:
        raise IncompleteShards(f"{row['done']} of {row['shards']} shards have output")


def corpus_cap(corpus: DataFrame, qrels: DataFrame, max_corpus_size: int, seed: int = 0,
               pos: str = "pos") -> DataFrame:
    """Keep every relevant document of the corpus and fill up to the cap with a random remainder.

    Ids and positions are read once and written down with a mark for relevant ones; the rows are read once
    more and meet the positions to keep.
    """
    relevant = qrels.filter("score >= 1").select(F.col("corpus_id").alias("_id")).distinct()
    marked = corpus.select("_id", pos).join(relevant.withColumn("_needed", F.lit(True)), "_id", "left")
    keys = materialize(_keys(marked, seed, "cap", pos, "_needed"), "cap")
    needed = keys.filter("_needed").count()
    if needed > max_corpus_size:
        raise ValueError(f"the cap {max_corpus_size} is below the {needed} relevant documents")
    last = _cut(keys.filter("_needed IS NULL"), lambda rows: max_corpus_size - needed)
    kept = keys if last is None else keys.filter(
        F.col("_needed") | (F.col("_hash") < last[0]) | ((F.col("_hash") == last[0]) & (F.col("_pos") <= last[1])))
    return corpus.join(kept.select(F.col("_pos").alias(pos)), pos, "left_semi")


def shuffle_batches(df: DataFrame, batch_size: int, seed: int, pos: str = "pos") -> DataFrame:
    """Seeded random order cut into batches: adds ``row_id`` and ``batch_id``."""
    shuffled = number_by_hash(df, seed, "batch", pos, name="row_id")
    return shuffled.withColumn("batch_id", F.floor(F.col("row_id") / F.lit(batch_size)))


def batch_of_pos(df: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batches in ``pos`` order: ``batch_id = place // batch_size``."""
    placed = number_rows(df, pos, name="row_id")
    return placed.withColumn("batch_id", F.floor(F.col("row_id") / F.lit(batch_size)))


FEW_ROWS = 4096  # a rest this small is dealt in one task


def _dealt(rest: DataFrame, batch_size: int, batches: int, base: int, seed: int) -> DataFrame:
    """``rest`` with a batch and whether the row may stay there, decided row by row in each batch."""
    order = number_by_hash(rest, seed, "deal", "_pos", name="_place")
    batch = (F.lit(base) + F.col("_place") % F.lit(batches)).alias("batch_id")
    schema = "_pos long, _texts array<binary>, batch_id long, kept boolean"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, size = None, set(), 0
        for frame in frames:
            kept = []
            for number, texts in zip(frame.column("batch_id").to_pylist(), frame.column("_texts").to_pylist()):
                if number != current:
                    current, seen, size = number, set(), 0
                stays = size < batch_size and seen.isdisjoint(texts)
                if stays:
                    seen.update(texts)
                    size += 1
                kept.append(stays)
            yield pa.RecordBatch.from_arrays(
                [frame.column(c) for c in ("_pos", "_texts", "batch_id")] + [pa.array(kept, pa.bool_())],
                names=["_pos", "_texts", "batch_id", "kept"])

    return order.select("_pos", "_texts", batch, "_place").repartition("batch_id").sortWithinPartitions(
        "batch_id", "_place").mapInArrow(run, schema)


def _first_fit(rest: DataFrame, batch_size: int, base: int) -> DataFrame:
    """A few rows, each in the first batch from ``base`` on that has room and none of its texts."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of: list[set] = []
        sizes: list[int] = []
        first = 0  # all batches before it are full
        for frame in frames:
            place = []
            for texts in frame.column("_texts").to_pylist():
                while first < len(sizes) and sizes[first] == batch_size:
                    first += 1
                at = next((i for i in range(first, len(sizes))
                           if sizes[i] < batch_size and texts_of[i].isdisjoint(texts)), len(sizes))
                if at == len(sizes):
                    texts_of.append(set())
                    sizes.append(0)
                texts_of[at].update(texts)
                sizes[at] += 1
                place.append(base + at)
            yield pa.RecordBatch.from_arrays([frame.column("_pos"), pa.array(place, pa.int64())],
                                             names=["_pos", "batch_id"])

    return rest.repartition(1).sortWithinPartitions("_pos").mapInArrow(run, "_pos long, batch_id long")


def nodup_batches(triplets: DataFrame, batch_size: int, columns: list[str], pos: str = "pos",
                  seed: int = 0, few_rows: int = FEW_ROWS) -> DataFrame:
    """Adds ``batch_id``: batches of at most ``batch_size`` rows in which no text occurs in two rows.

    Texts are compared stripped and in lower case, across all columns: a row's negative may not be another
    row's positive. A row may hold a text twice itself; NULL texts meet nothing. Every row is in exactly one batch.

    Rows are dealt in a seeded random order to as many batches as their number, or their most
    frequent text, asks for. In each batch a row that meets a text of an earlier one has to leave; the
    rows that left are dealt again to batches of their own. A round keeps at least one row a batch, as
    a rule all but those that share texts, so the rest shrinks by a factor however often one text
    occurs; a rest of at most ``few_rows`` ends in one task. Rounds work on positions and digests, each
    in one exchange by batch; each is written down.
    """
    digests = F.array_compact(F.array(*[F.unhex(F.sha2(norm_query(F.col(c)), 256)) for c in columns]))
    rest = materialize(triplets.select(F.col(pos).alias("_pos"), F.array_distinct(digests).alias("_texts")), "texts")
    placed, base, round_ = [], 0, 0
    while True:
        one = rest.select(F.posexplode_outer("_texts").alias("i", "text"))
        per_text = one.groupBy("text").agg(F.count("text").alias("n"), F.count_if(
            F.coalesce(F.col("i"), F.lit(0)) == 0).alias("rows"))
        found = per_text.agg(F.sum("rows").alias("rows"), F.max("n").alias("most")).first()
        rows, most = found["rows"] or 0, found["most"] or 0
        if rows <= few_rows:
            placed.append(_first_fit(rest, batch_size, base))
            break
        batches = max(-(-rows // batch_size), most)
        dealt = materialize(_dealt(rest, batch_size, batches, base, seed + round_), "dealt")
        placed.append(dealt.filter("kept").select("_pos", "batch_id"))
        rest = dealt.filter("not kept").select("_pos", "_texts")
        base, round_ = base + batches, round_ + 1
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return triplets.join(found.withColumnRenamed("_pos", pos), pos)
