"""Near-duplicate groups by MinHash with tensored banding.

A document's set is its distinct shingles of ``words`` consecutive words. Instead of computing
``tables`` x ``2 * per_half`` independent minimum hashes, two collections of ``halves`` half keys are
computed (``2 * halves * per_half`` minimum hashes) and every pair of a left and a right half key is
the key of one table: 12 + 12 half keys of three give 144 tables of six from 72 minimum hashes. A pair
of similarity s shares no table with probability below 2 * (1 - s^3)^12, that is 2 in 10^5 at 0.85
and 4 in 10^4 at 0.8.

Equal sets are one class from the start. Classes that share a key are compared on full sets: each
with the least class of its key group and with its neighbour there, never all with all. Where a key
group still holds several components, classes of different components are compared too, so no
shared key is left unanswered; only pairs whose sizes already rule a link out are left aside.

Defined results: NULL or word-less text has an empty set, links with nothing and is its own component.
Fewer words than ``words`` make one shingle of them all. Rows that repeat a doc_id are the same
document; a NULL doc_id is linked with nothing and is kept, its component is NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.columns import LOWER, NO_BLANKS, SpanHash, U64, bound_batches, flat, mix, slices
from pairloom.llm.components import components
from pairloom.session import materialize

HALVES = 12
PER_HALF = 3
WORDS = 3
PERCENT = 85
STAGE_WORDS = 5  # the stage's own rule; the two above are those of the query
STAGE_PERCENT = 80


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` words of one document; of the whole if it has fewer."""
    n = max(1, len(hashes) - words + 1) if len(hashes) else 0
    out, width = np.zeros(n, U64), min(words, len(hashes))
    for k in range(width):
        out = mix(out * U64(0x9FB21C651E98DF25) + hashes[k:k + n])
    return out


def shingle_sets(column: pa.Array, words: int):
    """Yields (row, sorted distinct shingle hashes) of every row that has words."""
    hasher = SpanHash()
    data, offsets = flat(column)
    for i, j, part, at in slices(data, offsets):
        hashes, _, _, first = hasher.words(LOWER[part], at, NO_BLANKS)
        for r in np.flatnonzero(first[:-1] < first[1:]):
            found = np.sort(shingle_hashes(hashes[first[r]:first[r + 1]], words))
            yield i + r, found[np.concatenate([[True], found[1:] != found[:-1]])]


def half_keys(sets: list[np.ndarray], halves: int, per_half: int) -> np.ndarray:
    """Sets x (2 * halves) half keys."""
    draw = np.random.default_rng(20240601)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    out = np.zeros((len(sets), 2 * halves), U64)
    for h in range(2 * halves):
        for _ in range(per_half):
            flip, odd = (np.uint32(v) for v in draw.integers(1, 1 << 32, 2))
            least = np.minimum.reduceat((x ^ flip) * (odd | np.uint32(1)), first)
            out[:, h] = mix(out[:, h] * U64(0x9FB21C651E98DF25) + least.astype(U64) + U64(h + 1))
    return out


def signatures(docs: DataFrame, words: int = WORDS, halves: int = HALVES,
               per_half: int = PER_HALF) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128-bit name of the set), keys (half keys; empty for an empty set)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys, rows, held = np.zeros((n, 2 * halves), np.int64), [], []

            def flush():
                if rows:
                    keys[rows] = half_keys(held, halves, per_half).view(np.int64)
                    rows.clear()
                    held.clear()

            for r, found in shingle_sets(batch.column(1), words):
                size[r] = len(found)
                with np.errstate(over="ignore"):
                    s1[r] = np.sum(mix(found)).view(np.int64)
                    s2[r] = np.sum(mix(found ^ U64(0x5851F42D4C957F2D))).view(np.int64)
                rows.append(r)
                held.append(found)
                if sum(map(len, held[-64:])) > 1 << 16 or len(held) >= 256:
                    flush()
            flush()
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, 2 * halves, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[size > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(s1), pa.array(s2), lists],
                names=["doc_id", "n_shingles", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def shared_keys(classes: DataFrame, halves: int) -> DataFrame:
    """(key, cid, n, least, before) of classes that share a table key with another class."""
    left = F.posexplode(F.slice("keys", 1, halves)).alias("i", "u")
    right = F.posexplode(F.slice("keys", halves + 1, halves)).alias("j", "v")
    keys = classes.select("cid", "n", "keys", left).select("cid", "n", "i", "u", right).select(
        F.xxhash64("i", "u", "j", "v").alias("key"), "cid", "n")
    order = Window.partitionBy("key").orderBy("cid")
    seen = keys.withColumns({
        "before": F.lag("cid").over(order), "after": F.lead("cid").over(order),
        "least": F.first("cid").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return seen.filter("before IS NOT NULL OR after IS NOT NULL").drop("after")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    of = lambda name: sets.select(F.col("cid").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    same = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - same
    return both.filter(100 * same >= percent * union).select("a", "b")


def across(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts that may be similar enough; ``sets``: cid, part, shingles.

    Exact prefix and position filters. With shingles in ascending order of how many sets have them,
    two sets that share enough also share one among the first few of either (fewer still on the side
    of the smaller set), and what is left after the first shared one must be enough. Shingles of one
    set alone only count as places. A group of copies with many edits each thus gives hardly a pair.
    """
    rows = sets.select("cid", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    held = rows.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = Window.partitionBy("cid")
    placed = rows.join(held, "t").withColumn("pos", (
        F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "t")) - 1))
    need = f"cast(ceil({percent} * ({{}}) / {100 + percent}) AS int)"
    probe = placed.filter(f"pos <= n - cast(ceil({percent} * n / 100) AS int)")
    probe = materialize(probe.select("t", "cid", "part", "n", "pos"), "neardup-prefixes")
    index = probe.filter(f"pos <= n - {need.format('2 * n')}").select(
        "t", *[F.col(c).alias(f"{c}_x") for c in ("cid", "part", "n", "pos")])
    near = index.join(probe, "t").filter(
        "part_x != part AND (n_x < n OR (n_x = n AND cid_x < cid))"
        f" AND 100 * n_x >= {percent} * n AND least(n_x - pos_x, n - pos) >= {need.format('n_x + n')}")
    return near.select(F.least("cid_x", "cid").alias("a"), F.greatest("cid_x", "cid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    halves: int = HALVES, per_half: int = PER_HALF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    found = materialize(signatures(docs, words, halves, per_half), "neardup-signatures")
    usable = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")),
        "neardup-classes")
    shared = materialize(shared_keys(classes, halves), "neardup-shared")

    sized = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    sizes = classes.select(F.col("cid").alias("a"), F.col("n").alias("m"))
    first = shared.filter("before IS NOT NULL").select(
        F.explode(F.array_distinct(F.array("least", "before"))).alias("a"), F.col("cid").alias("b"), "n").distinct()
    first = materialize(first.join(sizes, "a").filter(sized).select("a", "b"), "neardup-pairs")

    wanted = shared.select(F.col("cid").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")

    def sets_of(batches):
        for batch in batches:
            rows, held = [], []
            for r, s in shingle_sets(batch.column(1), words):
                rows.append(r)
                held.append(s.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *held])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), lists], names=["cid", "shingles"])

    sets = materialize(texts.mapInArrow(sets_of, "cid long, shingles array<long>").dropDuplicates(["cid"]),
                       "neardup-sets")
    links = materialize(verified(first, sets, percent), "neardup-links")

    # Key groups that still hold several components: compare across components.
    part = components(links)
    placed = shared.join(part.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "part", F.coalesce("component", "cid"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter(
        "lo < hi").select("key")
    rest = materialize(placed.join(mixed, "key").select("cid", "part").distinct(), "neardup-rest")
    more = across(sets.join(rest, "cid"), percent).join(first, ["a", "b"], "left_anti")
    links = links.union(verified(materialize(more, "neardup-pairs"), sets, percent))

    joined = classes.select("s1", "s2", "cid").join(
        components(links).withColumnRenamed("node", "cid"), "cid", "left").select(
        "s1", "s2", F.coalesce("component", "cid").alias("component_id"))
    placed = usable.select("doc_id", "n_shingles", "s1", "s2").join(joined, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles", "component_id")
    alone = found.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; of repeated rows one."""
    bound_batches(spark)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    gone = near_duplicates(docs.select(ids, "text"), STAGE_WORDS, STAGE_PERCENT).filter("NOT kept").select(
        F.col("doc_id").alias("_gone")).distinct()
    known = docs.filter("doc_id IS NOT NULL")
    stay = known.join(gone, known["doc_id"].cast("long") == gone["_gone"], "left_anti")
    return stay.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))
