"""Dense numbering without a single-task window.

Rows are cut into buckets of bounded size and the buckets are counted (a partial aggregate). The counts
get prefix sums level by level: buckets within a parent of 2^LEVEL_BITS buckets, parents within theirs, and
so on until at most 2^TOP_BITS are left, the only ones that meet in one task. That holds for any BIGINT,
however far apart the positions lie. Each row's number is its bucket's offset plus its place inside the bucket.

The input is read twice, for the counts by its key columns only; write an expensive one down first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.draws import digest

BUCKET_BITS = 17  # buckets of up to 131,072 positions
HASH_DIGITS = 5  # 1,048,576 even buckets
LEVEL_BITS = 17
TOP_BITS = 13


def _offsets(counts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``counts`` (keys, _b of ``width`` bits, _n) with ``_offset``, the rows of the key in smaller buckets,
    and ``_total``, all rows of the key."""
    before = lambda *by: Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *by: F.coalesce(F.sum("_n").over(before(*by)), F.lit(0))
    if width <= TOP_BITS:
        return counts.withColumn("_offset", inside(*keys)).withColumn(
            "_total", F.sum("_n").over(Window.partitionBy(*keys)))
    bits = min(LEVEL_BITS, width - TOP_BITS)
    placed = counts.withColumn("_parent", F.shiftright("_b", bits)).withColumn("_inside", inside(*keys, "_parent"))
    # Their sums come out of the windows, which lie by parent already: no further exchange.
    parents = placed.groupBy(*keys, "_parent").agg(F.max(F.col("_inside") + F.col("_n")).alias("_n"))
    above = _offsets(parents.withColumnRenamed("_parent", "_b"), keys, width - bits).select(
        *[F.col(k).alias(f"_p{k}") for k in keys], F.col("_b").alias("_p"), F.col("_offset").alias("_above"),
        "_total")
    match = F.col("_parent") == F.col("_p")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_p{key}"))
    return placed.join(above, match).withColumn("_offset", F.col("_above") + F.col("_inside")).select(
        *keys, "_b", "_n", "_offset", "_total")


def _number(df: DataFrame, keys: list[str], bucket: Column, width: int, order: list, name: str,
            total: str | None) -> DataFrame:
    cut = df.withColumn("_bucket", bucket)
    named = [f"_k_{k}" for k in keys]
    counts = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)],
                         F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, named, width)
    offsets = offsets.drop("_n", *([] if total else ["_total"]))
    if total:
        offsets = offsets.withColumnRenamed("_total", total)
    match = F.col("_bucket") == F.col("_b")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    placed = cut.join(offsets, match).drop("_b", *named)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = placed.withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    return numbered.drop("_bucket", "_offset")


def number_rows(df: DataFrame, pos: str = "pos", keys: list[str] | None = None,
                name: str = "row_id", bits: int = BUCKET_BITS,
                total: str | None = None) -> DataFrame:
    """Number rows 0.. in ``pos`` order, within each key if keys are given.

    ``pos`` is a unique BIGINT, so a bucket holds at most 2^bits rows whatever the keys are:
    a key with a third of all rows is spread over many buckets. ``total`` names an optional
    column with the number of rows of the key.
    """
    bucket = F.shiftright(F.col(pos).cast("long"), bits)
    return _number(df, keys or [], bucket, 64 - bits, [F.col(pos)], name, total)


def number_by_hash(df: DataFrame, seed: int, salt: str, pos: str = "pos",
                   name: str = "row_id", total: str | None = None) -> DataFrame:
    """Number rows 0.. in a seeded random order (order of a digest of ``pos``)."""
    keyed = df.withColumn("_hash", digest(seed, salt, F.col(pos)))
    bucket = F.conv(F.substring("_hash", 1, HASH_DIGITS), 16, 10).cast("long")
    return _number(keyed, [], bucket, 4 * HASH_DIGITS, [F.col("_hash"), F.col(pos)], name, total).drop("_hash")


