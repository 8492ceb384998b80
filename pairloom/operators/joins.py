"""Equi joins of a skewed side with sides that are unique per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize

HOT_ROWS = 1_000_000
NULL_SALTS = 4096


def hot_keys(left: DataFrame, keys: list[list[str]], hot_rows: int) -> list[DataFrame | None]:
    """For each list of key columns its keys with more than ``hot_rows`` rows and their ``_salts``.

    All lists are counted in one pass over ``left``; at most rows / hot_rows keys can be hot in each. Hot keys
    are written down together. None stands for a list without a hot key.
    """
    sets = [list(k) for k in dict.fromkeys(map(tuple, keys))]
    columns = list(dict.fromkeys(c for k in sets for c in k))
    of = lambda k: F.array(*[F.lit(int(c not in k)) for c in columns])
    counts = left.groupingSets([[F.col(c) for c in k] for k in sets], *columns).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.grouping(c).cast("int") for c in columns]).alias("_of"))
    hot = counts.filter(F.col("_n") > hot_rows).withColumn(
        "_salts", F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int"))
    found = {tuple(r[0]) for r in hot.select("_of").distinct().collect()}  # at most one row per list
    if found:
        hot = materialize(hot, "hot")
    return [hot.filter(F.col("_of") == of(k)).select(*k, "_salts")
            if tuple(int(c not in k) for c in columns) in found else None for k in keys]


def _join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, spread: str,
          how: str) -> DataFrame:
    hashed = F.xxhash64(F.col(spread))
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    if how == "inner":
        left = left.filter(~missing)
    apart = -1 - F.pmod(hashed, F.lit(NULL_SALTS)).cast("int")
    if hot is None:
        if how == "inner":
            return left.join(right, on)
        return left.withColumn("_salt", F.when(missing, apart).otherwise(0)).join(
            right.withColumn("_salt", F.lit(0)), [*on, "_salt"], how).drop("_salt")
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(hashed, F.col("_salts")).cast("int"), F.lit(0))
    salted = left.join(hot, on, "left").withColumn("_salt", F.when(missing, apart).otherwise(salt)).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    return salted.join(right.join(hot, on, "left").withColumn("_salt", copies).drop("_salts"),
                       [*on, "_salt"], how).drop("_salt")


def join_chain(left: DataFrame, rights: list[tuple[DataFrame, list[str]]], spread: str, how: str = "left",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` with one frame after the other (each has one row per key), splitting hot keys of ``left``.

    Keys with more than ``hot_rows`` rows are cut into ``ceil(rows / hot_rows)`` salts by a hash
    of ``spread`` (a column of ``left`` that is unique, so a retried task salts alike); only
    their one row on the right is copied per salt. ``left`` is read once for the hot keys of all joins
    and once for the joins: write it down first if it is expensive, and keep it narrow. Without hot keys the joins are plain
    ones. Rows with a NULL key match nothing; they are spread over negative salts, which the right sides don't have.
    """
    for (right, on), hot in zip(rights, hot_keys(left, [on for _, on in rights], hot_rows)):
        left = _join(left, right, on, hot, spread, how)
    return left


def join_unique(left: DataFrame, right: DataFrame, on: list[str], spread: str,
                how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """A chain of one join."""
    return join_chain(left, [(right, on)], spread, how, hot_rows)
