"""Seeded random draws as Spark expressions.

Every draw depends on a seed and a row key only, never on the partition or the attempt, so a
retried task reproduces its rows. One digest per row feeds up to four 32-bit draws.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296
TWO_31 = 2147483648

# Multipliers of the word mixer: odd numbers below 2^31, so every product fits a BIGINT.
STEP = 1640531527
MIX_A = 739982445
MIX_B = 695872825


def digest(seed: int | str, *parts: Column | str) -> Column:
    """Hex digest of ``seed|part|part...``; text parts are literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def slot(hex_digest: Column, index: int) -> Column:
    """The ``index``-th (0..3) 32-bit number of a digest as BIGINT."""
    return F.conv(F.substring(hex_digest, 8 * index + 1, 8), 16, 10).cast("long")


def unit(hex_digest: Column, index: int = 0) -> Column:
    """Uniform draw in [0, 1) from one slot of a digest."""
    return slot(hex_digest, index) / F.lit(float(TWO_32))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside array functions Spark evaluates an expression every time it is mentioned, per element
    if it stands in a lambda; a one-element transform binds it.
    """
    return F.transform(F.array(value), body)[0]


def word_marks(start: Column, count: Column) -> Column:
    """``count`` integers in [0, 2^31), one per word position, mixed from ``start``.

    Each stage is a transform of its own, so a value is computed once per word.
    """
    last = start + (count - 1).cast("long") * F.lit(STEP)
    steps = F.when(count > 0, F.sequence(start, last, F.lit(STEP).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    first = F.transform(steps, lambda x: x % F.lit(TWO_31))
    second = F.transform(
        first, lambda x: x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(MIX_A) % F.lit(TWO_31)
    )
    return F.transform(
        second, lambda x: x.bitwiseXOR(F.shiftright(x, 12)) * F.lit(MIX_B) % F.lit(TWO_31)
    )
