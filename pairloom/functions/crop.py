"""Random word cropping of whole texts, as JVM-side array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.draws import TWO_31, digest, let, slot, unit, word_marks

# Fixed values of the cropping method.
RATIO_MIN, RATIO_MAX = 0.1, 0.5
DELETE_PROBABILITY = 0.1


def words_of(text: Column) -> Column:
    """Words between single spaces; empty words are kept."""
    return F.split(text, " ")


def crop_span(n_words: Column, hex_digest: Column) -> tuple[Column, Column]:
    """(start, length) of the span: a share U[0.1, 0.5] of the words at a uniform start."""
    ratio = F.lit(RATIO_MIN) + F.lit(RATIO_MAX - RATIO_MIN) * unit(hex_digest, 0)
    length = F.floor(n_words * ratio)
    start = F.floor(unit(hex_digest, 1) * (n_words - length + 1))
    return start.cast("int"), length.cast("int")


def delete_words(words: Column, start_mark: Column, p: float = DELETE_PROBABILITY) -> Column:
    """Words joined by spaces, each dropped independently with probability ``p``."""
    bar = int(p * TWO_31)

    def keep(w: Column) -> Column:
        marks = word_marks(start_mark, F.size(w))
        return F.array_join(F.zip_with(w, marks, lambda x, m: F.when(m > F.lit(bar), x)), " ")

    return let(words, keep)  # the join skips the NULL entries


def crop_text(text: Column, seed: int, side: str, key: Column) -> Column:
    """split -> crop -> delete words -> join -> lower, for one side of a pair."""

    def crop(row: Column) -> Column:
        words, hex_digest = row["words"], row["digest"]
        start, length = crop_span(F.size(words), hex_digest)
        return F.lower(delete_words(F.slice(words, start + 1, length), slot(hex_digest, 2)))

    drawn = digest(seed, "crop", side, key)
    return let(F.struct(words_of(text).alias("words"), drawn.alias("digest")), crop)


def crop_pair(df, seed: int, key: str = "pos", text: str = "text"):
    """Two independent crops of one text plus the text itself."""
    return df.select(
        *[c for c in df.columns if c != text],
        crop_text(F.col(text), seed, "q", F.col(key)).alias("query"),
        crop_text(F.col(text), seed, "d", F.col(key)).alias("document"),
        F.col(text).alias("original_document"),
    )
