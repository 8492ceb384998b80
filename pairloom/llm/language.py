"""Language identification by prediction by partial matching.

Each language is a tree of byte contexts of up to three bytes with frozen counts. A byte that was
never seen after a context costs that context's escape (method C: distinct successors over count
plus distinct successors) and is then coded after the context without its first byte, down to 8
bits for a byte never seen. The exact code length of a text is the sum over its bytes; the language
with the shortest code wins. Texts are read as UTF-8 with A-Z lower-cased, after three zero bytes.

Counts come from every training text by partial aggregates. The model is bounded: of the counted byte
sequences that occur at least twice ``max_grams`` stay, whatever the size of the corpus, so it can be
broadcast. The bound is shared out evenly over the languages (what one doesn't need goes to the others), and
each keeps its most frequent ones as far as whole steps of frequency fit: a rare language stays beside large ones.

Defined results: NULL text, or text without a letter, is ``und`` with score 0; without any training
row all rows are. A NULL language teaches nothing. Ties go to the first language by name. Rows are
scored one by one, so repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.columns import LOWER, SMALL_SLICE, U64, KeyTable, bound_batches, flat, row_sums, slices
from pairloom.session import materialize

ORDER = 3  # context bytes
MAX_GRAMS = 400_000  # bound of the model
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte the number made of the three bytes before it and itself."""
    data = LOWER[data].astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros_like(data)
        before[back:] = data[:-back] if back < len(data) else data[:0]
        before[place < back] = 0
        out |= before << np.uint32(8 * back)
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows that have a text and a language."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            data, offsets = flat(batch.column(0))
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for i, j, part, at in slices(data, offsets, SMALL_SLICE):
                keys, row = grams(part, at), np.repeat(code[i:j], np.diff(at))
                for c in np.unique(row):
                    k, n = np.unique(keys[row == c], return_counts=True)
                    held.setdefault(names[c], []).append((k, n))
                for name, parts in held.items():  # merged when the new parts outgrow the merged one
                    if sum(len(k) for k, _ in parts[1:]) > max(len(parts[0][0]), 200_000):
                        held[name] = [_merge(parts)]
        for name, parts in held.items():
            k, n = _merge(parts)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k[i:i + 100_000])), pa.array(k[i:i + 100_000].astype(np.int64)),
                     pa.array(n[i:i + 100_000])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        "text IS NOT NULL AND text != '' AND lang IS NOT NULL")
    found = rows.mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of the greatest ``n``: all above a threshold from a histogram of n.

    The histogram has eight steps an octave, so it is small whatever the counts; a step that doesn't
    fit in whole stays out. No row is sorted or sent to the driver to find the threshold.
    """
    step = F.floor(8 * F.log2("n")).cast("int")
    left, least = limit, None
    for s, size in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        if size > left:
            break
        left, least = left - size, s
    return counts.filter(F.lit(False) if least is None else step >= least)


def most_frequent_each(counts: DataFrame, limit: int, key: str = "lang") -> DataFrame:
    """About ``limit`` rows: of every ``key`` those of greatest ``n``, all keys with the same share of the limit.

    Keys with fewer rows than their share leave the rest to the others. Thresholds are those of ``most_frequent``;
    where the first step alone is more than the share, a part of it stays by a hash, so that no key loses all.
    """
    step, whole = F.floor(8 * F.log2("n")).cast("int"), 1 << 20
    steps: dict = {}
    for k, s, size in counts.groupBy(key, step.alias("s")).count().collect():
        steps.setdefault(k, []).append((s, size))
    rows = []
    for place, k in enumerate(sorted(steps, key=lambda k: (sum(size for _, size in steps[k]), k))):
        left = max(1, limit // (len(steps) - place))
        least, part = None, whole
        for s, size in sorted(steps[k], reverse=True):
            if size > left:
                if least is None:
                    least, part, limit = s, -(-whole * left // size), limit - left
                break
            least, left, limit = s, left - size, limit - size
        rows.append((k, least, part))
    if not rows:
        return counts
    kept = counts.sparkSession.createDataFrame(rows, "_key string, _least int, _part long")
    hashed = F.pmod(F.xxhash64(*[c for c in counts.columns if c != "n"]), F.lit(whole))
    return counts.join(F.broadcast(kept), F.col(key) == F.col("_key")).filter(
        (step > F.col("_least")) | ((step == F.col("_least")) & (hashed < F.col("_part")))).select(*counts.columns)


def train(docs: DataFrame, text: str = "text", lang: str = "lang",
          max_grams: int = MAX_GRAMS) -> dict:
    """The frozen model of all training rows."""
    counts = materialize(count_grams(docs, text, lang).filter("n > 1"), "language-grams")
    return freeze(most_frequent_each(counts, max_grams).toPandas())


def freeze(counts) -> dict:
    """Code lengths of every counted byte sequence and escapes of every context, per language."""
    langs = sorted(counts["lang"].unique()) if len(counts) else []
    per = []
    for name in langs:
        rows = counts[counts["lang"] == name]
        keys, n = rows["gram"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(np.int64)
        levels = []
        for order in range(ORDER, -1, -1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            levels.append(_merge([(keys & mask, n)]))
        per.append(levels[::-1])
    below, model = None, {"langs": langs, "levels": []}
    for order in range(ORDER + 1 if langs else 0):
        every = np.unique(np.concatenate([p[order][0] for p in per]))
        if order == 0:
            every = np.arange(256, dtype=np.uint32)
        contexts = np.unique(every >> np.uint32(8))
        bits, escapes = np.zeros((len(every), len(per))), np.zeros((len(contexts), len(per)))
        for k, p in enumerate(per):
            keys, n = p[order]
            at = np.searchsorted(contexts, keys >> np.uint32(8))
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            escapes[seen, k] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            if order:
                mask = np.uint32((1 << (8 * order)) - 1)
                lower = below[1][np.searchsorted(below[0], every & mask), k]
            else:
                lower = np.full(256, 8.0)
            bits[:, k] = escapes[np.searchsorted(contexts, every >> np.uint32(8)), k] + lower
            bits[np.searchsorted(every, keys), k] = -np.log2(n / (total[at] + kinds[at]))
        model["levels"].append((every, bits.astype(np.float32), contexts, escapes.astype(np.float32)))
        below = (every, bits)
    return model


class Coder:
    """Code lengths of texts in bits under every language of a frozen model."""

    def __init__(self, model: dict) -> None:
        self.langs = model["langs"]
        self.levels = [(KeyTable(k.astype(U64)), b, KeyTable(c.astype(U64)), e)
                       for k, b, c, e in model["levels"]]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x languages."""
        keys = grams(data, offsets).astype(U64)
        cost = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            table, bits, contexts, escapes = self.levels[order]
            own = keys[left] & U64((1 << (8 * (order + 1))) - 1)
            place = table.find(own)
            hit = place >= 0
            cost[left[hit]] += bits[place[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
            place = contexts.find(own >> U64(8))
            cost[left] += np.where((place >= 0)[:, None], escapes[place], 0)
        return row_sums(cost, offsets)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def predict(model: dict, text: Column | str = "text", spark=None) -> Column:
    """Struct of ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` of the winner."""
    shared = spark.sparkContext.broadcast(model)
    kind = "lang_pred string, score double, bits_per_byte double"

    coders = []  # of the task, made at its first batch

    def run(column: pa.Array) -> pa.Array:
        if not coders:
            coders.append(Coder(shared.value))
        coder = coders[0]
        n = len(column)
        best, score, rate = np.full(n, -1), np.zeros(n), np.zeros(n)
        data, offsets = flat(column)
        for i, j, part, at in slices(data, offsets, SMALL_SLICE) if coder.langs else ():
            letter = row_sums(ASCII_LETTER[part], at) > 0
            beyond = row_sums(part >= 128, at) > 0
            for r in np.flatnonzero(~letter & beyond):
                letter[r] = _has_letter(part[at[r]:at[r + 1]].tobytes())
            bits, size = coder.bits(part, at), np.maximum(np.diff(at), 1)
            # Bits over the root of the length, so that the score doesn't saturate at once.
            gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None]
            best[i:j] = np.where(letter, bits.argmin(axis=1), -1)
            score[i:j] = np.where(letter, 1 / np.exp2(-gap).sum(axis=1), 0)
            rate[i:j] = np.where(letter, bits.min(axis=1) / size, 0)
        names = np.array([*coder.langs, UNKNOWN], dtype=object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                                          names=["lang_pred", "score", "bits_per_byte"])

    return F.arrow_udf(run, kind)(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``part``; a NULL id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def train_on_documents(docs: DataFrame) -> dict:
    return train(docs.filter(~held_out(F.col("doc_id"), 4, 2)))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every document."""
    found = predict(train_on_documents(docs), F.col("text"), docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told; the rest goes."""
    bound_batches(spark)
    found = predict(train_on_documents(docs), F.col("text"), spark)
    return docs.select(F.struct("*").alias("row"), found.alias("found")).filter(
        F.col("found.lang_pred") != UNKNOWN).select("row.*")
