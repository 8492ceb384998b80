"""Text to vector through a pluggable encoder, batched over Arrow.

The user gives a factory ``() -> (list[str] -> 2-d array)``. It is called once per task, so a
model is loaded once and sees whole batches. The default is a hashed bag of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]


def hashed_words(dim: int = 64, normalize: bool = True) -> EncoderFactory:
    """Bag of words: each word counts in bucket ``md5(word) % dim``; length 1 if normalised.

    Words are the lower-case runs between spaces, tabs and line breaks. A batch is split and
    dictionary-encoded as one array, each distinct word is hashed once, and one count over
    (row, bucket) fills the matrix.
    """

    def factory() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
            words = pc.split_pattern_regex(lowered, r"[ \t\r\n]+")
            rows = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
            coded = words.flatten().dictionary_encode()
            digests = [hashlib.md5(w).digest()[:4] for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
            buckets = np.frombuffer(b"".join(digests), ">u4").astype(np.int64) % dim
            filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
            kind = coded.indices.to_numpy()
            used = filled[kind] if len(kind) else np.zeros(0, bool)
            flat = np.bincount(rows[used] * dim + buckets[kind[used]], minlength=len(texts) * dim)
            out = flat.reshape(len(texts), dim).astype(float)
            if normalize:
                norms = np.sqrt(np.einsum("ij,ij->i", out, out))
                out /= np.where(norms == 0, 1.0, norms)[:, None]
            return out

        return encode

    return factory


def encode_column(text: Column, factory: EncoderFactory, batch_size: int = 512) -> Column:
    """Vector column ARRAY<DOUBLE> of a text column."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = factory()
        for texts in batches:
            values = texts.fill_null("").to_pylist()
            parts = [np.asarray(encode(values[i:i + batch_size]), dtype=float)
                     for i in range(0, len(values), batch_size)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 0))
            offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    return run(text)


def encode(df: DataFrame, factory: EncoderFactory, text: str = "text", name: str = "vec",
           batch_size: int = 512) -> DataFrame:
    return df.withColumn(name, encode_column(F.col(text), factory, batch_size))
