"""JSON lines and JSON arrays, with explicit schemas and a stable row position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import schemas
from pairloom.session import materialize

ARRAY_BYTES = 64 << 20  # of a file that holds one JSON array
ARRAY_PIECES = 16  # text records of such a file
ROW_BITS = 33  # rows of one task, as in monotonically_increasing_id


def with_file_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Adds ``pos``: increasing in file path, then place in the file; unique, with gaps.

    The order key of a row is its file's path, the start of its split and its place there; the reader
    packs splits by size, so split numbers alone do not follow the files. Sampled ranges of that key
    are dealt to tasks and sorted, which is one exchange for any number and any size of files; nothing is listed,
    joined or held in one task. The result is written down, so that ``pos`` is the same for all
    that read it. Call it right on the reader's output.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    keyed = df.select("*", F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_start"), place.alias("_row"))
    order = ["_path", "_start", "_row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.drop(*order).withColumn(pos, F.monotonically_increasing_id()), "ordered")


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST",
               ordered: bool = False) -> DataFrame:
    """JSON lines. FAILFAST stops at a bad line; ids written as numbers become strings.

    With ``mode='PERMISSIVE'`` a bad line becomes a row of NULLs; name a column
    ``_corrupt_record`` in the schema to keep its text.
    """
    df = spark.read.schema(schema).option("mode", mode).json(path)
    return with_file_order(df) if ordered else df


def read_json(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """One JSON array per file. Such a file cannot be split; prefer JSON lines or Parquet."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return with_file_order(df) if ordered else df


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines files, NULL fields included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", file_bytes: int = ARRAY_BYTES) -> None:
    """A folder of files that each hold one JSON array of about ``file_bytes`` at most, or sixteen rows if these are larger.

    Such a file can't be split, so its size bounds the task that reads it. A task's rows stream through in order, in
    pieces of a sixteenth of a file; each piece is a record of the text sink, which begins a new file after sixteen.
    """
    piece_bytes = file_bytes // ARRAY_PIECES

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[str]:
        rows, size = [], 0
        for frame in frames:
            for row in frame["value"]:
                more = len(row.encode()) + 2
                if rows and size + more > piece_bytes:
                    yield "\n,".join(rows)
                    rows, size = [], 0
                rows.append(row)
                size += more
        if rows:
            yield "\n,".join(rows)

    def punctuate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = None, 0  # the last piece, which may have to close its array
        for piece in pieces(frames):
            if held is not None:
                yield pd.DataFrame({"value": [held + ("]" if n % ARRAY_PIECES == 0 else "")]})
            held = ("[" if n % ARRAY_PIECES == 0 else ",") + piece
            n += 1
        yield pd.DataFrame({"value": ["[]" if held is None else held + "]"]})

    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    df.select(line).mapInPandas(punctuate, "value STRING").write.mode(mode).option(
        "maxRecordsPerFile", ARRAY_PIECES).text(path)


def json_to_jsonl(spark: SparkSession, path: str, schema: str) -> str:
    """Array files to lines, beside the source under the same name plus ``l``."""
    target = path + "l"
    write_json(read_json(spark, path, schema), target)
    return target


def read_corpus(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    return read_jsonl(spark, path, schemas.CORPUS, ordered=ordered)


def read_queries(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    return read_jsonl(spark, path, schemas.QUERIES, ordered=ordered)
