"""Incremental generation: new corpus files become pairs, each file once, numbered across micro batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.crop import crop_pair
from pairloom.operators.numbering import number_by_hash
from pairloom.session import materialize


def corpus_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json",
                  max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


BATCHES = "first BIGINT, rows BIGINT, batch_id BIGINT"


def first_number(spark: SparkSession, path: str, batch_id: int) -> int:
    """The first free row number of a batch: behind all batches before it, in the table at ``path``."""
    try:
        before = spark.read.schema(BATCHES).parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException:  # the first batch
        return 0
    return before.agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0


def generate_stream(stream: DataFrame, out: str, checkpoint: str, make_pairs, key: str = "_id") -> None:
    """Process all files that are new since the last call, then stop.

    Every row gets ``pos``, unique over all batches: within a batch by a digest of ``key`` (the same for every
    layout), behind the rows of the batches before it. How many those are stands in the small table ``out.batches``, one row
    a batch, written before the batch's pairs. Each micro batch goes to its own ``batch_id`` folder and
    replaces it, so a batch repeated after a failure gets the same numbers and changes nothing. ``make_pairs``
    maps a numbered batch to pairs and keeps ``pos``.
    """
    counts = f"{out.rstrip('/')}.batches"

    def put(df: DataFrame, path: str, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch, "batch")
        first = first_number(spark, counts, batch_id)
        numbered = number_by_hash(rows, 0, "stream", key, name="pos").withColumn("pos", F.col("pos") + first)
        put(spark.createDataFrame([(first, rows.count())], "first BIGINT, rows BIGINT"), counts, batch_id)
        put(make_pairs(numbered), out, batch_id)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def crop_stream(stream: DataFrame, out: str, checkpoint: str, seed: int, key: str = "_id") -> None:
    """Cropped pairs of every new document, drawn by its id so that a rerun draws alike."""
    generate_stream(stream, out, checkpoint, lambda batch: crop_pair(batch, seed, key), key)
