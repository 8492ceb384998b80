"""Sinks and sources of the runs: shards, generated pairs, run facts, results, history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import schemas


def safe(name: str) -> str:
    """Model and collection names in paths: ``/`` becomes ``_``."""
    return name.replace("/", "_")


def generated_path(root: str, dataset: str, method: str, model: str = "") -> str:
    """``root/dataset/method[_model]``."""
    return f"{root}/{dataset}/{method}{'_' + safe(model) if model else ''}"


def shards_path(generated: str, split: str) -> str:
    """Shards are shared by all models of a collection."""
    return f"{generated.rsplit('/', 1)[0]}/shards/{split}"


def training_path(root: str, similarity: str, dataset: str, method: str, pretrained: str,
                  model: str = "", dual: bool = False) -> str:
    """``root/dataset/similarity[_dpr]_dataset_method[_model]_pretrained_on_base``."""
    name = (f"{similarity}{'_dpr' if dual else ''}_{dataset}_{method}"
            f"{'_' + model if model else ''}_pretrained_on_{pretrained}")
    return f"{root}/{dataset}/{safe(name)}"


def layout_columns(df: DataFrame) -> DataFrame:
    """Partition columns of outputs: dataset, method, model (safe for paths) and split."""
    return df.withColumn("model", F.replace(F.col("model"), F.lit("/"), F.lit("_"))).withColumn(
        "dataset", F.replace(F.col("dataset"), F.lit("/"), F.lit("_")))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; nothing happens if all shards are there already.

    A marker table beside the folder is written last, so shards of a broken-off write are replaced.
    """
    spark, marker = df.sparkSession, f"{path.rstrip('/')}.done"
    try:
        spark.read.schema("id BIGINT").parquet(marker)
        return
    except AnalysisException:  # the marker isn't there
        pass
    df.hint("rebalance", "shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)
    spark.range(1).write.mode("overwrite").parquet(marker)


def write_generated(df: DataFrame, path: str) -> None:
    """Finished shards, rebalanced to about one file each; writing a shard again replaces that shard only."""
    (df.hint("rebalance", "shard_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard_id").parquet(path))


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, shard_id INT").parquet(path)


FACT_KEYS = ["dataset_name", "model_name", "split", "shard_id"]


def append_facts(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The last record of every shard; a shard that is generated again replaces its record.

    The last is the one of the highest ``run``, then the latest end.
    """
    raw = spark.read.schema(schemas.RUN_FACTS).json(path)
    order = ["run", "time_end"]
    rest = [c for c in raw.columns if c not in FACT_KEYS and c not in order]
    last = raw.groupBy(*FACT_KEYS).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*FACT_KEYS, "_last.*").select(*raw.columns)


def next_run(spark: SparkSession, path: str) -> int:
    """The number of the next run over these facts."""
    try:
        last = spark.read.schema("run BIGINT").json(path).agg(F.max("run")).first()[0]
    except AnalysisException:  # no facts yet
        return 0
    return 0 if last is None else last + 1


EXPORTS = "run BIGINT, split STRING, folder STRING, first_query BIGINT, queries BIGINT"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The valid export of every split: folder, first query number, number of queries."""
    try:
        raw = spark.read.schema(EXPORTS).json(f"{path}/exports")
    except AnalysisException:  # nothing was exported yet
        return spark.createDataFrame([], EXPORTS)
    rest = [c for c in raw.columns if c != "split"]
    return raw.groupBy("split").agg(F.max(F.struct(*rest)).alias("_last")).select("split", "_last.*")


def commit_exports(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Switch to new exports of some splits at once: one appended file, which is there or is not."""
    spark.createDataFrame(rows, EXPORTS).coalesce(1).write.mode("append").json(f"{path}/exports")


def append_history(wide: DataFrame, path: str) -> None:
    """Append evaluation rows; every part file carries the header, which the reader skips."""
    wide.write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    metrics = ", ".join(f"`{c}` DOUBLE" for c in columns)
    return (spark.read.schema(f"epoch INT, steps INT, {metrics}").option("header", True)
            .option("mode", "FAILFAST").csv(path))


def result_rows(metrics: DataFrame) -> DataFrame:
    """One row per (model, dataset): a JSON object of metric name to value."""
    entry = F.struct(F.concat("metric", F.lit("@"), F.col("k")).alias("key"), "value")
    # At most one entry per metric and cut-off, a handful per row.
    return metrics.groupBy("model", "dataset").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def write_results(metrics: DataFrame, path: str) -> None:
    """One file per (model, dataset); files of other models and collections stay."""
    layout_columns(result_rows(metrics)).hint("rebalance", "model", "dataset").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("model", "dataset").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Long (model, dataset, metric, value) from all result files."""
    raw = spark.read.schema("value STRING, model STRING, dataset STRING").text(path)
    values = F.from_json("value", "MAP<STRING, DOUBLE>")
    return raw.select("model", "dataset", F.explode(values).alias("metric", "value"))


def score_card(cards: DataFrame) -> DataFrame:
    """Nested score cards to rows (model, algorithm, trained_on, metric, dataset, value).

    An empty cell is NULL.
    """
    per_metric = cards.select(
        F.col("model name").alias("model"), "algorithm", F.col("trained on").alias("trained_on"),
        F.explode("metrics").alias("metric", "cells"))
    rows = per_metric.select("model", "algorithm", "trained_on", "metric",
                             F.explode("cells").alias("dataset", "cell"))
    return rows.withColumn("value", F.nullif("cell", F.lit("")).cast("double")).drop("cell")
