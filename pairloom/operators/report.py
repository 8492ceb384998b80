"""Reports: first words, generation time, score tables, metric history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import first_word, sim_of_name
from pairloom.operators.metrics import macro
from pairloom.session import materialize

# The collections and metrics of the report.
COLLECTIONS = [
    "msmarco", "trec-covid", "nfcorpus", "nq", "hotpotqa", "fiqa", "arguana",
    "webis-touche2020", "cqadupstack", "quora", "dbpedia-entity", "scidocs", "fever",
    "climate-fever", "scifact",
]
SUB_FORUMS = [
    "android", "english", "gaming", "gis", "mathematica", "physics", "programmers", "stats",
    "tex", "unix", "webmasters", "wordpress",
]
REPORT_METRICS = ["NDCG@10", "Recall@100", "MRR@10"]
GROUPED = {"cqadupstack": 12}  # collections made of sub-collections, and how many


def word_counts(df: DataFrame, question: str = "question", pos: str = "pos") -> DataFrame:
    """Count and share (percent of all rows) of each first word, with its first position."""
    counts = df.groupBy(first_word(F.col(question)).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"))
    counts = materialize(counts, "words")  # read twice: for the total and for the shares
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("pct", F.col("n") / F.lit(float(total)) * 100)


def top_words(df: DataFrame, question: str = "question", pos: str = "pos", n: int = 10) -> DataFrame:
    """The ``n`` most frequent first words; ties go to the word seen first."""
    return word_counts(df, question, pos).orderBy(F.desc("n"), "first_pos").limit(n).drop(
        "first_pos")


def generation_time(facts: DataFrame, workers: int = 8) -> DataFrame:
    """Days of generation per model and split, for one worker and for ``workers``.

    Failed shards have no time and are skipped.
    """
    days = F.sum("time_in_minutes") / 60 / 24
    return facts.groupBy("model_name", "split").agg(days.alias("days")).withColumn(
        "days_parallel", F.col("days") / workers)


def failed_shards(facts: DataFrame) -> DataFrame:
    """Shards with errors in ascending order, the ones to generate again."""
    return facts.filter("errors > 0").select("split", "shard_id", "errors").orderBy(
        "split", "shard_id")


def without_failed(outputs: DataFrame, facts: DataFrame) -> DataFrame:
    """Outputs whose shard did not fail; the failed ones then count as missing and run again.

    A shard is a number within its model and split, as far as the outputs tell them.
    """
    keys = [c for c in ("model_name", "split", "shard_id") if c in outputs.columns]
    failed = facts.filter("errors > 0").select(*keys).distinct()
    return outputs.join(failed, keys, "left_anti").select(*outputs.columns)


def result_table(metrics: DataFrame, model: str, grouped: dict[str, int] | None = None) -> DataFrame:
    """Result rows (model, dataset, metric, k, value in percent) of one model and score function.

    A sub-collection is named ``group/part``. Every collection gets its own rows. A group also gets
    the mean over its parts: those asked for by ``grouped`` must be complete, the known ones get it
    where all parts are there, so that a part can be evaluated alone.
    """
    rows = metrics.select("dataset", "metric", "k", "value")
    single = rows.withColumn("value", F.col("value") * 100)
    for name, parts in (GROUPED if grouped is None else grouped).items():
        group = rows.filter(F.col("dataset").startswith(f"{name}/")).withColumn("dataset", F.lit(name))
        mean = macro(group, ["dataset"], expected=None if grouped is None else parts)
        mean = mean.filter(F.col("collections") == parts)
        single = single.unionByName(mean.drop("collections"))
    return single.select(F.lit(model).alias("model"), "dataset", "metric", "k", "value")


def with_group_means(results: DataFrame, grouped: dict[str, int] | None = None) -> DataFrame:
    """``results`` (model, dataset, metric, value) with a row for each group whose parts are all there.

    A part is named ``group/part``, or ``group_part`` where the group is listed in ``grouped`` (group to number
    of parts). Parts and groups come out of one pass; a group that has a row of its own keeps it.
    """
    sizes = GROUPED if grouped is None else grouped
    name = F.lit(None).cast("string")
    for group in sizes:
        name = F.when(F.col("dataset").rlike(f"^{re.escape(group)}[/_]."), group).otherwise(name)
    rows = results.withColumn("_group", name).groupingSets(
        [[F.col("model"), F.col("metric"), F.col("_group"), F.col("dataset")],
         [F.col("model"), F.col("metric"), F.col("_group")]], "model", "metric", "_group", "dataset").agg(
        F.avg("value").alias("value"), F.count("value").alias("_parts"), F.grouping("dataset").alias("_mean"))
    wanted = F.lit(None).cast("long")
    for group, parts in sizes.items():
        wanted = F.when(F.col("_group") == group, parts).otherwise(wanted)
    kept = rows.filter((F.col("_mean") == 0) | (F.col("_parts") == wanted)).withColumn(
        "dataset", F.coalesce("dataset", "_group"))
    return kept.groupBy("model", "dataset", "metric").agg(F.min_by("value", "_mean").alias("value"))


def score_sheets(results: DataFrame, metrics: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    """Model x collection tables of all ``metrics`` in one pass, one row per (metric, model).

    ``results`` is (model, dataset, metric, value) with metric names such as ``NDCG@10``. Without
    ``collections`` the columns are those of the data: the known collections in their order, then the others by name
    (their names, not their rows, come to the driver). Blanks where a result is missing; ``average`` is the mean of
    the present cells (an extension: the column used to stay empty).
    """
    metrics = metrics or REPORT_METRICS
    rows = results.filter(F.col("metric").isin(metrics))
    if collections is None:
        found = {r[0] for r in rows.select("dataset").distinct().collect()}
        known = [*COLLECTIONS, *[f"{g}{sep}{s}" for g in GROUPED for s in SUB_FORUMS for sep in "/_"]]
        collections = [c for c in known if c in found] + sorted(found - set(known))
    sheet = rows.groupBy("metric", "model").pivot("dataset", collections).agg(F.first("value"))
    cells = [F.col(f"`{c}`") for c in collections]
    present = F.filter(F.array(*cells) if cells else F.array().cast("array<double>"), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return sheet.select(
        "metric", "model", sim_of_name(F.col("model")).alias("similarity"),
        F.try_divide(total, F.size(present).cast("double")).alias("average"), *cells)


def score_sheet(results: DataFrame, metric: str, collections: list[str] | None = None) -> DataFrame:
    """The table of one metric."""
    return score_sheets(results, [metric], collections).drop("metric")


def similarity_columns(df: DataFrame, similarity: str) -> list[str]:
    """Sorted names of the columns that belong to a similarity."""
    return sorted(c for c in df.columns if similarity in c)


def history_series(history: DataFrame, similarity: str) -> DataFrame:
    """Metric history in long form: one row per epoch, step and metric column."""
    names = similarity_columns(history, similarity)
    return history.unpivot(["epoch", "steps"], [F.col(f"`{n}`") for n in names], "metric", "value")


def history_columns(score_fns: list[str], cuts: dict[str, list[int]]) -> list[str]:
    """Column names of the metric history in file order."""
    label = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall",
             "mrr": "MRR", "ndcg": "NDCG", "map": "MAP"}
    out = []
    for fn in sorted(score_fns):
        out += [f"{fn}-Accuracy@{k}" for k in cuts["accuracy"]]
        for k in cuts["precision"]:
            out += [f"{fn}-Precision@{k}", f"{fn}-Recall@{k}"]
        out += [f"{fn}-{label[m]}@{k}" for m in ("mrr", "ndcg", "map") for k in cuts[m]]
    return out


def history_row(metrics: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Long metrics (with ``keys`` such as epoch and steps) to one wide row per key."""
    name = F.concat("score_fn", F.lit("-"), F.when(
        F.col("metric").isin("mrr", "ndcg", "map"), F.upper("metric")).otherwise(
        F.initcap("metric")), F.lit("@"), F.col("k"))
    wide = metrics.withColumn("_name", name).groupBy(*keys).pivot("_name", columns)
    return wide.agg(F.first("value"))
