"""Judged collections on disk: corpus, queries and relevance files of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import schemas
from pairloom.operators.pairs import Collection, last_qrel, listed_queries
from pairloom.sources.files import read_corpus, read_queries, with_file_order, write_json

# Fixed value: the header of a relevance file.
QREL_HEADER = ["query-id", "corpus-id", "score"]


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance file: header, tabs, at least three columns, integer grade; further columns are read past.

    A repeated (query, document) keeps its last grade. A line without a grade, or with one that is no
    integer, fails the job.
    """
    named = ", ".join(f"{c} STRING" for c in ("query_id", "corpus_id", "score"))
    raw = (spark.read.schema(named).option("sep", "\t").option("header", True)
           .option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path))
    grade = F.when(F.col("score").isNull(), F.raise_error(F.concat(
        F.lit("no grade for "), F.coalesce("query_id", F.lit("?"))))).otherwise(F.col("score")).cast("int")
    return last_qrel(with_file_order(raw).withColumn("score", grade))


def write_qrels(qrels: DataFrame, path: str) -> None:
    columns = [F.col(c).alias(h) for c, h in zip(("query_id", "corpus_id", "score"), QREL_HEADER)]
    qrels.select(*columns).write.mode("overwrite").option("sep", "\t").option(
        "header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)  # blanks in ids stay


def evaluation_split(dataset: str) -> str:
    """``dev`` for msmarco, ``test`` for all other collections."""
    return "dev" if dataset == "msmarco" else "test"


def load_collection(spark: SparkSession, root: str, split: str) -> Collection:
    """Corpus, queries and judgements; only queries that are in the judgements are kept."""
    corpus = read_corpus(spark, f"{root}/corpus.jsonl")
    qrels = read_qrels(spark, f"{root}/qrels/{split}.tsv")
    queries = read_queries(spark, f"{root}/queries.jsonl")
    return Collection(corpus, listed_queries(queries, qrels), qrels)


def write_collection(data: Collection, root: str, split: str) -> None:
    write_json(data.corpus.drop("pos"), f"{root}/corpus.jsonl")
    write_json(data.queries.drop("pos"), f"{root}/queries.jsonl")
    write_qrels(data.qrels, f"{root}/qrels/{split}.tsv")


def write_parts(df: DataFrame, root: str) -> None:
    """Sub-collections side by side as ``dataset=...`` folders."""
    df.write.mode("overwrite").partitionBy("dataset").parquet(root)


def read_parts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All sub-collections in one frame; the folder name is the ``dataset`` column."""
    return spark.read.schema(f"{schema}, dataset STRING").parquet(root)


def copy_corpus(spark: SparkSession, source: str, target: str) -> None:
    """The corpus next to exported queries."""
    write_json(read_corpus(spark, source, ordered=False), target)
