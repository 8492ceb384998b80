"""Training pairs and supervised records from a judged collection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import SEPARATOR, passage_text
from pairloom.operators.joins import HOT_ROWS, join_chain
from pairloom.operators.numbering import number_rows
from pairloom.operators.postprocess import pair_record
from pairloom.session import materialize


class Collection(NamedTuple):
    """A judged collection. Each frame carries a unique BIGINT ``pos``."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


class UnknownId(KeyError):
    pass


def last_qrel(qrels: DataFrame) -> DataFrame:
    """One grade per (query, document): the last row wins, at the place of the first one."""
    return qrels.groupBy("query_id", "corpus_id").agg(
        F.max_by("score", "pos").alias("score"), F.min("pos").alias("pos"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one relevant document."""
    relevant = qrels.filter("score >= 1").select(F.col("query_id").alias("_id")).distinct()
    return queries.join(relevant, "_id", "left_semi")


def listed_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that occur in the relevance file, as a loaded split has them."""
    listed = qrels.select(F.col("query_id").alias("_id")).distinct()
    return queries.join(listed, "_id", "left_semi")


def relevance_sets(qrels: DataFrame) -> DataFrame:
    """Relevant documents in long form, one row per (query, document)."""
    return qrels.filter("score >= 1").select("query_id", "corpus_id").distinct()


def skipped_documents(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged document ids that are not in the corpus."""
    ids = qrels.select("corpus_id").distinct()
    return ids.join(corpus.select(F.col("_id").alias("corpus_id")), "corpus_id", "left_anti")


def _with_texts(data: Collection, qrels: DataFrame, hot_rows: int) -> DataFrame:
    queries = data.queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query"),
                                  F.col("pos").alias("query_pos"))
    corpus = data.corpus.select(F.col("_id").alias("corpus_id"), "title", "text")
    return join_chain(qrels, [(queries, ["query_id"]), (corpus, ["corpus_id"])], "pos", "inner", hot_rows)


def join_sup(data: Collection, dataset: str, strict: bool = True,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Supervised records: every judgement with its texts, all grades kept, grade 0 too.

    ``strict`` raises on a judgement whose query or document is unknown; else it is dropped.
    """
    qrels = materialize(last_qrel(data.qrels), "qrels")
    if strict:
        for name, frame in (("corpus_id", data.corpus), ("query_id", data.queries)):
            known = frame.select(F.col("_id").alias(name))
            lost = qrels.select(name).distinct().join(known, name, "left_anti").take(1)
            if lost:
                raise UnknownId(f"unknown {name}: {lost[0][0]}")
    joined = _with_texts(data, qrels, hot_rows)
    return joined.select("query_id", *pair_record(
        f"{dataset}_supervised", F.col("query"), F.col("title"), F.col("text"), F.col("score"),
        F.col("corpus_id")))


def sup_info(qrels: DataFrame) -> DataFrame:
    """Rows and distinct queries of the supervised records."""
    return last_qrel(qrels).agg(F.count(F.lit(1)).alias("original_length"),
                                F.count_distinct("query_id").alias("number_of_queries"))


def join_pairs(data: Collection, batch_size: int, sep: str = SEPARATOR,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Training pairs (query, passage, label 1) of the relevant judgements.

    ``guid`` is the batch of the query among all queries. Documents missing from the corpus are
    skipped; count them with :func:`skipped_documents`.
    """
    queries = number_rows(data.queries, "pos", name="_place")
    guid = F.floor(F.col("_place") / F.lit(batch_size)).cast("int")
    numbered = Collection(data.corpus, queries.withColumn("pos", guid), data.qrels)
    relevant = materialize(last_qrel(data.qrels).filter("score >= 1"), "qrels")  # ids and grades only
    joined = _with_texts(numbered, relevant, hot_rows)
    return joined.select(
        F.col("query_pos").alias("guid"), "pos", "query_id", "corpus_id", "query",
        passage_text(F.col("title"), F.col("text"), sep).alias("doc"), F.lit(1).alias("label"))


def load_triplets(df: DataFrame, query: str, positive: str, negative: str,
                  pos: str = "pos") -> DataFrame:
    """(query, positive, negative) rows in their order, without guid or label."""
    return df.select(F.col(pos).alias("pos"), F.col(query).alias("query"),
                     F.col(positive).alias("positive"), F.col(negative).alias("negative"))


def with_next(df: DataFrame, column: str, name: str, pos: str = "pos") -> DataFrame:
    """Adds ``name``: ``column`` of the next row by ``pos``; the last row takes the first one's.

    ``pos`` may have gaps. Rows meet on their dense numbers, so nothing is sorted in one task.
    """
    numbered = number_rows(df.select(pos, F.col(column).alias(name)), pos, name="_place", total="_rows")
    after = numbered.select(F.pmod(F.col("_place") - 1, F.col("_rows")).alias("_before"), name)
    places = number_rows(df.select(pos), pos, name="_before")
    return df.join(places.join(after, "_before").select(pos, name), pos)


def agg_sizes(data: Collection) -> DataFrame:
    """Sizes of a loaded split; the relevance size counts queries."""
    sizes = [
        data.corpus.select(F.lit("corpus").alias("part"), F.col("_id").alias("key")),
        listed_queries(data.queries, data.qrels).select(F.lit("queries"), F.col("_id")),
        data.qrels.select(F.lit("qrels"), F.col("query_id")),
    ]
    rows = sizes[0].union(sizes[1]).union(sizes[2])
    return rows.groupBy("part").agg(F.count_distinct("key").alias("size"))


def require_queries(queries: DataFrame) -> None:
    if not queries.take(1):
        raise ValueError("the query set is empty, there is nothing to evaluate")
