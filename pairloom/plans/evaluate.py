"""Whole flow from texts to metrics: encode, search, measure, all collections in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import DUAL_SEPARATOR, SEPARATOR, passage_for_encoder
from pairloom.operators import metrics as met
from pairloom.operators.encode import EncoderFactory, encode
from pairloom.operators.report import COLLECTIONS, GROUPED, SUB_FORUMS, result_table, score_sheets, with_group_means
from pairloom.operators.search import SCORE_FNS, ScoreFn, topk_search
from pairloom.session import materialize
from pairloom.sources import outputs


def search_texts(queries: DataFrame, corpus: DataFrame, query_encoder: EncoderFactory,
                 doc_encoder: EncoderFactory | None = None, k: int = 100,
                 score_fns: dict[str, ScoreFn] | None = None, sep: str = SEPARATOR,
                 skip_self: bool = True, dim: int | None = None, written: bool = False) -> DataFrame:
    """Top-k run of texts. The two sides may have different encoders.

    ``queries`` has dataset, _id, text; ``corpus`` has dataset, _id, title, text.
    ``dim`` is the encoder's vector width; if it is not given, one query is encoded to see it. ``written``: as in
    :func:`topk_search`.
    """
    asked = encode(queries.select("dataset", "_id", "text"), query_encoder)
    passages = corpus.select("dataset", "_id", passage_for_encoder(
        F.col("title"), F.col("text"), sep).alias("text"))
    docs = encode(passages, doc_encoder or query_encoder)
    return topk_search(asked, docs, k, score_fns, dataset="dataset", skip_self=skip_self, dim=dim, written=written)


def measure(run: DataFrame, qrels: DataFrame, score_fns: list[str] | None = None,
            k_values: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Binary and graded metrics of one run, which is written down once for both."""
    found = materialize(run, "run")
    return (met.evaluate_binary(found, qrels, score_fns or list(SCORE_FNS)),
            met.evaluate_graded(found, qrels, k_values))


def evaluate_model(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, model: str,
                   encoder: EncoderFactory, similarity: str, doc_encoder: EncoderFactory | None = None,
                   dual: bool = False, k_values: list[int] | None = None,
                   dim: int | None = None) -> DataFrame:
    """Result rows (model, dataset, metric, k, percent) of one model on all collections at once.

    Graded metrics of one similarity. All frames have a ``dataset`` column; parts of a grouped
    collection are named ``group/part``.
    """
    ks = k_values or met.GRADED_AT
    run = search_texts(queries, corpus, encoder, doc_encoder, max(ks),
                       {similarity: SCORE_FNS[similarity]}, DUAL_SEPARATOR if dual else SEPARATOR,
                       dim=dim, written=True)
    graded = met.evaluate_graded(run, qrels, ks)
    return result_table(materialize(graded, "metrics"), model)


def write_evaluation(rows: DataFrame, path: str) -> None:
    """Result files of ``evaluate_model``'s rows, one per model and collection; others stay as they are."""
    outputs.write_results(rows, path)


def report(spark: SparkSession, path: str, metrics: list[str] | None = None, every: bool = True) -> DataFrame:
    """The report over all result files: one row per metric and model, one column per collection.

    ``every`` gives the columns of all known collections and sub-forums, present or not; else those of the
    files. A group without a file of its own gets the mean of its parts where all are there.
    """
    rows = with_group_means(outputs.read_results(spark, path))
    names = [*COLLECTIONS, *[f"{group}_{part}" for group in GROUPED for part in SUB_FORUMS]] if every else None
    return score_sheets(rows, metrics, names)
