"""From a judged collection to training batches and a development set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import DUAL_SEPARATOR, SEPARATOR, dual_tag, passage_text
from pairloom.operators import metrics as met, report
from pairloom.operators.encode import EncoderFactory, encode
from pairloom.operators.pairs import Collection, join_pairs, judged_queries, load_triplets, require_queries
from pairloom.operators.sampling import corpus_cap, nodup_batches, shuffle_batches
from pairloom.operators.search import SCORE_FNS, topk_search
from pairloom.session import materialize
from pairloom.sources import outputs


def training_batches(data: Collection, batch_size: int, dual: bool = False,
                     seed: int = 0) -> DataFrame:
    """Shuffled training pairs with their batch; ``dual`` tags the two sides of a two-tower model."""
    pairs = join_pairs(data, batch_size, DUAL_SEPARATOR if dual else SEPARATOR)
    batches = shuffle_batches(pairs, batch_size, seed)
    if not dual:
        return batches
    return batches.withColumn("query", dual_tag(F.col("query"), "query")).withColumn(
        "doc", dual_tag(F.col("doc"), "doc"))


def development_set(data: Collection, max_corpus_size: int | None = None, dual: bool = False,
                    seed: int = 0) -> Collection:
    """Judged queries and passages, the corpus capped if asked for; an empty set is an error."""
    queries = judged_queries(data.queries, data.qrels)
    require_queries(queries)
    corpus = data.corpus
    if max_corpus_size:
        corpus = corpus_cap(corpus, data.qrels, max_corpus_size, seed)
    sep = DUAL_SEPARATOR if dual else SEPARATOR
    passages = corpus.select("_id", passage_text(F.col("title"), F.col("text"), sep).alias("text"), "pos")
    return Collection(passages, queries, data.qrels.filter("score >= 1"))


def triplet_batches(triplets: DataFrame, batch_size: int, query: str = "query", positive: str = "positive",
                    negative: str = "negative", pos: str = "pos", seed: int = 0) -> DataFrame:
    """Training triplets with their batch; no two triplets of a batch share a text."""
    rows = load_triplets(triplets, query, positive, negative, pos)
    return nodup_batches(rows, batch_size, ["query", "positive", "negative"], seed=seed)


def evaluate_development(dev: Collection, encoder: EncoderFactory, history: str, epoch: int = -1, steps: int = -1,
                         doc_encoder: EncoderFactory | None = None, cuts: dict[str, list[int]] | None = None,
                         main_metric: str = "ndcg", main_score_fn: str | None = None, dim: int | None = None) -> float:
    """One evaluation of a training run on its development set (of :func:`development_set`).

    Both score functions are searched in one pass, one row is appended to the metric history, and the
    headline comes back: ``main_metric`` at its largest cut-off, of ``main_score_fn`` or the better of all.
    """
    cuts = cuts or met.DEFAULT_CUTS
    one = lambda df: df.withColumn("dataset", F.lit("dev"))
    asked = encode(one(dev.queries).select("dataset", "_id", "text"), encoder)
    docs = encode(one(dev.corpus).select("dataset", "_id", "text"), doc_encoder or encoder)
    run = topk_search(asked, docs, met.max_k(cuts), dataset="dataset", dim=dim, written=True)
    found = materialize(met.evaluate_binary(run, one(dev.qrels), list(SCORE_FNS), cuts), "metrics")
    keyed = found.withColumn("epoch", F.lit(epoch)).withColumn("steps", F.lit(steps))
    outputs.append_history(report.history_row(keyed, report.history_columns(list(SCORE_FNS), cuts),
                                              ["epoch", "steps"]).coalesce(1), history)
    return met.headline(found, main_metric, main_score_fn).first()["headline"]
