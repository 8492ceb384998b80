"""Rank metrics of a run against relevance judgements, per collection and score function.

A run has one row per hit (dataset, score_fn, query_id, corpus_id, score, rank); judgements have
one row per (dataset, query_id, corpus_id) with an integer ``score``. Only hits that meet a
judgement matter, so the run is joined on the whole pair, a key that cannot be hot, and reduced
to one row of sums per query.

Two families exist on purpose: :func:`evaluate_binary` uses binary gains and all judged queries,
:func:`evaluate_graded` uses graded gains and the queries that are both judged and searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The cut-offs of both families and the rounding of the graded one.
ACCURACY_AT = PRECISION_RECALL_AT = [1, 3, 5, 10, 100]
MRR_AT = NDCG_AT = [10]
MAP_AT = [100]
GRADED_AT = [1, 3, 5, 10, 100, 1000]
GRADED_DIGITS = 5

QUERY = ["dataset", "query_id"]
GROUP = ["dataset", "score_fn"]
DEFAULT_CUTS = {
    "accuracy": ACCURACY_AT, "precision": PRECISION_RECALL_AT, "recall": PRECISION_RECALL_AT,
    "mrr": MRR_AT, "ndcg": NDCG_AT, "map": MAP_AT,
}


def max_k(cuts: dict[str, list[int]]) -> int:
    """The largest cut-off requested; a search needs that many hits."""
    return max(k for ks in cuts.values() for k in ks)


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.filter("score >= 1").select(*QUERY, "corpus_id").distinct()


def join_rel(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ``rel``: whether the hit is a relevant document of its query."""
    marked = relevant(qrels).withColumn("rel", F.lit(True))
    return run.join(marked, [*QUERY, "corpus_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(False)))


def run_hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant hits only, with ``hit_no``: how many of the query's hits came up to this rank."""
    found = run.join(relevant(qrels), [*QUERY, "corpus_id"], "left_semi")
    order = Window.partitionBy(*QUERY, "score_fn").orderBy("rank")  # at most k rows
    return found.withColumn("hit_no", F.row_number().over(order))


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(first, last) -> Column:
    """Sum of the discounts of ranks ``first``..``last``; 0 if there are none."""
    ranks = F.sequence(first.cast("int"), last.cast("int"))
    total = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + _discount(r))
    return F.when(last >= first, total).otherwise(F.lit(0.0))


# Metrics by name: per-query value at cut-off k. ``h`` sums an expression over the relevant hits
# with rank <= k; ``n_rel`` is the number of relevant documents of the query.
def _hits_upto(k: int, value=None) -> Column:
    value = F.lit(1.0) if value is None else value
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, value)), F.lit(0.0))


PER_QUERY = {
    "accuracy": lambda k: F.coalesce(F.max(F.when(F.col("rank") <= k, 1.0)), F.lit(0.0)),
    "precision": lambda k: _hits_upto(k) / k,
    "recall": lambda k: _hits_upto(k) / F.first("n_rel"),
    "mrr": lambda k: F.coalesce(
        F.lit(1.0) / F.min(F.when(F.col("rank") <= k, F.col("rank"))), F.lit(0.0)),
    "ndcg": lambda k: _hits_upto(k, _discount(F.col("rank")))
    / _ideal(F.lit(1), F.least(F.first("n_rel"), F.lit(k))),
    "map": lambda k: _hits_upto(k, F.col("hit_no") / F.col("rank"))
    / F.least(F.first("n_rel"), F.lit(k)),
    "recall_cap": lambda k: _hits_upto(k) / F.least(F.first("n_rel"), F.lit(k)),
}


def per_query(run: DataFrame, qrels: DataFrame, cuts: dict[str, list[int]],
              score_fns: list[str], queries: DataFrame | None = None) -> DataFrame:
    """One row per judged query and score function, one column ``metric@k`` per cut-off.

    Queries without a hit count 0. ``queries`` (dataset, query_id) limits them to a query set.
    """
    counts = relevant(qrels).groupBy(*QUERY).agg(F.count(F.lit(1)).alias("n_rel"))
    if queries is not None:
        counts = counts.join(queries.select(*QUERY).distinct(), QUERY, "left_semi")
    base = counts.withColumn("score_fn", F.explode(F.array(*[F.lit(s) for s in score_fns])))
    hits = run_hits(run, qrels).select(*QUERY, "score_fn", "rank", "hit_no")
    joined = base.join(hits, [*QUERY, "score_fn"], "left")
    values = [PER_QUERY[m](k).alias(f"{m}@{k}") for m, ks in cuts.items() for k in ks]
    return joined.groupBy(*QUERY, "score_fn").agg(*values)


def to_long(wide: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """``metric@k`` columns to rows (metric, k, value)."""
    long = wide.unpivot(ids, [F.col(f"`{n}`") for n in names], "name", "value")
    part = F.split("name", "@")
    return long.select(*ids, part[0].alias("metric"), part[1].cast("int").alias("k"), "value")


def evaluate_binary(run: DataFrame, qrels: DataFrame, score_fns: list[str],
                    cuts: dict[str, list[int]] | None = None,
                    queries: DataFrame | None = None) -> DataFrame:
    """metrics(dataset, score_fn, metric, k, value): means over all judged queries."""
    cuts = cuts or DEFAULT_CUTS
    names = [f"{m}@{k}" for m, ks in cuts.items() for k in ks]
    rows = per_query(run, qrels, cuts, score_fns, queries)
    wide = rows.groupBy(*GROUP).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return to_long(wide, GROUP, names)


# -- graded family -------------------------------------------------------------------------


def ideal_dcg(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query the best possible graded DCG at each cut-off (``ideal@k``) and ``n_rel``.

    Judgements are counted per grade first, so a query with very many judgements becomes a few
    rows before anything is ordered; a grade then fills a span of ranks.
    """
    grades = qrels.groupBy(*QUERY, "score").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*QUERY).orderBy(F.desc("score"))
    spans = grades.withColumn("last", F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "first", F.col("last") - F.col("n") + 1)
    gain = F.greatest(F.col("score"), F.lit(0)).cast("double")
    ideals = [F.sum(gain * _ideal(F.least(F.col("first"), F.lit(k + 1)),
                                  F.least(F.col("last"), F.lit(k)))).alias(f"ideal@{k}")
              for k in ks]
    n_rel = F.coalesce(F.sum(F.when(F.col("score") >= 1, F.col("n"))), F.lit(0)).alias("n_rel")
    return spans.groupBy(*QUERY).agg(n_rel, *ideals)


def graded_columns(ks: list[int], metrics: list[str]) -> list[Column]:
    """Aggregates over a query's judged hits (rank, grade, hit_no), with its ideals and n_rel."""
    rel = F.col("grade") >= 1
    n_rel = F.first("n_rel")
    share = lambda a, b: F.coalesce(F.try_divide(a, b.cast("double")), F.lit(0.0))
    total = lambda k, value, when: F.coalesce(
        F.sum(F.when((F.col("rank") <= k) & when, value)), F.lit(0.0))
    found = lambda k: total(k, F.lit(1.0), rel)
    value = {
        "NDCG": lambda k: share(
            total(k, F.col("grade") * _discount(F.col("rank")), F.col("grade") > 0),
            F.first(f"ideal@{k}")),
        "MAP": lambda k: share(total(k, F.col("hit_no") / F.col("rank"), rel), n_rel),
        "Recall": lambda k: share(found(k), n_rel),
        "P": lambda k: found(k) / k,
        "MRR": lambda k: F.coalesce(
            F.lit(1.0) / F.min(F.when((F.col("rank") <= k) & rel, F.col("rank"))), F.lit(0.0)),
        "R_cap": lambda k: share(found(k), F.least(n_rel, F.lit(k))),
    }
    return [value[m](k).alias(f"{m}@{k}") for m in metrics for k in ks]


def graded_per_query(run: DataFrame, qrels: DataFrame, ks: list[int],
                     metrics: list[str]) -> DataFrame:
    """Per query and score function the graded metrics at each cut-off.

    Queries are those in both the run and the judgements. A query without relevant documents
    scores 0 throughout.
    """
    searched = run.select(*QUERY, "score_fn").distinct().join(ideal_dcg(qrels, ks), QUERY)
    grades = qrels.select(*QUERY, "corpus_id", F.col("score").alias("grade"))
    order = Window.partitionBy(*QUERY, "score_fn").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, 0)  # at most k rows
    hits = run.select(*QUERY, "score_fn", "corpus_id", "rank").join(
        grades, [*QUERY, "corpus_id"]).drop("corpus_id").withColumn(
        "hit_no", F.sum((F.col("grade") >= 1).cast("int")).over(order))
    joined = searched.join(hits, [*QUERY, "score_fn"], "left")
    return joined.groupBy(*QUERY, "score_fn").agg(*graded_columns(ks, metrics))


def hole(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Hole@k: share of the top k that no query's judgements mention, over all listed queries.

    Hits are counted per document before the anti join, so a document that turns up for very
    many queries is one row.
    """
    counts = run.groupBy(*GROUP, "corpus_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"n@{k}") for k in ks])
    judged = qrels.select("dataset", "corpus_id").distinct()
    marked = counts.join(judged.withColumn("_judged", F.lit(True)), ["dataset", "corpus_id"], "left")
    unjudged = F.col("_judged").isNull()
    sums = marked.groupBy(*GROUP).agg(
        *[F.coalesce(F.sum(F.when(unjudged, F.col(f"`n@{k}`"))), F.lit(0)).alias(f"n@{k}")
          for k in ks])
    listed = qrels.groupBy("dataset").agg(F.count_distinct("query_id").alias("n_queries"))
    return sums.join(listed, "dataset").select(
        *GROUP, *[(F.col(f"`n@{k}`") / F.lit(float(k)) / F.col("n_queries")).alias(f"Hole@{k}")
                  for k in ks])


MEAN_METRICS = ["NDCG", "MAP", "Recall", "P"]
LISTED_METRICS = ["MRR", "R_cap"]
GRADED_METRICS = [*MEAN_METRICS, *LISTED_METRICS, "Hole"]


def evaluate_graded(run: DataFrame, qrels: DataFrame, ks: list[int] | None = None,
                    metrics: list[str] | None = None,
                    digits: int | None = GRADED_DIGITS) -> DataFrame:
    """metrics(dataset, score_fn, metric, k, value) of the graded family.

    NDCG, MAP, Recall and P are means over the searched and judged queries; MRR, R_cap and Hole
    divide by all queries of the judgements. The run is read two or three times: pass a written
    one (:func:`pairloom.session.materialize`), else the search runs again each time.
    """
    ks, metrics = ks or GRADED_AT, metrics or GRADED_METRICS
    parts = []
    chosen = [m for m in metrics if m != "Hole"]
    if chosen:
        listed = qrels.groupBy("dataset").agg(F.count_distinct("query_id").alias("n_queries"))
        rows = graded_per_query(run, qrels, ks, chosen)
        sums = rows.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("n_searched"),
            *[F.sum(F.col(f"`{m}@{k}`")).alias(f"{m}@{k}") for m in chosen for k in ks])
        over = lambda m: F.col("n_searched" if m in MEAN_METRICS else "n_queries")
        names = [f"{m}@{k}" for m in chosen for k in ks]
        wide = sums.join(listed, "dataset").select(
            *GROUP, *[(F.col(f"`{n}`") / over(n.split("@")[0])).alias(n) for n in names])
        parts.append(to_long(wide, GROUP, names))
    if "Hole" in metrics:
        parts.append(to_long(hole(run, qrels, ks), GROUP, [f"Hole@{k}" for k in ks]))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return long if digits is None else long.withColumn("value", F.round("value", digits))


# -- on top of metrics ---------------------------------------------------------------------


def headline(metrics: DataFrame, metric: str = "ndcg", score_fn: str | None = None) -> DataFrame:
    """Per collection the metric at its largest k, for one score function or the best of all."""
    chosen = metrics.filter(F.col("metric") == metric)
    if score_fn:
        chosen = chosen.filter(F.col("score_fn") == score_fn)
    at_top = chosen.groupBy(*GROUP).agg(F.max_by("value", "k").alias("value"))
    return at_top.groupBy("dataset").agg(F.max("value").alias("headline"))


class WrongCollectionCount(AssertionError):
    pass


def macro(metrics: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """Mean over collections times 100 for the other ``keys``, with the number of collections."""
    out = metrics.groupBy(*keys, "metric", "k").agg(
        (F.avg("value") * 100).alias("value"), F.count("value").alias("collections"))
    if expected is not None:
        wrong = out.filter(F.col("collections") != expected).take(1)
        if wrong:
            raise WrongCollectionCount(
                f"{expected} collections expected, {wrong[0]['collections']} found "
                f"for {wrong[0]['metric']}")
    return out


def readable(metrics: DataFrame) -> DataFrame:
    """``text``: percentages with 2 decimals for accuracy, precision and recall, else 4 decimals.

    Halves go to the even digit.
    """
    share = F.col("metric").isin("accuracy", "precision", "recall")
    percent = F.format_string("%.2f%%", F.bround(F.col("value") * 100, 2))
    return metrics.withColumn("text", F.when(share, percent).otherwise(
        F.format_string("%.4f", F.bround("value", 4))))
