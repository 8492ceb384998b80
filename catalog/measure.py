"""Search, rank metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import entry
from pairloom.functions.text import SEPARATOR, passage_for_encoder, sim_of_name
from pairloom.functions.vectors import SCORE_EXPRESSIONS
from pairloom.operators import metrics as met, pairs as prs, report
from pairloom.operators.encode import encode, hashed_words
from pairloom.operators.search import SCORE_FNS, topk_search
from pairloom.plans import evaluate
from pairloom.session import materialize, scratch_dir

FNS = sorted(SCORE_FNS)
KS = [1, 3, 5, 10, 100]
RUN_COLUMNS = "dataset, score_fn, query_id, corpus_id, score, rank"
VECTOR_EVAL = (v.VECTOR_RUN_SQL, v.VECTOR_QRELS_SQL)


# -- search --------------------------------------------------------------------------------


@entry("topk_search", v.with_(v.VECTOR_RUN_SQL, select=f"SELECT {RUN_COLUMNS} FROM run"))
def topk_vectors(spark, d):
    return v.vector_run(spark, d)


@entry("win_rank", v.with_(v.REPLY_RUN_SQL, select=f"SELECT {RUN_COLUMNS} FROM run"))
def win_rank(spark, d):
    return v.reply_run(spark, d)


@entry("score_cos", v.with_(v.REPLY_RUN_SQL, select=f"""
SELECT {RUN_COLUMNS} FROM run WHERE score_fn = 'cos_sim'"""))
def score_cos(spark, d):
    return v.reply_run(spark, d, score_fns={"cos_sim": SCORE_FNS["cos_sim"]})


@entry("score_dot", v.with_(v.REPLY_RUN_SQL, select=f"""
SELECT {RUN_COLUMNS} FROM run WHERE score_fn = 'dot_score'"""))
def score_dot(spark, d):
    return v.reply_run(spark, d, score_fns={"dot_score": SCORE_FNS["dot_score"]})


def negative_distance(queries, docs):
    """A plugged-in score function: minus the squared distance."""
    own = (queries ** 2).sum(axis=1)[:, None] + (docs ** 2).sum(axis=1)[None, :]
    return 2 * queries @ docs.T - own


@entry("udf_score", v.with_(v.VECTORS_SQL, select=f"""
SELECT query_id, corpus_id, score, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id))::INTEGER AS rank
  FROM (SELECT q._id AS query_id, c._id AS corpus_id,
          round(2 * list_dot_product(q.vec, c.vec) - q.norm ** 2 - c.norm ** 2, 9) AS score
        FROM vectors q, vectors c WHERE q._id <> c._id)
  QUALIFY rank <= 10)"""))
def udf_score(spark, d):
    vec = v.vectors(spark, d)
    run = topk_search(vec, vec, 10, {"distance": negative_distance}, dataset="dataset", skip_self=True)
    return run.select("query_id", "corpus_id", "score", "rank")


@entry("join_score", v.with_(*VECTOR_EVAL, select="""
SELECT r.query_id, r.corpus_id, round(p.dot, 6) AS dot_score, round(p.dot / p.norms, 6) AS cos_sim
FROM qrels r JOIN pairs p USING (query_id, corpus_id)"""))
def join_score(spark, d):
    """Scores of all judged pairs; the scores of all other pairs only live inside the search."""
    vec = v.vectors(spark, d)
    side = lambda key, name: vec.select(F.col("_id").alias(key), F.col("vec").alias(name))
    both = v.vector_qrels(spark, d).join(side("query_id", "q"), "query_id").join(
        side("corpus_id", "c"), "corpus_id")
    scores = [F.round(fn(F.col("q"), F.col("c")), 6).alias(name)
              for name, fn in SCORE_EXPRESSIONS.items()]
    return both.select("query_id", "corpus_id", *scores)


@entry("udf_encode", v.with_(v.TURNS_SQL, v.WORDS_SQL, select=f"""
SELECT _id, (unnest(range({v.DIM})))::INTEGER AS bucket, round(unnest(unit), 6) AS value
FROM (SELECT _id, CASE WHEN n = 0 THEN vec ELSE list_transform(vec, lambda x: x / n) END AS unit
      FROM (SELECT _id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM encoded))"""))
def udf_encode(spark, d):
    """Queries and passages through their own encoder hooks (here two of the same kind)."""
    asked = encode(v.questions(spark, d).select("_id", "text"), hashed_words(v.DIM))
    docs = v.replies(spark, d).select("_id", passage_for_encoder(
        F.col("title"), F.col("text"), SEPARATOR).alias("text"))
    docs = encode(docs, hashed_words(v.DIM))
    every = asked.select("_id", "vec").unionByName(docs.select("_id", "vec"))
    return every.select("_id", F.posexplode("vec").alias("bucket", "value")).withColumn(
        "value", F.round("value", 6))


# -- binary metrics ------------------------------------------------------------------------

BINARY_SQL = """rel AS (SELECT DISTINCT dataset, query_id, corpus_id FROM qrels WHERE score >= 1),
n_rel AS (SELECT dataset, query_id, count(*) AS n FROM rel GROUP BY ALL),
hits AS (
  SELECT r.dataset, r.score_fn, r.query_id, r.rank,
    row_number() OVER (PARTITION BY r.dataset, r.score_fn, r.query_id ORDER BY r.rank) AS hit_no
  FROM run r JOIN rel USING (dataset, query_id, corpus_id)),
asked AS (
  SELECT n_rel.*, fns.score_fn, h.rank, h.hit_no FROM n_rel CROSS JOIN fns
  LEFT JOIN hits h ON h.dataset = n_rel.dataset AND h.query_id = n_rel.query_id
    AND h.score_fn = fns.score_fn)"""


def ideal_sql(n: str, k: int) -> str:
    return (f"list_sum(list_transform(range(1, least({n}, {k}) + 1), "
            f"lambda r: 1.0::DOUBLE / log2(r + 1)))")


def binary_value(metric: str, k: int) -> str:
    inside = f"CASE WHEN rank <= {k} THEN"
    return {
        "accuracy": f"coalesce(max({inside} 1.0::DOUBLE END), 0)",
        "precision": f"count({inside} 1 END) / {k}::DOUBLE",
        "recall": f"count({inside} 1 END) / any_value(n)::DOUBLE",
        "mrr": f"coalesce(1.0::DOUBLE / min({inside} rank END), 0)",
        "ndcg": f"coalesce(sum({inside} 1.0::DOUBLE / log2(rank + 1) END), 0) / {ideal_sql('any_value(n)', k)}",
        "map": f"coalesce(sum({inside} hit_no / rank::DOUBLE END), 0) / least(any_value(n), {k})",
        "recall_cap": f"count({inside} 1 END) / least(any_value(n), {k})::DOUBLE",
    }[metric]


def binary_ctes(cuts: dict[str, list[int]]) -> str:
    """BINARY_SQL plus ``metrics`` (dataset, score_fn, metric, k, value)."""
    pairs = [(m, k) for m, ks in cuts.items() for k in ks]
    columns = ", ".join(f'{binary_value(m, k)} AS "{m}@{k}"' for m, k in pairs)
    long = " UNION ALL ".join(
        f"""SELECT dataset, score_fn, '{m}' AS metric, {k} AS k, avg("{m}@{k}") AS value
  FROM per_query GROUP BY dataset, score_fn""" for m, k in pairs)
    return f"""{BINARY_SQL},
per_query AS (SELECT dataset, score_fn, query_id, {columns} FROM asked GROUP BY ALL),
metrics AS ({long})"""


METRIC_ROWS = "SELECT dataset, score_fn, metric, k, round(value, 6) AS value FROM metrics"


def _binary(name: str, cuts: dict[str, list[int]], run_sql, run, qrels):
    sql = v.with_(*run_sql, binary_ctes(cuts), select=METRIC_ROWS)

    @entry(name, sql)
    def query(spark, d):
        found = met.evaluate_binary(run(spark, d), qrels(spark, d), FNS, cuts)
        return found.withColumn("value", F.round("value", 6))


REPLY = ((v.REPLY_RUN_SQL,), v.reply_run, v.reply_qrels)
VECTOR = (VECTOR_EVAL, v.vector_run, v.vector_qrels)
_binary("met_accuracy", {"accuracy": met.ACCURACY_AT}, *REPLY)
_binary("met_precision", {"precision": met.PRECISION_RECALL_AT}, *VECTOR)
_binary("met_recall", {"recall": met.PRECISION_RECALL_AT}, *REPLY)
_binary("met_mrr", {"mrr": met.MRR_AT}, *VECTOR)
_binary("met_ndcg", {"ndcg": met.NDCG_AT}, *VECTOR)
_binary("met_map", {"map": met.MAP_AT}, *REPLY)
_binary("udf_metric", {"recall_cap": [5, 50]}, *REPLY)


@entry("join_rel", v.with_(*VECTOR_EVAL, BINARY_SQL, select="""
SELECT r.dataset, r.score_fn, r.query_id, r.corpus_id, r.rank, rel.corpus_id IS NOT NULL AS rel
FROM run r LEFT JOIN rel USING (dataset, query_id, corpus_id)"""))
def join_rel(spark, d):
    return met.join_rel(v.vector_run(spark, d), v.vector_qrels(spark, d)).drop("score")


@entry("win_run_hits", v.with_(*VECTOR_EVAL, BINARY_SQL, select="""
SELECT dataset, score_fn, query_id, rank, hit_no::INTEGER AS hit_no FROM hits"""))
def win_run_hits(spark, d):
    return met.run_hits(v.vector_run(spark, d), v.vector_qrels(spark, d)).drop("score", "corpus_id")


# -- graded metrics ------------------------------------------------------------------------

GRADED_SQL = """per_judged AS (
  SELECT dataset, query_id, count(*) FILTER (WHERE score >= 1) AS n FROM qrels GROUP BY ALL),
best AS (
  SELECT dataset, query_id, greatest(score, 0) AS gain,
    row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC) AS place FROM qrels),
graded_hits AS (
  SELECT r.dataset, r.score_fn, r.query_id, r.rank, q.score AS grade,
    sum((q.score >= 1)::INTEGER) OVER (PARTITION BY r.dataset, r.score_fn, r.query_id
      ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS hit_no
  FROM run r JOIN qrels q USING (dataset, query_id, corpus_id)),
searched AS (
  SELECT DISTINCT dataset, score_fn, query_id, n FROM run JOIN per_judged USING (dataset, query_id)),
found AS (SELECT s.*, rank, grade, hit_no FROM searched s
          LEFT JOIN graded_hits USING (dataset, score_fn, query_id)),
listed AS (SELECT dataset, count(*) AS n_queries FROM per_judged GROUP BY dataset),
annotated AS (SELECT DISTINCT dataset, corpus_id FROM qrels)"""


def graded_sql(metrics: list[str], ks: list[int] = KS) -> str:
    hit = lambda k: f"count(CASE WHEN rank <= {k} AND grade >= 1 THEN 1 END)"
    value = {
        "NDCG": lambda k: f"coalesce(sum(CASE WHEN rank <= {k} AND grade > 0 THEN grade / log2(rank + 1) END)"
        f" / nullif(any_value(ideal_{k}), 0), 0)",
        "MAP": lambda k: f"coalesce(sum(CASE WHEN rank <= {k} AND grade >= 1 THEN hit_no / rank::DOUBLE END)"
        " / nullif(any_value(n), 0), 0)",
        "Recall": lambda k: f"coalesce({hit(k)} / nullif(any_value(n), 0)::DOUBLE, 0)",
        "P": lambda k: f"{hit(k)} / {k}::DOUBLE",
        "MRR": lambda k: f"coalesce(1.0::DOUBLE / min(CASE WHEN rank <= {k} AND grade >= 1 THEN rank END), 0)",
        "R_cap": lambda k: f"coalesce({hit(k)} / nullif(least(any_value(n), {k}), 0)::DOUBLE, 0)",
    }
    ideals = ", ".join(f"sum(CASE WHEN place <= {k} THEN gain / log2(place + 1) END) AS ideal_{k}" for k in ks)
    pairs = [(m, k) for m in metrics for k in ks]
    columns = ", ".join(f'{value[m](k)} AS "{m}@{k}"' for m, k in pairs if m in value)
    rows = []
    for m, k in pairs:
        head = f"SELECT dataset, score_fn, '{m}' AS metric, {k} AS k,"
        if m == "Hole":
            rows.append(f"""{head} round(count(*) FILTER (WHERE rank <= {k} AND a.corpus_id IS NULL)
  / {k}::DOUBLE / any_value(n_queries), 5) AS value FROM run LEFT JOIN annotated a
  USING (dataset, corpus_id) JOIN listed USING (dataset) GROUP BY dataset, score_fn""")
        elif m in ("MRR", "R_cap"):
            rows.append(f"""{head} round(sum("{m}@{k}") / any_value(n_queries), 5) AS value
  FROM per_query JOIN listed USING (dataset) GROUP BY dataset, score_fn""")
        else:
            rows.append(f"""{head} round(avg("{m}@{k}"), 5) AS value
  FROM per_query GROUP BY dataset, score_fn""")
    middle = f""",
ideals AS (SELECT dataset, query_id, {ideals} FROM best GROUP BY ALL),
per_query AS (SELECT dataset, score_fn, query_id, {columns or '1 AS one'}
  FROM found JOIN ideals USING (dataset, query_id) GROUP BY dataset, score_fn, query_id)"""
    return v.with_(v.REPLY_RUN_SQL, GRADED_SQL + middle, select=" UNION ALL ".join(rows))


def _graded(name: str, metrics: list[str]):
    @entry(name, graded_sql(metrics))
    def query(spark, d):
        run = v.reply_run(spark, d, written=True)
        return met.evaluate_graded(run, v.reply_qrels(spark, d), KS, metrics)


_graded("met_trec", ["NDCG", "MAP", "Recall", "P"])
_graded("met_mrr_custom", ["MRR"])
_graded("met_recall_cap", ["R_cap"])
_graded("met_hole", ["Hole"])


# -- on top of metrics ---------------------------------------------------------------------

ALL_CUTS = met.DEFAULT_CUTS


def reply_metrics(spark, d, cuts=None):
    return met.evaluate_binary(v.reply_run(spark, d), v.reply_qrels(spark, d), FNS, cuts or ALL_CUTS)


HEAD_CUTS = {"ndcg": [3, 10]}


@entry("met_headline", v.with_(v.REPLY_RUN_SQL, binary_ctes(HEAD_CUTS), select="""
SELECT dataset, round(max(value), 6) AS headline FROM metrics WHERE k = 10 GROUP BY dataset"""))
def met_headline(spark, d):
    best = met.headline(reply_metrics(spark, d, HEAD_CUTS), "ndcg")
    return best.withColumn("headline", F.round("headline", 6))


@entry("agg_macro", v.with_(v.REPLY_RUN_SQL, binary_ctes(ALL_CUTS), select="""
SELECT score_fn, metric, k, round(avg(value) * 100, 6) AS value, count(*) AS collections
FROM metrics GROUP BY score_fn, metric, k"""))
def agg_macro(spark, d):
    return met.macro(reply_metrics(spark, d), ["score_fn"]).withColumn("value", F.round("value", 6))


@entry("rep_scores", v.with_(VECTOR_EVAL[0], VECTOR_EVAL[1], binary_ctes(ALL_CUTS), select="""
SELECT score_fn, metric, k, CASE WHEN metric IN ('accuracy', 'precision', 'recall')
  THEN printf('%.2f%%', value * 100) ELSE printf('%.4f', value) END AS text FROM metrics"""))
def rep_scores(spark, d):
    found = met.evaluate_binary(v.vector_run(spark, d), v.vector_qrels(spark, d), FNS)
    return met.readable(found).select("score_fn", "metric", "k", "text")


RESULT_CUTS = {"ndcg": [10], "recall": [100], "mrr": [10]}
RESULTS_SQL = v.with_(v.REPLY_RUN_SQL, binary_ctes(RESULT_CUTS), select="""
SELECT score_fn || '_words' AS model, dataset, metric || '@' || k AS metric,
  round(value * 100, 6) AS value FROM metrics""")


def results(spark, d):
    """Result rows (model, dataset, metric, k, value in percent)."""
    found = reply_metrics(spark, d, RESULT_CUTS)
    return found.select(F.concat("score_fn", F.lit("_words")).alias("model"), "dataset", "metric",
                        "k", (F.col("value") * 100).alias("value"))


def sheet_sql(results: str) -> str:
    """The cells of the sheets in ``results``, blank ones included, and their averages, one row each."""
    kind = "CASE WHEN contains(model, 'cos_sim') THEN 'cos_sim' ELSE 'dot_score' END AS similarity"
    return f"""WITH r AS ({results}),
cells AS (SELECT * FROM (SELECT DISTINCT metric, model FROM r) CROSS JOIN (SELECT DISTINCT dataset FROM r))
SELECT metric, model, {kind}, dataset AS collection, value FROM cells LEFT JOIN r USING (metric, model, dataset)
UNION ALL SELECT metric, model, {kind}, 'average', round(avg(value), 6) FROM r GROUP BY metric, model"""


def sheet_cells(sheets):
    keys = ["metric", "model", "similarity"]
    cells = [F.col(f"`{c}`") for c in sheets.columns if c not in keys]
    return sheets.unpivot(keys, cells, "collection", "value").withColumn("value", F.round("value", 6))


@entry("agg_pivot", sheet_sql(RESULTS_SQL))
def agg_pivot(spark, d):
    """The sheets of three metrics over all collections of the data, cell by cell."""
    rows = results(spark, d).withColumn("metric", F.concat_ws("@", "metric", "k"))
    rows = materialize(rows, "results")
    return sheet_cells(report.score_sheets(rows, [f"{m}@{k}" for m, ks in RESULT_CUTS.items() for k in ks]))


@entry("flow_report", sheet_sql(f"""
SELECT 'cos_sim_words' AS model, dataset, metric || '@' || k AS metric, round(value * 100, 6) AS value
FROM ({graded_sql(["NDCG", "Recall", "MRR"], [10, 100])})
WHERE score_fn = 'cos_sim' AND metric || '@' || k IN ('NDCG@10', 'Recall@100', 'MRR@10')"""))
def flow_report(spark, d):
    """One model is evaluated on all collections, its result files are written, the report reads them."""
    path = scratch_dir(spark, "results")
    rows = evaluate.evaluate_model(
        v.questions(spark, d), v.replies(spark, d), v.reply_qrels(spark, d), "cos_sim_words",
        hashed_words(v.DIM, normalize=False), "cos_sim", k_values=[10, 100], dim=v.DIM)
    evaluate.write_evaluation(rows, path)
    return sheet_cells(evaluate.report(spark, path, every=False))


HISTORY = report.history_columns(FNS, ALL_CUTS)


def history(spark, d):
    """Metric history: one evaluation per collection, its depth is the epoch."""
    found = reply_metrics(spark, d).withColumn(
        "epoch", F.regexp_replace("dataset", "turn", "").cast("int")).withColumn("steps", F.lit(-1))
    return report.history_row(found, HISTORY, ["epoch", "steps"])


_wide = ", ".join(
    f"""round(max(CASE WHEN score_fn || '-' || lower(metric) || '@' || k = '{c.split('-')[0]}-{c.split('-')[1].lower()}'
  THEN value END), 6) AS "{c}\"""" for c in HISTORY)
_HISTORY_CTES = (v.REPLY_RUN_SQL, binary_ctes(ALL_CUTS))
HISTORY_SQL = v.with_(*_HISTORY_CTES, select=f"""
SELECT substring(dataset, 5)::INTEGER AS epoch, -1 AS steps, {_wide} FROM metrics GROUP BY dataset""")


@entry("agg_unpivot", v.with_(*_HISTORY_CTES, f"wide AS ({HISTORY_SQL})", select=" UNION ALL ".join(
    f"""SELECT epoch, steps, '{c}' AS metric, "{c}" AS value FROM wide"""
    for c in HISTORY if "cos_sim" in c)))
def agg_unpivot(spark, d):
    series = report.history_series(history(spark, d), "cos_sim")
    return series.withColumn("value", F.round("value", 6))


_dot = sorted(c for c in HISTORY if "dot_score" in c)


@entry("flt_column", f"SELECT {', '.join(chr(34) + c + chr(34) for c in _dot)} FROM ({HISTORY_SQL})")
def flt_column(spark, d):
    rows = history(spark, d)
    return rows.select(*[F.round(F.col(f"`{c}`"), 6).alias(c)
                         for c in report.similarity_columns(rows, "dot_score")])


# -- judgements ----------------------------------------------------------------------------


@entry("flt_relevant", v.with_(v.VECTOR_QRELS_SQL, select="""
SELECT query_id, corpus_id, score FROM qrels WHERE score >= 1"""))
def flt_relevant(spark, d):
    return v.vector_qrels(spark, d).filter("score >= 1").select("query_id", "corpus_id", "score")


@entry("flt_judged_q", v.with_(v.TURNS_SQL, select="""
SELECT _id, text FROM questions WHERE _id IN (SELECT query_id FROM qrels WHERE score >= 1)"""))
def flt_judged_q(spark, d):
    data = v.conversation_collection(spark, d)
    return prs.judged_queries(data.queries, data.qrels).select("_id", "text")


@entry("agg_relset", v.with_(v.VECTOR_QRELS_SQL, select="""
SELECT DISTINCT query_id, corpus_id FROM qrels WHERE score >= 1"""))
def agg_relset(spark, d):
    return prs.relevance_sets(v.vector_qrels(spark, d))


@entry("agg_sizes", v.with_(v.TURNS_SQL, select="""
SELECT 'corpus' AS part, count(DISTINCT _id) AS size FROM replies
UNION ALL SELECT 'queries', count(DISTINCT query_id) FROM qrels
UNION ALL SELECT 'qrels', count(DISTINCT query_id) FROM qrels"""))
def agg_sizes(spark, d):
    return prs.agg_sizes(v.conversation_collection(spark, d))


# -- reports on runs -----------------------------------------------------------------------


@entry("agg_gen_time", v.with_(v.FACTS_SQL, select="""
SELECT model_name, split, round(sum(time_in_minutes) / 60 / 24, 12) AS days,
  round(sum(time_in_minutes) / 60 / 24 / 8, 12) AS days_parallel FROM facts GROUP BY ALL"""))
def agg_gen_time(spark, d):
    days = report.generation_time(v.facts(spark, d))
    return days.withColumn("days", F.round("days", 12)).withColumn(
        "days_parallel", F.round("days_parallel", 12))


@entry("flt_failed", v.with_(v.FACTS_SQL, select="""
SELECT shard_id, split, time_in_minutes FROM facts AS f WHERE NOT EXISTS (
  SELECT 1 FROM facts AS g WHERE g.errors > 0 AND g.split = f.split AND g.shard_id = f.shard_id)"""))
def flt_failed(spark, d):
    """Outputs that stay once the failed shards are marked for another run."""
    facts = v.facts(spark, d)
    return report.without_failed(facts.select("shard_id", "split", "time_in_minutes"), facts)


@entry("sort_ids", v.with_(v.FACTS_SQL, select="""
SELECT split, shard_id, errors FROM facts WHERE errors > 0 ORDER BY split, shard_id"""))
def sort_ids(spark, d):
    return report.failed_shards(v.facts(spark, d))


@entry("sim_of_name", """
SELECT event_id, model, CASE WHEN contains(model, 'cos_sim') THEN 'cos_sim'
  WHEN contains(model, 'dot_score') THEN 'dot_score' ELSE '' END AS similarity
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'cos_sim_dot_score_' WHEN 'view' THEN
  'dot_score_' WHEN 'error' THEN '' ELSE 'cos_sim_' END || user_id AS model FROM events)""")
def names(spark, d):
    e = v.table(spark, d, "events")
    kind = F.col("event_type")
    prefix = (F.when(kind == "click", "cos_sim_dot_score_").when(kind == "view", "dot_score_")
              .when(kind == "error", "").otherwise("cos_sim_"))
    model = F.concat(prefix, F.col("user_id").cast("string"))
    return e.select("event_id", model.alias("model"), sim_of_name(model).alias("similarity"))
