"""Sources and sinks: a driver table is written, read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.measure import HISTORY, HISTORY_SQL, RESULTS_SQL, history, results
from catalog.registry import entry
from pairloom import schemas
from pairloom.functions.text import split_of
from pairloom.operators.sampling import shard_assign
from pairloom.session import materialize, scratch_dir
from pairloom.sources import collections, files, outputs, prompts

CORPUS_OUT = "SELECT _id, title, text, lang FROM corpus"
DOCS_SQL = v.with_(v.CORPUS_SQL, select=CORPUS_OUT)


def _flat(corpus):
    return corpus.select("_id", "title", "text", F.col("metadata")["lang"].alias("lang"))


def _numeric_ids(spark, d):
    return v.corpus(spark, d).select(F.col("pos").alias("_id"), "title", "text", "metadata")


@entry("io_jsonl", DOCS_SQL)
def io_jsonl(spark, d):
    path = scratch_dir(spark, "jsonl")
    files.write_json(_numeric_ids(spark, d), path)
    return _flat(files.read_jsonl(spark, path, schemas.CORPUS))


@entry("io_json", DOCS_SQL)
def io_json(spark, d):
    path = scratch_dir(spark, "json")
    files.write_json_array(_numeric_ids(spark, d), path)
    return _flat(files.read_json(spark, path, schemas.CORPUS))


TURN_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
TURN_ROWS = "SELECT conv_id, turn, role, text FROM conversations"


@entry("io_write_json", TURN_ROWS)
def io_write_json(spark, d):
    path = scratch_dir(spark, "array")
    files.write_json_array(v.table(spark, d, "conversations"), path)
    return files.read_json(spark, path, TURN_SCHEMA)


@entry("io_to_jsonl", TURN_ROWS)
def io_to_jsonl(spark, d):
    path = scratch_dir(spark, "turns") + ".json"
    files.write_json_array(v.table(spark, d, "conversations"), path)
    return files.read_jsonl(spark, files.json_to_jsonl(spark, path, TURN_SCHEMA), TURN_SCHEMA)


def _regraded(spark, d):
    """All judgements, then those of grade 0 once more with grade 1, in file order."""
    q = v.vector_qrels(spark, d).drop("dataset")
    again = q.filter("score = 0").withColumn("score", F.lit(1)).withColumn(
        "pos", F.col("pos") + (1 << 40))
    return q.unionByName(again).orderBy("pos")


@entry("io_qrels_read", v.with_(v.VECTOR_QRELS_SQL, select="""
SELECT query_id, corpus_id, CASE WHEN score = 0 THEN 1 ELSE score END AS score FROM qrels"""))
def io_qrels_read(spark, d):
    path = scratch_dir(spark, "qrels")
    collections.write_qrels(_regraded(spark, d), path)
    return collections.read_qrels(spark, path).drop("pos")


@entry("io_qrels_write", v.with_(v.VECTOR_QRELS_SQL, select="""
SELECT query_id || chr(9) || corpus_id || chr(9) || score AS line FROM qrels"""))
def io_qrels_write(spark, d):
    path = scratch_dir(spark, "qrels")
    collections.write_qrels(v.vector_qrels(spark, d), path)
    header = "\t".join(collections.QREL_HEADER)
    return spark.read.text(path).select(F.col("value").alias("line")).filter(
        F.col("line") != header)


@entry("io_beir_load", v.with_(v.TURNS_SQL, select="""
SELECT 'corpus' AS part, _id AS id, text AS body FROM replies
UNION ALL SELECT 'queries', _id, text FROM questions WHERE _id IN (SELECT query_id FROM qrels)
UNION ALL SELECT 'qrels', query_id, corpus_id || ' ' || score FROM qrels"""))
def io_beir_load(spark, d):
    root = scratch_dir(spark, "collection")
    split = collections.evaluation_split("conversations")
    collections.write_collection(v.conversation_collection(spark, d), root, split)
    data = collections.load_collection(spark, root, split)
    part = lambda name, i, body: (F.lit(name).alias("part"), F.col(i).alias("id"), body.alias("body"))
    return (data.corpus.select(*part("corpus", "_id", F.col("text")))
            .unionByName(data.queries.select(*part("queries", "_id", F.col("text"))))
            .unionByName(data.qrels.select(
                *part("qrels", "query_id", F.concat_ws(" ", "corpus_id", "score")))))


@entry("io_split_rule", """
SELECT doc_id, dataset, CASE dataset WHEN 'msmarco' THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'msmarco' ELSE lang END AS dataset FROM documents)""")
def io_split_rule(spark, d):
    docs = v.table(spark, d, "documents")
    name = F.when(F.col("lang") == "en", "msmarco").otherwise(F.col("lang"))
    return docs.select("doc_id", name.alias("dataset"), split_of(name).alias("split"))


@entry("io_corpus_copy", DOCS_SQL)
def io_corpus_copy(spark, d):
    source, target = scratch_dir(spark, "corpus"), scratch_dir(spark, "copy")
    files.write_json(_numeric_ids(spark, d), source)
    collections.copy_corpus(spark, source, target)
    return _flat(files.read_corpus(spark, target, ordered=False))


SHARDS = """SELECT pos, text, least(floor(pos / greatest(n // greatest(n // 90, 1), 1)),
  greatest(n // 90, 1) - 1)::INTEGER AS shard_id
FROM corpus, (SELECT count(*) AS n FROM corpus)"""


def _sharded(spark, d):
    return shard_assign(v.corpus(spark, d).select("pos", "text"), 90)


@entry("io_shard_rw", v.with_(v.CORPUS_SQL, select=SHARDS))
def io_shard_rw(spark, d):
    path = outputs.shards_path(outputs.generated_path(
        scratch_dir(spark, "shards"), "documents", "LLM", "org/model"), "train")
    outputs.write_shards(_sharded(spark, d), path)
    outputs.write_shards(_sharded(spark, d).withColumn("text", F.lit("")), path)  # ignored
    return outputs.read_shards(spark, path, "pos BIGINT, text STRING")


@entry("io_gen_rw", v.with_(v.CORPUS_SQL, f"shards AS ({SHARDS})", select="""
SELECT pos, shard_id, CASE WHEN shard_id IN (SELECT event_id FROM events WHERE event_type = 'error')
  THEN 'again: ' || text ELSE text END AS text FROM shards"""))
def io_gen_rw(spark, d):
    """All shards are written, then the failed ones again."""
    path = scratch_dir(spark, "generated")
    shards = _sharded(spark, d)
    outputs.write_generated(shards, path)
    failed = v.facts(spark, d).filter("errors > 0").select("shard_id")
    again = shards.join(failed, "shard_id", "left_semi").withColumn("text", F.concat(F.lit("again: "), "text"))
    outputs.write_generated(again, path)
    return outputs.read_shards(spark, path, "pos BIGINT, text STRING")


@entry("io_meta_rw", v.with_(v.FACTS_SQL, select="SELECT * FROM facts"))
def io_meta_rw(spark, d):
    path = scratch_dir(spark, "metadata")
    facts = v.facts(spark, d)
    outputs.append_facts(facts.filter("split = 'train'"), path)
    outputs.append_facts(facts.filter("split = 'dev'"), path)
    return outputs.read_facts(spark, path).select(
        "model_name", "split", "shard_id", "time_in_minutes", "errors")


@entry("io_prompts", """
SELECT 'p' || item_id AS name, false AS is_external, 'item' AS info, 2 AS n_steps,
  text || chr(10) || 'Document: {}' AS prompt_0, 'Title:' AS next_0,
  text || chr(10) || 'Document: {}' || chr(10) || 'Title: {}' AS prompt_1, 'Query:' AS next_1
FROM benchmark""")
def io_prompts(spark, d):
    """Every benchmark item becomes the instruction of a two-step prompt in a prompt file."""
    path = scratch_dir(spark, "prompts")
    step = lambda tail, nxt: F.struct(
        F.concat("text", F.lit(tail)).alias("prompt"), F.lit(nxt).alias("next_step"))
    body = F.struct(
        F.lit(False).alias("is_external"), F.lit(2).alias("steps"),
        step("\nDocument: {}", "Title:").alias("0"),
        step("\nDocument: {}\nTitle: {}", "Query:").alias("1"), F.lit("item").alias("info"))
    name = F.concat(F.lit("p"), F.col("item_id").cast("string"))
    v.table(spark, d, "benchmark").select(
        F.to_json(F.create_map(name, body)).alias("value")).write.text(path)
    found = prompts.parse_prompts(spark.read.text(path))
    return found.select(
        "name", "is_external", "info", F.size("steps").alias("n_steps"),
        *[F.col("steps")[i][f].alias(f"{n}_{i}") for i in (0, 1)
          for f, n in (("prompt", "prompt"), ("next_step", "next"))])


@entry("io_metrics_csv", HISTORY_SQL)
def io_metrics_csv(spark, d):
    """One appended line per evaluation; the evaluations are the collections."""
    path = scratch_dir(spark, "history")
    rows = materialize(history(spark, d), "rows")  # read twice
    outputs.append_history(rows.filter("epoch < 3"), path)
    outputs.append_history(rows.filter("epoch >= 3"), path)
    return _rounded(outputs.read_history(spark, path, HISTORY))


def _rounded(wide):
    return wide.select("epoch", "steps", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in HISTORY])


@entry("io_history_csv", HISTORY_SQL)
def io_history_csv(spark, d):
    path = scratch_dir(spark, "history")
    outputs.append_history(history(spark, d), path)
    return _rounded(outputs.read_history(spark, path, HISTORY))


@entry("io_result_json", RESULTS_SQL)
def io_result_json(spark, d):
    path = scratch_dir(spark, "results")
    outputs.write_results(results(spark, d), path)
    return outputs.read_results(spark, path).withColumn("value", F.round("value", 6))


@entry("io_scorecard", """
SELECT 'user' || user_id AS model, 'events' AS algorithm, 'days' AS trained_on, metric,
  event_type AS dataset, CASE WHEN event_type <> 'error' THEN value END AS value
FROM (SELECT user_id, event_type, unnest(['count', 'best']) AS metric,
        unnest([count(*)::DOUBLE, max(value)]) AS value FROM events GROUP BY user_id, event_type)""")
def io_scorecard(spark, d):
    """A nested card per user: metric -> event type -> number, empty for errors."""
    path = scratch_dir(spark, "cards")
    cells = v.table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("count"), F.max("value").alias("best"))
    text = lambda c: F.when(F.col("event_type") == "error", "").otherwise(F.col(c).cast("string"))
    # One entry per event type and user.
    listed = lambda c: F.map_from_entries(F.collect_list(F.struct("event_type", text(c))))
    cards = cells.groupBy("user_id").agg(listed("count").alias("c"), listed("best").alias("b"))
    files.write_json(cards.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("model name"),
        F.lit("events").alias("algorithm"), F.lit("days").alias("trained on"),
        F.create_map(F.lit("count"), F.col("c"), F.lit("best"), F.col("b")).alias("metrics")), path)
    return outputs.score_card(files.read_jsonl(spark, path, schemas.SCORE_CARD))


@entry("io_multi_coll", v.with_(v.ALL_TURNS_SQL, select="SELECT dataset, _id, title, text FROM turns"))
def io_multi_coll(spark, d):
    """Every turn, in a sub-collection for each role."""
    root = scratch_dir(spark, "parts")
    collections.write_parts(v.turns(spark, d).select("dataset", "_id", "title", "text"), root)
    return collections.read_parts(spark, root, "_id STRING, title STRING, text STRING")


@entry("io_layout", """
SELECT event_id, 'org_' || event_type AS model, 'sets_events' AS dataset,
  CASE WHEN event_type = 'signup' THEN 'dev' ELSE 'train' END AS split FROM events""")
def io_layout(spark, d):
    path = scratch_dir(spark, "layout")
    named = v.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("org/"), "event_type").alias("model"),
        F.lit("sets/events").alias("dataset"),
        F.when(F.col("event_type") == "signup", "dev").otherwise("train").alias("split"))
    outputs.layout_columns(named).write.partitionBy("dataset", "model", "split").parquet(path)
    return spark.read.schema("event_id BIGINT, dataset STRING, model STRING, split STRING").parquet(path)
