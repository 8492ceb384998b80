"""Text generation through model hooks, and incremental generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.prepare import PAIR_ROWS, PAIR_SQL
from catalog.registry import entry
from pairloom.operators import generate as gen, postprocess as post
from pairloom.plans import build
from pairloom.session import scratch_dir
from pairloom.sources.prompts import builtin_prompts
from pairloom.streaming.resume import corpus_stream, crop_stream

# The words a stand-in model sees behind the last "Document: ": those of the document, then the
# prompt's own. Its answer is the longest, the first of several.
SEEN_SQL = r"""seen AS (
  SELECT _id, list_filter(regexp_split_to_array(
    regexp_replace(substring(text, 1, 2000), '[^\x00-\x7F]', '', 'g'), '\s+'), lambda w: w <> '') AS words
  FROM corpus)"""


def longest_sql(words: str) -> str:
    return (f"list_reduce({words}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)")


ONE_STEP = v.with_(v.CORPUS_SQL, SEEN_SQL, select=f"""
SELECT _id, {longest_sql("words || ['Relevant', 'Query:']")} AS query, 0 AS errors FROM seen""")


def _documents(spark, d):
    return gen.prepare_documents(v.corpus(spark, d).select("_id", "pos", "text"))


@entry("udf_generate", ONE_STEP)
def udf_generate(spark, d):
    made = gen.prompt_steps(_documents(spark, d), builtin_prompts()["standard"], gen.LongestWord)
    return made.select("_id", "query", "errors")


class Busy(gen.LongestWord):
    """A stand-in model that has no room for more than 40 prompts at once."""

    def __call__(self, prompts):
        if len(prompts) > 40:
            raise MemoryError("batch too large")
        return super().__call__(prompts)


@entry("udf_retry", ONE_STEP)
def udf_retry(spark, d):
    made = gen.prompt_steps(_documents(spark, d), builtin_prompts()["standard"], Busy)
    return made.select("_id", "query", "errors")


@entry("prompt_steps", v.with_(v.CORPUS_SQL, SEEN_SQL, f"""first AS (
  SELECT *, {longest_sql("words || ['Keywords:']")} AS keywords FROM seen)""", select=f"""
SELECT _id, keywords, {longest_sql("words || ['Keywords:', keywords, 'Relevant', 'Query:']")} AS query
FROM first"""))
def prompt_steps(spark, d):
    made = gen.prompt_steps(_documents(spark, d), builtin_prompts()["keywords"], gen.LongestWord)
    return made.select("_id", F.col("out_0").alias("keywords"), "query")


@entry("flow_export", v.with_(v.CORPUS_SQL, SEEN_SQL.replace("SELECT _id,", "SELECT _id, pos, text,"), f"""made AS (
  SELECT {longest_sql("words || ['Relevant', 'Query:']")} AS query, text,
    row_number() OVER (ORDER BY md5('{v.SEED}|order|' || pos), pos) - 1 AS place FROM seen),
firsts AS (SELECT *, min(place) OVER (PARTITION BY text) AS first FROM made)""", select="""
SELECT (row_number() OVER (ORDER BY place) - 1)::VARCHAR AS _id, query AS text FROM firsts WHERE place = first"""))
def flow_export(spark, d):
    """All documents are sharded and generated for, and the finished shards exported as queries."""
    root = scratch_dir(spark, "generation")
    corpus = v.corpus(spark, d)
    build.generate_missing(spark, corpus, root, "documents", "org/longest", builtin_prompts()["standard"],
                           gen.LongestWord, shard_size=max(90, corpus.count() // 8), seed=v.SEED)
    build.export_finished(spark, corpus, root, "documents", "org/longest", ["train"], f"{root}/export")
    return build.exported_queries(spark, f"{root}/export")


@entry("stream_resume", v.with_(*PAIR_SQL, select=PAIR_ROWS.format(key="pos AS doc_id")))
def stream_resume(spark, d):
    """The documents arrive as a stream of files; a second call finds nothing new."""
    return _streamed(spark, d).drop("batch_id", "pos")


def _streamed(spark, d):
    out, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    for _ in range(2):
        stream = corpus_stream(spark, f"{d}/documents*.parquet", schema, "parquet")
        crop_stream(stream.select("doc_id", "text"), out, checkpoint, v.SEED, key="doc_id")
    return spark.read.parquet(out)


@entry("flow_stream", v.with_(v.CORPUS_SQL, select="""
SELECT count(*) AS pairs, count(*) AS numbers, 0::BIGINT AS first, count(*) - 1 AS last,
  count(*) AS judged, count(*) FILTER (WHERE text IS NULL) AS unlinked FROM corpus"""))
def flow_stream(spark, d):
    """Streamed pairs have numbers of their own over all batches and pass the cleaning."""
    status = post.post_status(_streamed(spark, d), v.corpus(spark, d))
    return status.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("pos").alias("numbers"), F.min("pos").alias("first"),
        F.max("pos").alias("last"), F.count("status").alias("judged"),
        F.count_if(F.col("status") == "unlinked").alias("unlinked"))
