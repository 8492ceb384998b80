"""Inputs of the registered queries: whole driver tables as Spark frames, and the same as SQL.

Each ``*_SQL`` string is one or more common table expressions for ``with_(...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.crop import crop_text
from pairloom.functions.text import answer_extract
from pairloom.operators.encode import hashed_words
from pairloom.operators.pairs import Collection
from pairloom.operators.sampling import replicate_k
from pairloom.operators.search import topk_search
from pairloom.plans.evaluate import search_texts
from pairloom.session import materialize

SEED = 7
DIM = 64
TOP = 100
TURNS = 1 << 24  # room for the turns of one conversation in a position

# First lines that many documents share; they play the part of leaked few-shot answers.
EXCLUDE = [
    "The and attion to thanedble the, anea. Eriner thanea.",
    "And therhean is the is esndha reedes ha.",
    "In in oredble ea.",
]


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- documents -----------------------------------------------------------------------------


def corpus(spark, d) -> DataFrame:
    """Every document as a corpus row; ``pos`` is the document number."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text",
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.col("doc_id").alias("pos"))


CORPUS_SQL = """corpus AS (
  SELECT doc_id::VARCHAR AS _id, source AS title, text, lang, doc_id AS pos FROM documents)"""


def good_corpus(spark, d) -> DataFrame:
    """The corpus without the documents that reviewers rated low: pairs of those are unlinked."""
    low = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("pos"))
    return corpus(spark, d).join(low, "pos", "left_anti")


GOOD_CORPUS_SQL = """good_corpus AS (
  SELECT * FROM corpus WHERE pos NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


def generated(spark, d) -> DataFrame:
    """Two generated queries per document: its first line, then a random crop.

    They are written down, as generated pairs are before they are cleaned.
    """
    copies = replicate_k(corpus(spark, d).select("pos", "text"), 2, seed=SEED)
    line = answer_extract(F.col("text"), F.lit(""))
    crop = crop_text(F.col("text"), SEED, "q", F.col("pos"))
    query = F.when(F.col("copy") == 0, line).otherwise(crop).alias("query")
    return materialize(
        copies.select("pos", "copy", query, F.col("text").alias("document")), "generated")


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def answer_sql(x: str) -> str:
    """Text up to the first line break; without one the last character is lost."""
    return strip_sql(f"CASE WHEN contains({x}, chr(10)) THEN split_part({x}, chr(10), 1) "
                     f"ELSE substring({x}, 1, greatest(length({x}) - 1, 0)) END")


def unit_sql(h: str, i: int) -> str:
    return f"(('0x' || substring({h}, {8 * i + 1}, 8))::BIGINT / 4294967296::DOUBLE)"


def mark_sql(start: str, i: str) -> str:
    m0 = f"(({start} + {i} * 1640531527) % 2147483648)"
    m1 = f"(xor({m0}, {m0} >> 15) * 739982445 % 2147483648)"
    return f"(xor({m1}, {m1} >> 12) * 695872825 % 2147483648)"


BAR = int(0.1 * 2147483648)


def crop_ctes(source: str, name: str, side: str, key: str = "pos", text: str = "text") -> str:
    """CTEs ending in ``name``: all columns of ``source`` plus span, words and ``crop``."""
    return f"""{name}_h AS (
  SELECT *, string_split({text}, ' ') AS w, md5('{SEED}|crop|{side}|' || {key}) AS h FROM {source}),
{name}_s AS (
  SELECT *, floor(len(w) * (0.1::DOUBLE + 0.4::DOUBLE * {unit_sql('h', 0)}))::BIGINT AS n_crop,
         ('0x' || substring(h, 17, 8))::BIGINT AS h2 FROM {name}_h),
{name}_t AS (
  SELECT *, floor({unit_sql('h', 1)} * (len(w) - n_crop + 1))::BIGINT AS start FROM {name}_s),
{name} AS (
  SELECT * EXCLUDE (w), w[start + 1 : start + n_crop] AS span,
    lower(array_to_string(list_filter(w[start + 1 : start + n_crop],
      lambda v, i: {mark_sql('h2', '(i - 1)')} > {BAR}), ' ')) AS crop
  FROM {name}_t)"""


GENERATED_SQL = f"""copies AS (
  SELECT row_number() OVER (PARTITION BY c.copy ORDER BY md5('{SEED}|order|' || pos), pos) - 1
         + c.copy * (SELECT count(*) FROM corpus) AS pos, c.copy, text
  FROM corpus, (SELECT unnest([0, 1]) AS copy) c),
{crop_ctes('copies', 'cropped', 'q')},
generated AS (
  SELECT pos, copy, CASE WHEN copy = 0 THEN {answer_sql('text')} ELSE crop END AS query,
         text AS document FROM cropped)"""

EXCLUDE_SQL = ", ".join(f"'{x.lower()}'" for x in EXCLUDE)
STATUS_SQL = f"""link AS (
  SELECT text AS link_text, max_by(_id, pos) AS corpus_id, max_by(title, pos) AS corpus_title
  FROM good_corpus GROUP BY text),
marked AS (
  SELECT g.*, corpus_id, corpus_title, length(query) = 0 AS is_empty,
         {strip_sql('lower(query)')} IN ({EXCLUDE_SQL}) AS is_leaked
  FROM generated g LEFT JOIN link ON link_text = document),
firsts AS (
  SELECT *, min(CASE WHEN NOT is_empty AND NOT is_leaked AND corpus_id IS NOT NULL THEN pos END)
            OVER (PARTITION BY document) AS first_ok FROM marked),
status AS (
  SELECT pos, copy, query, document, corpus_id, corpus_title,
    CASE WHEN coalesce(pos > first_ok, false) THEN 'repeated' WHEN is_empty THEN 'empty'
         WHEN is_leaked THEN 'leaked' WHEN corpus_id IS NULL THEN 'unlinked' ELSE 'valid' END
      AS status FROM firsts)"""
POST_SQL = (CORPUS_SQL, GOOD_CORPUS_SQL, GENERATED_SQL, STATUS_SQL)


# -- embeddings ----------------------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    """Every vector; each is a query and a corpus row (a hit on itself is skipped)."""
    return table(spark, d, "embeddings").select(
        F.lit("all").alias("dataset"), F.col("vec_id").cast("string").alias("_id"),
        F.col("embedding").alias("vec"), "label", "vec_id")


def vector_qrels(spark, d) -> DataFrame:
    """Each vector judged against its 20 neighbours by number: 2 or 1 (near or far) for the same
    label, 0 for another."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    steps = [i for i in range(-10, 11) if i != 0]
    near = v.withColumn("step", F.explode(F.array(*[F.lit(i) for i in steps])))
    near = near.withColumn("other_id", F.col("vec_id") + F.col("step"))
    other = v.select(F.col("vec_id").alias("other_id"), F.col("label").alias("other_label"))
    grade = F.when(F.col("label") != F.col("other_label"), 0).when(
        F.abs("step") <= 5, 2).otherwise(1)
    return near.join(other, "other_id").select(
        F.lit("all").alias("dataset"), F.col("vec_id").cast("string").alias("query_id"),
        F.col("other_id").cast("string").alias("corpus_id"), grade.alias("score"),
        (F.col("vec_id") * 32 + F.col("step") + 10).alias("pos"))


def vector_run(spark, d, k: int = TOP) -> DataFrame:
    v = vectors(spark, d)
    return topk_search(v, v, k, dataset="dataset", skip_self=True, dim=DIM)


VECTORS_SQL = """vectors AS (
  SELECT vec_id, vec_id::VARCHAR AS _id, embedding::DOUBLE[] AS vec, label,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"""
VECTOR_RUN_SQL = VECTORS_SQL + f""",
fns AS (SELECT unnest(['cos_sim', 'dot_score']) AS score_fn),
pairs AS (
  SELECT q._id AS query_id, c._id AS corpus_id, list_dot_product(q.vec, c.vec) AS dot,
         q.norm * c.norm AS norms
  FROM vectors q, vectors c WHERE q._id <> c._id),
scored AS (
  SELECT 'all' AS dataset, score_fn, query_id, corpus_id,
         round(CASE score_fn WHEN 'cos_sim' THEN dot / norms ELSE dot END, 9) AS score
  FROM pairs, fns),
run AS (
  SELECT *, (row_number() OVER (PARTITION BY score_fn, query_id
             ORDER BY score DESC, corpus_id))::INTEGER AS rank
  FROM scored QUALIFY rank <= {TOP})"""
VECTOR_QRELS_SQL = """qrels AS (
  SELECT 'all' AS dataset, q.vec_id::VARCHAR AS query_id, c.vec_id::VARCHAR AS corpus_id,
    CASE WHEN q.label <> c.label THEN 0 WHEN abs(c.vec_id - q.vec_id) <= 5 THEN 2 ELSE 1 END AS score,
    q.vec_id * 32 + (c.vec_id - q.vec_id) + 10 AS pos
  FROM embeddings q JOIN embeddings c
    ON c.vec_id BETWEEN q.vec_id - 10 AND q.vec_id + 10 AND c.vec_id <> q.vec_id)"""


# -- conversations -------------------------------------------------------------------------


def _turns(spark, d, role: str, shift: int) -> DataFrame:
    t = table(spark, d, "conversations")
    t = t.filter(F.col("role") == role)
    return t.select(
        F.concat(F.lit("turn"), (F.col("turn") - shift).cast("string")).alias("dataset"),
        F.concat_ws("-", F.lit(role[0]), "conv_id", "turn").alias("_id"),
        F.lit("").alias("title"), "text", "conv_id", "turn",
        (F.col("conv_id") * TURNS + F.col("turn")).alias("pos"))


def questions(spark, d) -> DataFrame:
    """Every user turn as a query. The collection is the depth of the question."""
    return _turns(spark, d, "user", 0)


def replies(spark, d) -> DataFrame:
    """Every assistant turn as a passage of the collection of the question before it."""
    return _turns(spark, d, "assistant", 1)


def reply_qrels(spark, d) -> DataFrame:
    """A question's own reply has grade 2, the reply at the same depth of the next conversation
    1, of the previous one 0."""
    q = questions(spark, d).select("dataset", F.col("_id").alias("query_id"), "conv_id", "turn", "pos")
    judged = q.withColumn("j", F.explode(F.array(
        *[F.struct(F.lit(o).alias("o"), F.lit(g).alias("g")) for o, g in ((0, 2), (1, 1), (-1, 0))])))
    judged = judged.select(
        "dataset", "query_id", (F.col("conv_id") + F.col("j.o")).alias("conv_id"),
        (F.col("turn") + 1).alias("turn"), F.col("j.g").alias("score"),
        (F.col("pos") * 4 + F.col("j.o") + 1).alias("pos"))
    r = replies(spark, d).select(F.col("_id").alias("corpus_id"), "conv_id", "turn")
    return judged.join(r, ["conv_id", "turn"]).select(
        "dataset", "query_id", "corpus_id", "score", "pos")


def turns(spark, d) -> DataFrame:
    """Every turn of every conversation; the collection is the role that speaks."""
    t = table(spark, d, "conversations")
    return t.select(F.col("role").alias("dataset"), F.concat_ws("-", "conv_id", "turn").alias("_id"),
                    F.lit("").alias("title"), "text", (F.col("conv_id") * TURNS + F.col("turn")).alias("pos"))


ALL_TURNS_SQL = f"""turns AS (
  SELECT role AS dataset, conv_id || '-' || turn AS _id, '' AS title, text, conv_id * {TURNS} + turn AS pos
  FROM conversations)"""


def conversation_collection(spark, d) -> Collection:
    keep = ["_id", "title", "text", "pos"]
    return Collection(replies(spark, d).select(*keep), questions(spark, d).select("_id", "text", "pos"),
                      reply_qrels(spark, d).drop("dataset"))


def reply_run(spark, d, k: int = TOP, score_fns=None, written: bool = False) -> DataFrame:
    return search_texts(questions(spark, d), replies(spark, d),
                        hashed_words(DIM, normalize=False), k=k, score_fns=score_fns, dim=DIM, written=written)


TURNS_SQL = f"""questions AS (
  SELECT 'turn' || turn AS dataset, 'u-' || conv_id || '-' || turn AS _id, text, conv_id, turn,
         conv_id * {TURNS} + turn AS pos FROM conversations WHERE role = 'user'),
replies AS (
  SELECT 'turn' || (turn - 1) AS dataset, 'a-' || conv_id || '-' || turn AS _id, '' AS title, text,
         conv_id, turn, conv_id * {TURNS} + turn AS pos FROM conversations WHERE role = 'assistant'),
qrels AS (
  SELECT q.dataset, q._id AS query_id, r._id AS corpus_id, j.g AS score, q.pos * 4 + j.o + 1 AS pos
  FROM questions q, (VALUES (0, 2), (1, 1), (-1, 0)) j(o, g), replies r
  WHERE r.conv_id = q.conv_id + j.o AND r.turn = q.turn + 1)"""
WORDS_SQL = rf"""texts AS (
  SELECT _id, dataset, text FROM questions
  UNION ALL SELECT _id, dataset, {strip_sql("title || ' ' || text")} FROM replies),
words AS (
  SELECT _id, ('0x' || substring(md5(word), 1, 8))::BIGINT % {DIM} AS bucket, count(*) AS n
  FROM (SELECT _id, unnest(regexp_split_to_array(lower(text), '[ \t\r\n]+')) AS word FROM texts)
  WHERE word <> '' GROUP BY ALL),
encoded AS (
  SELECT t._id, list(coalesce(n, 0)::DOUBLE ORDER BY b.bucket) AS vec
  FROM texts t CROSS JOIN (SELECT unnest(range({DIM})) AS bucket) b
  LEFT JOIN words w ON w._id = t._id AND w.bucket = b.bucket GROUP BY t._id)"""
REPLY_RUN_SQL = TURNS_SQL + ",\n" + WORDS_SQL + f""",
fns AS (SELECT unnest(['cos_sim', 'dot_score']) AS score_fn),
pairs AS (
  SELECT q.dataset, q._id AS query_id, c._id AS corpus_id, list_dot_product(qe.vec, ce.vec) AS dot,
    sqrt(list_dot_product(qe.vec, qe.vec)) * sqrt(list_dot_product(ce.vec, ce.vec)) AS norms
  FROM questions q JOIN replies c ON q.dataset = c.dataset
  JOIN encoded qe ON qe._id = q._id JOIN encoded ce ON ce._id = c._id),
scored AS (
  SELECT dataset, score_fn, query_id, corpus_id, round(CASE score_fn WHEN 'dot_score' THEN dot
    WHEN 'cos_sim' THEN CASE WHEN norms = 0 THEN 0 ELSE dot / norms END END, 9) AS score
  FROM pairs, fns),
run AS (
  SELECT *, (row_number() OVER (PARTITION BY dataset, score_fn, query_id
             ORDER BY score DESC, corpus_id))::INTEGER AS rank
  FROM scored QUALIFY rank <= {TOP})"""


# -- events as run facts -------------------------------------------------------------------


def facts(spark, d) -> DataFrame:
    """Every event as the metadata of one generation shard: its user is the model, sign-ups are
    the dev split, an ``error`` event is a failed shard without a time."""
    e = table(spark, d, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("org/model-"), F.col("user_id").cast("string")).alias("model_name"),
        F.when(F.col("event_type") == "signup", "dev").otherwise("train").alias("split"),
        F.col("event_id").cast("int").alias("shard_id"),
        F.when(~failed, F.col("value")).alias("time_in_minutes"),
        failed.cast("int").alias("errors"))


FACTS_SQL = """facts AS (
  SELECT 'org/model-' || user_id AS model_name,
    CASE WHEN event_type = 'signup' THEN 'dev' ELSE 'train' END AS split,
    event_id::INTEGER AS shard_id,
    CASE WHEN event_type <> 'error' THEN value END AS time_in_minutes,
    (event_type = 'error')::INTEGER AS errors FROM events)"""
