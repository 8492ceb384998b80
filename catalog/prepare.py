"""Sampling, text functions, filters, joins and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import entry
from pairloom.functions import crop, text as txt
from pairloom.functions.draws import digest, slot
from pairloom.operators import pairs as prs, postprocess as post, report, sampling
from pairloom.session import scratch_dir
from pairloom.sources import files

C = v.CORPUS_SQL


def _h(salt: str, pos: str = "pos") -> str:
    return f"md5('{v.SEED}|{salt}|' || {pos})"


def _pick_sql(source: str, salt: str, n: str) -> str:
    return f"(SELECT * FROM {source} ORDER BY {_h(salt)}, pos LIMIT {n})"


# -- sampling and shards -------------------------------------------------------------------


@entry("sample_exact", v.with_(C, f"n AS (SELECT floor(count(*) * 0.3::DOUBLE)::BIGINT AS n FROM corpus)",
       f"r AS (SELECT *, row_number() OVER (ORDER BY {_h('sample')}, pos) AS rn FROM corpus)",
       select="SELECT _id, title FROM r, n WHERE rn <= n"))
def sample_exact(spark, d):
    return sampling.sample_exact(v.corpus(spark, d), ratio=0.3, seed=v.SEED).select("_id", "title")


@entry("dev_split", v.with_(C, f"n AS (SELECT floor(count(*) * 0.2::DOUBLE)::BIGINT AS n FROM corpus)",
       f"r AS (SELECT *, row_number() OVER (ORDER BY {_h('dev')}, pos) AS rn FROM corpus)",
       select="SELECT _id, title FROM r, n WHERE rn <= n"))
def dev_split(spark, d):
    return sampling.dev_split(v.corpus(spark, d), 0.2, v.SEED).select("_id", "title")


@entry("replicate_k", v.with_(C, f"""placed AS (
  SELECT _id, row_number() OVER (ORDER BY {_h('order')}, pos) - 1 AS place, count(*) OVER () AS n
  FROM corpus)""", select="""
SELECT copy * n + place AS pos, copy, _id FROM placed, (SELECT unnest([0, 1, 2]) AS copy)"""))
def replicate_k(spark, d):
    docs = v.corpus(spark, d).select("pos", "_id")
    return sampling.replicate_k(docs, 3, seed=v.SEED).select("pos", "copy", "_id")


def _shards_sql(size: int) -> str:
    return f"""shards AS (
  SELECT pos, least(floor((row_number() OVER (ORDER BY pos) - 1) / greatest(n // greatest(n // {size}, 1), 1)),
    greatest(n // {size}, 1) - 1)::INTEGER AS shard_id
  FROM corpus, (SELECT count(*) AS n FROM corpus))"""


def _shards(spark, d, size):
    return sampling.shard_assign(v.corpus(spark, d).select("pos"), size)


@entry("shard_assign", v.with_(C, _shards_sql(300), select="SELECT pos, shard_id FROM shards"))
def shard_assign(spark, d):
    return _shards(spark, d, 300)


DONE_SQL = "done AS (SELECT event_id::INTEGER AS shard_id FROM events WHERE event_type <> 'error')"


def _done(spark, d):
    """Shards whose event did not fail count as finished."""
    return v.facts(spark, d).filter("errors = 0").select("shard_id")


@entry("shard_missing", v.with_(C, _shards_sql(20), DONE_SQL, select="""
SELECT DISTINCT shard_id FROM shards WHERE shard_id NOT IN (SELECT shard_id FROM done)"""))
def shard_missing(spark, d):
    return sampling.shard_missing(_shards(spark, d, 20), _done(spark, d))


@entry("minus_done", v.with_(v.FACTS_SQL, select="""
SELECT shard_id FROM facts EXCEPT SELECT shard_id FROM facts WHERE errors = 0"""))
def minus_done(spark, d):
    return sampling.shard_missing(v.facts(spark, d), _done(spark, d))


@entry("shard_complete", v.with_(C, _shards_sql(20), DONE_SQL, select="""
SELECT shards, done, shards = done AS complete
FROM (SELECT count(DISTINCT shard_id) AS shards FROM shards),
     (SELECT count(DISTINCT shard_id) AS done FROM done)"""))
def shard_complete(spark, d):
    return sampling.shard_complete(_shards(spark, d, 20), _done(spark, d))


CAP_SQL = v.with_(v.VECTORS_SQL, v.VECTOR_QRELS_SQL, """marked AS (
  SELECT _id, vec_id, _id IN (SELECT corpus_id FROM qrels WHERE score >= 1) AS needed FROM vectors)""",
    f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY needed ORDER BY {_h('cap', 'vec_id')}, vec_id) AS rn,
  count(*) FILTER (WHERE NOT needed) OVER () // 2 AS fill FROM marked)""",
    select="SELECT _id, needed FROM ranked WHERE needed OR rn <= fill")


@entry("corpus_cap", CAP_SQL)
def corpus_cap(spark, d):
    """Cap: all relevant vectors and half of the others."""
    qrels = v.vector_qrels(spark, d)
    corpus = v.vectors(spark, d).select("_id", F.col("vec_id").alias("pos"))
    needed = prs.relevance_sets(qrels).select("corpus_id").distinct()
    n, total = needed.count(), corpus.count()
    kept = sampling.corpus_cap(corpus, qrels, n + (total - n) // 2, v.SEED)
    marks = needed.select(F.col("corpus_id").alias("_id"), F.lit(True).alias("needed"))
    return kept.join(marks, "_id", "left").select("_id", F.coalesce("needed", F.lit(False)).alias("needed"))


@entry("union_cap", CAP_SQL.replace("SELECT _id, needed FROM ranked", "SELECT needed, count(*) AS n FROM ranked")
       + " GROUP BY needed")
def union_cap(spark, d):
    return corpus_cap(spark, d).groupBy("needed").agg(F.count(F.lit(1)).alias("n"))


@entry("shuffle_batches", v.with_(C, select=f"""
SELECT _id, row_number() OVER (ORDER BY {_h('batch')}, pos) - 1 AS row_id,
  (row_number() OVER (ORDER BY {_h('batch')}, pos) - 1) // 64 AS batch_id FROM corpus"""))
def shuffle_batches(spark, d):
    docs = v.corpus(spark, d).select("pos", "_id")
    return sampling.shuffle_batches(docs, 64, v.SEED).select("_id", "row_id", "batch_id")


@entry("win_batch", v.with_(v.ALL_TURNS_SQL, select="""
SELECT _id, (row_number() OVER (ORDER BY pos) - 1) // 16 AS batch_id FROM turns"""))
def win_batch(spark, d):
    return sampling.batch_of_pos(v.turns(spark, d).select("_id", "pos"), 16).select("_id", "batch_id")


TRIPLET_SQL = f"""triplets AS (
  SELECT doc_id AS pos, {v.answer_sql('text')} AS query, text AS positive,
    CASE WHEN last THEN first_value(text) OVER w ELSE lead(text) OVER w END AS negative
  FROM (SELECT *, doc_id = max(doc_id) OVER () AS last FROM documents) WINDOW w AS (ORDER BY doc_id))"""


def _triplets(spark, d):
    """First line, text, and the text of the next document (of the last: the first) as the negative."""
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    rows = prs.with_next(docs, "text", "other", "doc_id").withColumn(
        "line", txt.answer_extract(F.col("text"), F.lit("")))
    return prs.load_triplets(rows, "line", "text", "other", pos="doc_id")


@entry("load_triplets", v.with_(TRIPLET_SQL, select="SELECT * FROM triplets"))
def load_triplets(spark, d):
    return _triplets(spark, d)


def _norm_sql(x: str) -> str:
    return v.strip_sql(f"lower({x})")


def _nodup(spark, d):
    return sampling.nodup_batches(_triplets(spark, d), BATCH, ["query", "positive", "negative"], seed=v.SEED)


# The batches are dealt round by round as the operator does it: in each round a row stays in its batch if it
# shares no text with an earlier one that stays; the last few rows go one by one to the first batch that fits.
BATCH = 32
NODUP_SQL = f"""{TRIPLET_SQL},
texts AS (
  SELECT pos, list_distinct(list_filter([{", ".join(f"md5_number({_norm_sql(c)})" for c in ("query", "positive", "negative"))}],
    lambda x: x IS NOT NULL)) AS texts FROM triplets),
rounds AS (
  SELECT 0::BIGINT AS round, 0::BIGINT AS base, pos, texts, NULL::BIGINT AS batch_id, false AS kept FROM texts
  UNION ALL (
  WITH rest AS (SELECT * FROM rounds WHERE NOT kept),
  size AS (
    SELECT greatest((n + {BATCH - 1}) // {BATCH}, coalesce(most, 0)) AS batches FROM (SELECT count(*) AS n FROM rest),
      (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM (SELECT unnest(texts) AS text FROM rest) GROUP BY text))
    WHERE n > {sampling.FEW_ROWS}),
  placed AS (
    SELECT *, base + place % batches AS batch FROM (
      SELECT *, row_number() OVER (ORDER BY md5(({v.SEED} + round) || '|deal|' || pos), pos) - 1 AS place FROM rest), size),
  stays AS (
    SELECT batch, list_reduce(list({{'texts': texts, 'places': [place]}} ORDER BY place), lambda a, b:
      CASE WHEN list_has_any(a.texts, b.texts) THEN a ELSE {{'texts': list_concat(a.texts, b.texts),
        'places': list_concat(a.places, b.places)}} END).places AS places FROM placed GROUP BY batch)
  SELECT round + 1, base + batches, pos, texts, batch, list_contains(places, place) FROM placed JOIN stays USING (batch))),
few AS (
  SELECT list(pos ORDER BY pos) AS pos, any_value(base) AS base,
    list_reduce(list({{'batches': [{{'texts': texts, 'n': 1}}], 'places': [0]}} ORDER BY pos), lambda a, b:
      CASE WHEN list_bool_or(list_transform(a.batches, lambda x: x.n < {BATCH} AND NOT list_has_any(x.texts, b.batches[1].texts)))
      THEN {{'batches': list_transform(a.batches, lambda x, i: CASE WHEN i = list_position(list_transform(a.batches,
          lambda y: y.n < {BATCH} AND NOT list_has_any(y.texts, b.batches[1].texts)), true)
          THEN {{'texts': list_concat(x.texts, b.batches[1].texts), 'n': x.n + 1}} ELSE x END),
        'places': list_append(a.places, (list_position(list_transform(a.batches,
          lambda y: y.n < {BATCH} AND NOT list_has_any(y.texts, b.batches[1].texts)), true) - 1)::INTEGER)}}
      ELSE {{'batches': list_concat(a.batches, b.batches), 'places': list_append(a.places, len(a.batches)::INTEGER)}} END).places AS places
  FROM rounds WHERE NOT kept AND round = (SELECT max(round) FROM rounds))"""


@entry("nodup_batches", v.with_(NODUP_SQL, select="""
SELECT pos, batch_id FROM rounds WHERE kept
UNION ALL SELECT unnest(pos), base + unnest(places) FROM few""").replace("WITH", "WITH RECURSIVE", 1))
def nodup_batches(spark, d):
    """Every triplet and its batch."""
    return _nodup(spark, d).select("pos", "batch_id")


@entry("nodup_repeats", v.with_(TRIPLET_SQL, select="""
SELECT count(*) AS n, 0::BIGINT AS repeats, 0::BIGINT AS too_large FROM triplets"""))
def nodup_repeats(spark, d):
    """Triplets, texts that two triplets of a batch share, and triplets beyond the size of a batch."""
    done = _nodup(spark, d)
    texts = F.array_distinct(F.array(*[txt.norm_query(F.col(c)) for c in ("query", "positive", "negative")]))
    again = done.select("batch_id", F.explode(texts).alias("text")).groupBy("batch_id", F.sha2("text", 256)).agg(
        (F.count(F.lit(1)) - 1).alias("again")).agg(F.sum("again").alias("repeats"))
    sizes = done.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("n"), F.sum(F.greatest(F.col("n") - 32, F.lit(0))).alias("too_large"))
    return sizes.join(again)  # one row each


# -- text functions ------------------------------------------------------------------------


def _text(column):
    return lambda spark, d: v.corpus(spark, d).select("_id", column(F.col("text")).alias("out"))


entry("doc_truncate", v.with_(C, select="SELECT _id, substring(text, 1, 2000) AS out FROM corpus"))(
    _text(txt.doc_truncate))
entry("ascii_strip", v.with_(C, select=r"""
SELECT _id, regexp_replace(substring(text, 1, 2000), '[^\x00-\x7F]', '', 'g') AS out FROM corpus"""))(
    _text(lambda t: txt.ascii_strip(txt.doc_truncate(t))))


@entry("norm_query", f"""
SELECT conv_id, turn, {v.strip_sql('lower(text)')} AS norm, {v.strip_sql('text')} AS out
FROM conversations""")
def norm_query(spark, d):
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", txt.norm_query(F.col("text")).alias("norm"), txt.strip(F.col("text")).alias("out"))


@entry("first_word", f"""
SELECT conv_id, turn, upper(w[1:1]) || w[2:] AS word
FROM (SELECT *, split_part({_norm_sql('text')}, ' ', 1) AS w FROM conversations)""")
def first_word(spark, d):
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", txt.first_word(F.col("text")).alias("word"))


@entry("passage_text", v.with_(C, select=f"""
SELECT _id, title || ' [SEP] ' || text AS pair_text, {v.strip_sql("title || ' ' || text")} AS encoder_text
FROM corpus"""))
def passage_text(spark, d):
    title, text = F.col("title"), F.col("text")
    return v.corpus(spark, d).select(
        "_id", txt.passage_text(title, text, txt.DUAL_SEPARATOR).alias("pair_text"),
        txt.passage_for_encoder(title, text).alias("encoder_text"))


@entry("dual_tag", v.with_(v.ALL_TURNS_SQL, select="""
SELECT _id, CASE WHEN dataset = 'user' THEN 'query' ELSE 'doc' END AS side, text FROM turns"""))
def dual_tag(spark, d):
    """User turns are queries, all others documents."""
    def tagged(df, side):
        tag = df.select("_id", txt.dual_tag(F.col("text"), side).alias("tag"))
        return tag.select("_id", F.lit(tag.schema["tag"].dataType[0].name).alias("side"),
                          F.col("tag")[side].alias("text"))

    asked, turns = F.col("dataset") == "user", v.turns(spark, d)
    return tagged(turns.filter(asked), "query").unionByName(tagged(turns.filter(~asked), "doc"))


@entry("prompt_build", v.with_(C, select="""
SELECT _id, 'Document: ' || text || chr(10) || 'Title: ' || title || chr(10) || 'Query:' AS prompt
FROM corpus"""))
def prompt_build(spark, d):
    built = txt.prompt_build("Document: {}\nTitle: {}\n", [F.col("text"), F.col("title"), F.col("_id")], "Query:")
    return v.corpus(spark, d).select("_id", built.alias("prompt"))


@entry("answer_extract", f"""
SELECT conv_id, turn, {v.answer_sql('text')} AS answer, {v.strip_sql("split_part(text, chr(10), 1)")} AS whole
FROM conversations""")
def answer_extract(spark, d):
    """Every turn as the completion of a prompt that names its role."""
    prompt = F.concat("role", F.lit(": "))
    said = F.concat(prompt, "text")
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", txt.answer_extract(said, prompt).alias("answer"),
        txt.answer_extract(said, prompt, compat_drop_last=False).alias("whole"))


@entry("crop_span", v.with_(C, v.crop_ctes("corpus", "cropped", "q"), select="""
SELECT _id, start::INTEGER AS start, n_crop::INTEGER AS length FROM cropped"""))
def crop_span(spark, d):
    drawn = digest(v.SEED, "crop", "q", F.col("pos"))
    start, length = crop.crop_span(F.size(crop.words_of(F.col("text"))), drawn)
    return v.corpus(spark, d).select("_id", start.alias("start"), length.alias("length"))


@entry("delete_words", v.with_(C, f"""marked AS (
  SELECT _id, string_split(text, ' ') AS w, ('0x' || substring({_h('words')}, 1, 8))::BIGINT AS h FROM corpus)""",
    select=f"""SELECT _id, array_to_string(list_filter(w,
  lambda x, i: {v.mark_sql('h', '(i - 1)')} > {v.BAR}), ' ') AS out FROM marked"""))
def delete_words(spark, d):
    mark = slot(digest(v.SEED, "words", F.col("pos")), 0)
    return v.corpus(spark, d).select(
        "_id", crop.delete_words(crop.words_of(F.col("text")), mark).alias("out"))


@entry("crop_text", v.with_(C, v.crop_ctes("corpus", "cropped", "q"), select="SELECT _id, crop AS out FROM cropped"))
def crop_text(spark, d):
    return v.corpus(spark, d).select(
        "_id", crop.crop_text(F.col("text"), v.SEED, "q", F.col("pos")).alias("out"))


PAIR_SQL = (C, v.crop_ctes("corpus", "left_crop", "q"), v.crop_ctes("corpus", "right_crop", "d"))
PAIR_ROWS = """SELECT l.{key}, l.crop AS query, r.crop AS document, l.text AS original_document
FROM left_crop l JOIN right_crop r USING (pos)"""


@entry("crop_pair", v.with_(*PAIR_SQL, select=PAIR_ROWS.format(key="pos")))
def crop_pair(spark, d):
    return crop.crop_pair(v.corpus(spark, d).select("pos", "text"), v.SEED)


# -- cleaning of generated pairs -----------------------------------------------------------

STATUS_COLUMNS = ["pos", "query", "status", "corpus_id", "corpus_title"]


def _status(spark, d):
    return post.post_status(v.generated(spark, d), v.good_corpus(spark, d), "document", v.EXCLUDE)


def _valid(spark, d):
    return post.valid_pairs(v.generated(spark, d), v.good_corpus(spark, d), "document", v.EXCLUDE)


def _numbered(spark, d, offset=0):
    return post.numbered_pairs(v.generated(spark, d), v.good_corpus(spark, d), "document", v.EXCLUDE, offset)


@entry("post_status", v.with_(*v.POST_SQL, select=f"SELECT {', '.join(STATUS_COLUMNS)} FROM status"))
def post_status(spark, d):
    return _status(spark, d).select(*STATUS_COLUMNS)


@entry("flt_seen", v.with_(*v.POST_SQL, select="SELECT pos FROM status WHERE status = 'repeated'"))
def flt_seen(spark, d):
    return _status(spark, d).filter("status = 'repeated'").select("pos")


@entry("flt_empty", v.with_(C, v.GENERATED_SQL, select="SELECT pos FROM generated WHERE length(query) = 0"))
def flt_empty(spark, d):
    return v.generated(spark, d).filter(F.length("query") == 0).select("pos")


@entry("flt_leaked", v.with_(C, v.GENERATED_SQL, select=f"""
SELECT pos, query FROM generated WHERE {_norm_sql('query')} IN ({v.EXCLUDE_SQL})"""))
def flt_leaked(spark, d):
    excluded = [x.lower() for x in v.EXCLUDE]
    return v.generated(spark, d).filter(txt.norm_query(F.col("query")).isin(excluded)).select("pos", "query")


@entry("flt_unlinked", v.with_(C, v.GOOD_CORPUS_SQL, v.GENERATED_SQL, select="""
SELECT pos FROM generated WHERE document NOT IN (SELECT text FROM good_corpus)"""))
def flt_unlinked(spark, d):
    linked = post.join_link(v.generated(spark, d), v.good_corpus(spark, d), "document")
    return linked.filter("corpus_id IS NULL").select("pos")


@entry("join_link", v.with_(*v.POST_SQL, select="SELECT pos, corpus_id, corpus_title FROM marked"))
def join_link(spark, d):
    linked = post.join_link(v.generated(spark, d), v.good_corpus(spark, d), "document")
    return linked.select("pos", "corpus_id", "corpus_title")


@entry("win_first_valid", v.with_(*v.POST_SQL, select="""
SELECT DISTINCT first_ok AS pos, corpus_id FROM firsts WHERE first_ok IS NOT NULL"""))
def win_first_valid(spark, d):
    return _valid(spark, d).select("pos", "corpus_id")


IDS_SQL = """numbered AS (
  SELECT *, (row_number() OVER (ORDER BY pos) - 1)::VARCHAR AS query_id FROM status WHERE status = 'valid')"""


@entry("win_query_id", v.with_(*v.POST_SQL, IDS_SQL, select=f"""
SELECT query_id, corpus_id, {v.strip_sql('query')} AS text FROM numbered"""))
def win_query_id(spark, d):
    numbered = _numbered(spark, d)
    return numbered.select("query_id", "corpus_id", txt.strip(F.col("query")).alias("text"))


@entry("append_queries", v.with_(*v.POST_SQL, """benchmark_queries AS (
  SELECT (row_number() OVER (ORDER BY item_id) - 1)::VARCHAR AS _id, text FROM benchmark)""", select=f"""
SELECT _id, text FROM benchmark_queries
UNION ALL SELECT ((SELECT count(*) FROM benchmark) + row_number() OVER (ORDER BY pos) - 1)::VARCHAR,
  {v.strip_sql('query')} FROM status WHERE status = 'valid'"""))
def append_queries(spark, d):
    """New queries continue the numbers of the existing ones (here the benchmark items)."""
    items = v.table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), "text")
    old = post.query_ids(items).select(F.col("query_id").alias("_id"), "text")
    new = post.export_queries(_numbered(spark, d, offset=items.count()))
    return old.unionByName(new)


@entry("dpr_record", v.with_(*v.POST_SQL, select=f"""
SELECT pos, 'documents_unsupervised_LLM_org_model' AS dataset, {v.strip_sql('query')} AS question,
  '' AS answers, corpus_title AS title, document AS text, 0 AS score, 0 AS title_score,
  corpus_id AS passage_id, 0 AS negatives
FROM status WHERE status = 'valid'"""))
def dpr_record(spark, d):
    return _flat_record(post.export_pairs(_valid(spark, d), "documents", "LLM", "org/model"), "pos")


def _flat_record(records, key):
    passage = F.col("positive_ctxs")[0]
    return records.select(
        key, "dataset", "question", "answers",
        *[passage[f].alias(f) for f in ("title", "text", "score", "title_score", "passage_id")],
        (F.size("negative_ctxs") + F.size("hard_negative_ctxs")).alias("negatives"))


@entry("agg_loss", v.with_(*v.POST_SQL, select="""
SELECT copy, count(*) AS without_post, count(*) FILTER (WHERE status = 'valid') AS with_post,
  count(*) FILTER (WHERE status <> 'valid') AS lost_all,
  count(*) FILTER (WHERE status = 'repeated') AS lost_repeated,
  count(*) FILTER (WHERE status = 'empty') AS lost_empty,
  count(*) FILTER (WHERE status = 'unlinked') AS lost_not_found,
  count(*) FILTER (WHERE status = 'leaked') AS lost_same_prompt_answer, any_value(n) AS corpus_length,
  round(100 - count(*) FILTER (WHERE status = 'valid') / any_value(n)::DOUBLE * 100, 6) AS lost_pct
FROM status, (SELECT count(DISTINCT text) AS n FROM good_corpus) GROUP BY copy"""))
def agg_loss(spark, d):
    lost = post.agg_loss(_status(spark, d), v.good_corpus(spark, d), ["copy"])
    return lost.withColumn("lost_pct", F.round("lost_pct", 6))


WORDS = f"""words AS (
  SELECT upper(w[1:1]) || w[2:] AS word, pos FROM (
    SELECT pos, split_part({_norm_sql('query')}, ' ', 1) AS w FROM status WHERE status = 'valid'))"""


@entry("agg_top_words", v.with_(*v.POST_SQL, WORDS, select="""
SELECT word, count(*) AS n, min(pos) AS first_pos,
  round(count(*) / (SELECT count(*) FROM words)::DOUBLE * 100, 6) AS pct FROM words GROUP BY word"""))
def agg_top_words(spark, d):
    counts = report.word_counts(_valid(spark, d), "query")
    return counts.withColumn("pct", F.round("pct", 6))


@entry("topn_words", v.with_(*v.POST_SQL, WORDS, select="""
SELECT word, count(*) AS n, round(count(*) / (SELECT count(*) FROM words)::DOUBLE * 100, 6) AS pct
FROM words GROUP BY word ORDER BY count(*) DESC, min(pos) LIMIT 10"""))
def topn_words(spark, d):
    return report.top_words(_valid(spark, d), "query").withColumn("pct", F.round("pct", 6))


# -- supervised pairs ----------------------------------------------------------------------


@entry("join_sup", v.with_(v.TURNS_SQL, select="""
SELECT j.query_id, 'talk_supervised' AS dataset, q.text AS question, '' AS answers, r.title, r.text,
  j.score, 0 AS title_score, j.corpus_id AS passage_id, 0 AS negatives
FROM qrels j JOIN questions q ON q._id = j.query_id JOIN replies r ON r._id = j.corpus_id"""))
def join_sup(spark, d):
    return _flat_record(prs.join_sup(v.conversation_collection(spark, d), "talk"), "query_id")


@entry("agg_sup_info", v.with_(v.TURNS_SQL, select="""
SELECT count(*) AS original_length, count(DISTINCT query_id) AS number_of_queries FROM qrels"""))
def agg_sup_info(spark, d):
    return prs.sup_info(v.reply_qrels(spark, d))


@entry("join_pairs", v.with_(v.TURNS_SQL, """placed AS (
  SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 16 AS guid FROM questions)""", select="""
SELECT q.guid::INTEGER AS guid, j.query_id, j.corpus_id, q.text AS query, r.title || ' ' || r.text AS doc, 1 AS label
FROM qrels j JOIN placed q ON q._id = j.query_id JOIN replies r ON r._id = j.corpus_id WHERE j.score >= 1"""))
def join_pairs(spark, d):
    return prs.join_pairs(v.conversation_collection(spark, d), 16).drop("pos")


@entry("union_shards", v.with_(C, v.GENERATED_SQL, select="SELECT pos, query FROM generated"))
def union_shards(spark, d):
    """Generated pairs written per copy, read back as one frame."""
    path = scratch_dir(spark, "parts")
    for copy in (0, 1):
        part = v.generated(spark, d).filter(F.col("copy") == copy).select("pos", "query")
        files.write_json(part, f"{path}/part={copy}")
    return files.read_jsonl(spark, path, "pos BIGINT, query STRING").select("pos", "query")
