"""Cleaning of generated pairs: link to the corpus, ordered filters, exports, loss counts.

Documents are compared by the SHA-256 of their whole text, so joins and aggregates move 64
characters per row instead of the text. The ordered filter chain keeps at most one pair per
document: a row is ``repeated`` once an earlier row of its document was valid. That running
state is the smallest position of an acceptable row per document, a map-side combined aggregate;
linking is a property of the document, so it joins the aggregate, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import norm_query, strip
from pairloom.operators.joins import HOT_ROWS, join_unique
from pairloom.operators.numbering import number_rows
from pairloom.session import materialize

# The answers of the few-shot examples, which count as leaked when generated.
FEW_SHOT_ANSWERS = [
    "Is a little caffeine ok during pregnancy?",
    "What fruit is native to Australia?",
    "How large is the Canadian military?",
]
STATUSES = ["valid", "repeated", "empty", "leaked", "unlinked"]


def text_key(column: str):
    return F.sha2(F.col(column), 256)


def corpus_by_text(corpus: DataFrame) -> DataFrame:
    """One (id, title) per distinct text; the last row in ``pos`` order wins."""
    keyed = corpus.select(text_key("text").alias("_key"), "_id", "title", "pos")
    last = F.max_by(F.struct("_id", "title"), F.col("pos"))
    return keyed.groupBy("_key").agg(last.alias("_doc")).select(
        "_key", F.col("_doc._id").alias("corpus_id"), F.col("_doc.title").alias("corpus_title"))


def join_link(pairs: DataFrame, corpus: DataFrame, document: str = "original_document",
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs with the corpus id and title of their document (NULL if it is not in the corpus).

    Positions and digests are written down and joined; texts move once, by the unique ``pos``.
    """
    keyed = materialize(pairs.select("pos", text_key(document).alias("_key")), "digests")
    found = join_unique(keyed, corpus_by_text(corpus), ["_key"], "pos", hot_rows=hot_rows)
    return pairs.join(found.drop("_key"), "pos")


def _judged(pairs: DataFrame, document: str, exclude: list[str] | None) -> DataFrame:
    """Position, digest and row-local predicates of the filter chain, written down."""
    leaked = F.lit(False)
    if exclude:
        excluded = sorted({answer.lower().strip() for answer in exclude})
        leaked = F.coalesce(norm_query(F.col("query")).isin(excluded), F.lit(False))
    return materialize(pairs.select(
        "pos", text_key(document).alias("_key"), F.coalesce(F.length("query") == 0, F.lit(True)).alias("_empty"),
        leaked.alias("_leaked")), "judged")


def _documents(judged: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per document text: the link and the position of its first acceptable row."""
    accepted = F.when(~F.col("_empty") & ~F.col("_leaked"), F.col("pos"))
    firsts = judged.groupBy("_key").agg(F.min(accepted).alias("_first"))
    return firsts.join(corpus_by_text(corpus), "_key", "left")


def post_status(pairs: DataFrame, corpus: DataFrame, document: str = "original_document",
                exclude: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every pair with its ``status`` and the linked ``corpus_id`` and ``corpus_title``.

    Order of the filters: repeated, empty, leaked, unlinked, valid.
    """
    judged = _judged(pairs, document, exclude)
    linked = join_unique(judged, _documents(judged, corpus), ["_key"], "pos", hot_rows=hot_rows)
    found = F.col("corpus_id").isNotNull()
    status = (
        F.when(found & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False)), "repeated")
        .when(F.col("_empty"), "empty")
        .when(F.col("_leaked"), "leaked")
        .when(~found, "unlinked")
        .otherwise("valid")
    )
    return pairs.join(linked.select("pos", "corpus_id", "corpus_title", status.alias("status")), "pos")


def _valid_keys(pairs: DataFrame, corpus: DataFrame, document: str, exclude: list[str] | None) -> DataFrame:
    """Position and link of the valid pairs, written down."""
    kept = _documents(_judged(pairs, document, exclude), corpus).filter(
        F.col("_first").isNotNull() & F.col("corpus_id").isNotNull())
    return materialize(kept.select(F.col("_first").alias("pos"), "corpus_id", "corpus_title"), "valid")


def valid_pairs(pairs: DataFrame, corpus: DataFrame, document: str = "original_document",
                exclude: list[str] | None = None) -> DataFrame:
    """Only the valid pairs. They join back on the unique ``pos``, so no hot text is shuffled."""
    return pairs.join(_valid_keys(pairs, corpus, document, exclude), "pos")


def query_ids(valid: DataFrame, offset: int = 0) -> DataFrame:
    """Rows numbered in ``pos`` order from ``offset`` (the queries exported before)."""
    numbered = number_rows(valid, "pos", name="_n")
    return numbered.withColumn("query_id", (F.col("_n") + offset).cast("string")).drop("_n")


def numbered_pairs(pairs: DataFrame, corpus: DataFrame, document: str = "original_document",
                   exclude: list[str] | None = None, offset: int = 0) -> DataFrame:
    """The valid pairs with their query ids: positions and links are numbered, texts join once."""
    return pairs.join(query_ids(_valid_keys(pairs, corpus, document, exclude), offset), "pos")


def export_queries(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("query_id").alias("_id"), strip(F.col("query")).alias("text"))


def export_qrels(numbered: DataFrame) -> DataFrame:
    return numbered.select("query_id", "corpus_id", F.lit(1).alias("score"))


def pair_record(dataset: str, question, title, text, score, passage_id):
    """Columns of the nested pair record with one positive passage and no negatives."""
    passage = F.struct(
        title.alias("title"), text.alias("text"), score.cast("int").alias("score"),
        F.lit(0).alias("title_score"), passage_id.cast("string").alias("passage_id"))
    none = F.array().cast(
        "array<struct<title:string,text:string,score:int,title_score:int,passage_id:string>>")
    return [
        F.lit(dataset).alias("dataset"), question.alias("question"), F.lit("").alias("answers"),
        F.array(passage).alias("positive_ctxs"), none.alias("negative_ctxs"),
        none.alias("hard_negative_ctxs"),
    ]


def export_pairs(valid: DataFrame, dataset: str, method: str, model: str = "") -> DataFrame:
    """Nested records of the valid pairs; the passage is the pair's own ``document``."""
    name = f"{dataset}_unsupervised_{method}" + (f"_{model}".replace("/", "_") if model else "")
    return valid.select("pos", *pair_record(
        name, strip(F.col("query")), F.col("corpus_title"), F.col("document"), F.lit(0),
        F.col("corpus_id")))


def agg_loss(status: DataFrame, corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per drop reason, per group of ``by`` or over all rows.

    ``lost_pct = 100 - valid / corpus_length * 100`` with the number of distinct texts, NULL for
    an empty corpus.
    """
    count = lambda name: F.count_if(F.col("status") == name)
    out = status.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("without_post"),
        count("valid").alias("with_post"),
        (F.count(F.lit(1)) - count("valid")).alias("lost_all"),
        count("repeated").alias("lost_repeated"),
        count("empty").alias("lost_empty"),
        count("unlinked").alias("lost_not_found"),
        count("leaked").alias("lost_same_prompt_answer"),
    )
    # One number; distinct keys are combined before the shuffle.
    length = corpus.select(text_key("text").alias("_key")).distinct().count()
    share = F.try_divide(F.col("with_post"), F.lit(length).cast("double"))
    return out.withColumn("corpus_length", F.lit(length).cast("long")).withColumn(
        "lost_pct", F.lit(100.0) - share * 100)
