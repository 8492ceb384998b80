"""Physical plans: no products, no shuffle where none is needed, pruned scans."""

import re

import pytest

from __spark_entry__ import queries
from catalog import views as v
from pairloom.operators import sampling
from pairloom.plans import build
from pairloom.session import materialize

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "post_status", "win_query_id", "join_pairs", "join_sup", "met_ndcg", "met_trec", "met_hole",
    "replicate_k", "nodup_batches", "corpus_cap", "io_qrels_read", "topk_search"])
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["sample_exact", "dev_split", "doc_truncate", "crop_span", "flt_leaked"])
def test_no_shuffle(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", text)


def read_columns(text):
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",") if c}


@pytest.mark.parametrize("name, columns", [
    ("shard_assign", {"doc_id"}),
    ("sort_ids", {"event_id", "event_type"}),
    ("agg_gen_time", {"user_id", "event_type", "value"}),
    ("shuffle_batches", {"doc_id"}),
])
def test_scans_are_pruned(spark, name, columns):
    assert read_columns(plan(spark, name)) == columns


def test_filters_reach_the_scan(spark):
    text = plan(spark, "flt_judged_q")
    for role in ("user", "assistant"):
        assert re.search(rf"PushedFilters: [^:]*EqualTo\(role,{role}\)", text)


def test_chained_joins_share_their_left_side(spark):
    """Numbering, two joins and their aggregates, without one exchange for hot keys that are not there."""
    assert plan(spark, "join_pairs").count("Exchange hashpartitioning") < 14
    assert plan(spark, "join_link").count("Exchange hashpartitioning") < 8


def test_crop_flow_does_not_shuffle_texts(spark):
    corpus = v.corpus(spark, SF)
    text = build.crop_splits(corpus, 1, 0.5, 0.2, 3)["train"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_sample_and_cap_read_their_input_twice(spark, monkeypatch):
    """Once for the keys, which are written down, and once for the rows."""
    written = []
    monkeypatch.setattr(sampling, "materialize", lambda df, name: written.append(df) or materialize(df, name))
    corpus, qrels = v.corpus(spark, SF), v.vector_qrels(spark, SF)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id")
    for run in (lambda: sampling.sample_exact(corpus, ratio=0.3), lambda: sampling.corpus_cap(corpus, qrels, 185)):
        out = run()
        assert len(written) == 1 and scans(written.pop()) == 1 and scans(out) == 1
