import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from catalog.prepare import BATCH, _triplets
from catalog.views import SEED
from check import compare, connect
from pairloom.functions.draws import word_marks
from pairloom.operators import sampling
from pairloom.operators.joins import join_unique
from pairloom.operators.numbering import _offsets, number_by_hash, number_rows
from pairloom.operators.pairs import with_next

SF = "/root/testdata/sf0.001"


def positions(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"))


@pytest.mark.parametrize("n, ratio", [(1000, 0.3), (1000, 1.0), (10, 0.05), (1, 1.0), (0, 0.5), (7, 0.5)])
def test_sample_is_exact(spark, n, ratio):
    rows = sampling.sample_exact(positions(spark, n), ratio=ratio, seed=1).collect()
    assert len(rows) == len(set(rows)) == int(n * ratio)


def test_sample_depends_on_seed_not_on_layout(spark):
    base = positions(spark, 500)
    pick = lambda df, seed: {r["pos"] for r in sampling.sample_exact(df, n=50, seed=seed).collect()}
    assert pick(base, 1) == pick(base.repartition(7), 1) != pick(base, 2)


def test_sample_larger_than_table(spark):
    assert sampling.sample_exact(positions(spark, 5), n=9, seed=1).count() == 5


def test_number_rows_with_gaps_and_hot_key(spark):
    rnd = random.Random(1)
    rows = [(p, "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]))
            for p in rnd.sample(range(10**9), 600)]
    df = spark.createDataFrame(rows, "pos BIGINT, key STRING").repartition(5)
    plain = {r["pos"]: r["row_id"] for r in number_rows(df, bits=20).collect()}
    assert plain == {p: i for i, (p, _) in enumerate(sorted(rows, key=lambda r: r[0]))}
    seen, expected = Counter(), {}
    for p, key in sorted(rows, key=lambda r: r[0]):
        expected[p] = seen[key]
        seen[key] += 1
    keyed = number_rows(df, keys=["key"], bits=20, total="n").collect()
    assert {r["pos"]: r["row_id"] for r in keyed} == expected
    assert all(r["n"] == seen[r["key"]] for r in keyed)


def test_number_by_hash_is_a_permutation(spark):
    got = number_by_hash(positions(spark, 300), 3, "x").collect()
    order = [r["pos"] for r in sorted(got, key=lambda r: r["row_id"])]
    assert sorted(r["row_id"] for r in got) == list(range(300)) and order != sorted(order)


@pytest.mark.parametrize("n, size", [(10, 3), (10, 100), (9, 3), (1, 1), (119, 7), (5, 5), (0, 3)])
def test_shards_equal_slices(spark, n, size):
    shards = max(n // size, 1)
    length = n // shards
    expected = {}
    for i in range(shards):
        end = n if i == shards - 1 else (i + 1) * length
        expected.update({p: i for p in range(i * length, end)})
    got = sampling.shard_assign(positions(spark, n), size).collect()
    assert {r["pos"]: r["shard_id"] for r in got} == expected


def test_replicate_numbers_copy_after_copy(spark):
    got = sampling.replicate_k(positions(spark, 4).withColumn("v", F.col("pos") * 10), 3).collect()
    assert sorted((r["pos"], r["v"]) for r in got) == [(c * 4 + i, i * 10) for c in range(3) for i in range(4)]


def test_missing_and_complete(spark):
    shards = spark.createDataFrame([(i,) for i in (0, 0, 1, 2)], "shard_id INT")
    done = spark.createDataFrame([(1,)], "shard_id INT")
    assert sorted(r[0] for r in sampling.shard_missing(shards, done).collect()) == [0, 2]
    with pytest.raises(sampling.IncompleteShards):
        sampling.require_complete(shards, done)
    sampling.require_complete(shards, shards)


def test_corpus_cap(spark):
    corpus = spark.range(100).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("_id"))
    qrels = spark.createDataFrame([("q", str(i), i % 2) for i in range(10)], "query_id STRING, corpus_id STRING, score INT")
    got = {r["_id"] for r in sampling.corpus_cap(corpus, qrels, 20, seed=1).collect()}
    assert len(got) == 20 and {"1", "3", "5", "7", "9"} <= got
    with pytest.raises(ValueError):
        sampling.corpus_cap(corpus, qrels, 4, seed=1)


@pytest.mark.parametrize("few_rows", [0, 40, 4096])
def test_nodup_batches_never_repeat(spark, few_rows):
    """A third of the rows share a text, texts return in other columns, some are missing."""
    rnd = random.Random(2)
    pick = lambda: "hot" if rnd.random() < 0.2 else rnd.choice([None, ""] + [f"t{k}" for k in range(400)])
    rows = [(i * 3, pick(), (pick() or "x").upper(), f" {pick()} ") for i in range(300)]
    df = spark.createDataFrame(rows, "pos BIGINT, query STRING, positive STRING, negative STRING").repartition(4)
    columns = ["query", "positive", "negative"]
    got = sampling.nodup_batches(df, 8, columns, few_rows=few_rows).collect()
    assert sorted(r["pos"] for r in got) == [r[0] for r in rows]
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append({r[c].strip().lower() for c in columns if r[c] is not None})
    hot = sum(any("hot" in (x or "").lower() for x in r[1:]) for r in rows)
    assert len(batches) >= hot > 100
    for batch in batches.values():
        assert len(batch) <= 8 and sum(map(len, batch)) == len(set().union(*batch))


def test_nodup_batches_fill_up_without_repeats(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("q"))
    sizes = sampling.nodup_batches(df, 32, ["q"], few_rows=0).groupBy("batch_id").count().collect()
    assert len(sizes) == 32 and {r["count"] for r in sizes} == {31, 32}
    assert sampling.nodup_batches(df.limit(0), 32, ["q"]).count() == 0


def test_nodup_batches_equal_their_sql(spark):
    """The query returns the batches themselves; with few rows dealt at the end, the SQL's rounds are used as well."""
    assert queries()["nodup_batches"](spark, SF).columns == ["pos", "batch_id"]
    sql = oracle_sql()["nodup_batches"]
    assert f"n > {sampling.FEW_ROWS}" in sql
    columns = ["query", "positive", "negative"]
    for few_rows in (0, 30, sampling.FEW_ROWS):
        got = sampling.nodup_batches(_triplets(spark, SF), BATCH, columns, seed=SEED, few_rows=few_rows)
        difference, rows = compare(got.select("pos", "batch_id"), connect(SF), sql.replace(
            f"n > {sampling.FEW_ROWS}", f"n > {few_rows}"))
        assert difference == "" and rows == 200


def test_next_row_wraps_round(spark):
    places = [-5, 3, 2**40, 2**62]
    df = spark.createDataFrame([(p, f"t{p}") for p in places], "pos BIGINT, text STRING")
    got = {r["pos"]: r["after"] for r in with_next(df, "text", "after").collect()}
    assert got == {p: f"t{n}" for p, n in zip(places, places[1:] + places[:1])}


@pytest.mark.parametrize("step", [1 << 20, 1 << 54])
def test_number_rows_far_apart(spark, step):
    """Positions far apart: no window without keys sees more than a few rows."""
    df = spark.range(-300, 500).select((F.col("id") * step).alias("pos"), F.pmod("id", F.lit(2)).alias("odd"))
    got = {r["pos"]: r["row_id"] for r in number_rows(df).collect()}
    assert got == {p * step: i for i, p in enumerate(range(-300, 500))}
    keyed = number_rows(df, keys=["odd"], total="n").collect()
    assert all(r["row_id"] == (r["pos"] // step + 300) // 2 and r["n"] == 400 for r in keyed)


def test_top_window_is_bounded(spark):
    """2^30 buckets of one position each, cut to their top 2^13 by the levels."""
    counts = spark.range(5000).select(F.shiftleft("id", 34).alias("_b"), F.lit(1).alias("_n"))
    got = _offsets(counts, [], 47).collect()
    assert {r["_b"] >> 34: r["_offset"] for r in got} == {i: i for i in range(5000)}


def test_shuffle_batches(spark):
    got = sampling.shuffle_batches(positions(spark, 100), 8, seed=1).collect()
    sizes = Counter(r["batch_id"] for r in got)
    assert sorted(sizes.values()) == [4] + [8] * 12


def test_dev_split_overlap_and_disjoint(spark):
    corpus = positions(spark, 200)
    train = sampling.sample_exact(corpus, ratio=0.5, seed=1)
    overlap = sampling.dev_split(corpus, 0.5, 1).join(train, "pos").count()
    assert overlap > 0
    apart = sampling.dev_split(corpus, 0.5, 1, train=train, disjoint=True)
    assert apart.join(train, "pos").count() == 0 and apart.count() == 50


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_unique_with_hot_and_null_keys(spark, how):
    rows = [(i, "hot" if i % 2 else (None if i % 10 == 0 else f"k{i % 7}")) for i in range(200)]
    left = spark.createDataFrame(rows, "pos BIGINT, key STRING")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key STRING, v INT")
    expected = left.join(right, ["key"], how)
    got = join_unique(left, right, ["key"], "pos", how, hot_rows=9)
    norm = lambda df: sorted(map(str, df.select("pos", "key", "v").collect()))
    assert norm(got) == norm(expected)


def test_word_marks_look_uniform(spark):
    marks = spark.range(50).select(F.explode(word_marks(F.xxhash64("id") % 2**30 + 2**30, F.lit(400))).alias("m"))
    share = marks.agg(F.avg((F.col("m") > int(0.1 * 2**31)).cast("double"))).first()[0]
    assert abs(share - 0.9) < 0.01
    assert marks.agg(F.min("m"), F.max("m")).first()[0] >= 0
