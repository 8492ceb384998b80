import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.vectors import cos_sim, dot_score
from pairloom.operators import search
from pairloom.operators.search import SCORE_DIGITS, topk_search

SCHEMA = "dataset STRING, _id STRING, vec ARRAY<DOUBLE>"


def vectors(seed, prefix, sizes, dim=4, grid=None):
    rnd = np.random.default_rng(seed)
    rows = []
    for name, n in sizes.items():
        for i in range(n):
            vec = rnd.integers(-grid, grid + 1, dim) if grid else rnd.normal(size=dim)
            rows.append((name, f"{prefix}{i}", [float(x) for x in vec]))
    return rows


def brute(queries, corpus, k, skip_self=False):
    out = set()
    for dataset, qid, q in queries:
        scored = {"dot_score": [], "cos_sim": []}
        for name, cid, c in corpus:
            if name != dataset or (skip_self and cid == qid):
                continue
            a, b = np.array(q), np.array(c)
            norms = np.sqrt(a @ a) * np.sqrt(b @ b)
            scored["dot_score"].append((-round(a @ b, SCORE_DIGITS), cid))
            scored["cos_sim"].append((-round((a @ b) / norms if norms else 0.0, SCORE_DIGITS), cid))
        for fn, hits in scored.items():
            out |= {(dataset, fn, qid, cid, rank) for rank, (_, cid) in enumerate(sorted(hits)[:k], 1)}
    return out


def found(run):
    return {(r["dataset"], r["score_fn"], r["query_id"], r["corpus_id"], r["rank"]) for r in run.collect()}


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 40_000}, {"broadcast_bytes": 40_000, "floor_rows": 0}])
def test_both_ways_equal_brute_force(spark, limits):
    """One collection holds most of the corpus; small integer vectors give many ties."""
    sizes = {"big": 120, "small": 7, "alone": 3}
    queries = vectors(1, "q", {"big": 20, "small": 5, "nowhere": 2}, grid=2)
    corpus = vectors(2, "c", sizes, grid=2)
    run = topk_search(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA).repartition(4),
                      10, dataset="dataset", **limits)
    assert found(run) == brute(queries, corpus, 10)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 9000, "floor_rows": 0}])
def test_skip_self(spark, limits):
    rows = vectors(3, "v", {"a": 40})
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(topk_search(df, df, 5, dataset="dataset", skip_self=True, **limits)) == brute(rows, rows, 5, True)


def test_many_chunks_and_copies(spark):
    """More rows than a chunk, a third of them copies of one vector."""
    rnd = np.random.default_rng(4)
    n = 20_000
    matrix = rnd.normal(size=(n, 4))
    matrix[: n // 3] = matrix[0]
    ids = [f"c{i:05d}" for i in range(n)]
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], "_id STRING, vec ARRAY<DOUBLE>")
    query = matrix[0] / 2
    queries = spark.createDataFrame([("q", [float(x) for x in query])], "_id STRING, vec ARRAY<DOUBLE>")
    run = topk_search(queries, corpus.coalesce(1), 50, {"dot": lambda a, b: a @ b.T})
    scores = np.round(matrix @ query, SCORE_DIGITS)
    expected = [c for _, c in sorted(zip(-scores, ids))[:50]]
    assert [r["corpus_id"] for r in run.orderBy("rank").collect()] == expected


def test_fewer_documents_than_k_and_zero_vectors(spark):
    queries = spark.createDataFrame([("q", [0.0, 0.0])], "_id STRING, vec ARRAY<DOUBLE>")
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 0.0])], "_id STRING, vec ARRAY<DOUBLE>")
    rows = topk_search(queries, corpus, 5).orderBy("score_fn", "rank").collect()
    assert [(r["score_fn"], r["corpus_id"], r["score"]) for r in rows] == [
        ("cos_sim", "a", 0.0), ("cos_sim", "b", 0.0), ("dot_score", "a", 0.0), ("dot_score", "b", 0.0)]


def test_expression_scores(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    rows = df.select(dot_score(F.col("a"), F.col("b")), cos_sim(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(24.0, 0.96), (0.0, 0.0)]


def test_plan_has_group_limit_and_no_product(spark):
    rows = spark.createDataFrame(vectors(5, "v", {"a": 10}), SCHEMA)
    plan = topk_search(rows, rows, 3, dataset="dataset")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_missing_vector_is_an_error(spark):
    good = spark.createDataFrame([("q", [1.0, 0.0])], "_id STRING, vec ARRAY<DOUBLE>")
    bad = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "_id STRING, vec ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="needs a vector"):
        topk_search(good, bad, 1).collect()


@pytest.mark.parametrize("bad, message", [
    ([float("nan"), 0.0], "finite"), ([None, 0.0], "finite"), ([float("inf"), 0.0], "finite"),
    ([1.0], "width 2"), ([1.0, 2.0, 3.0], "width 2"), ([], "width 2")])
@pytest.mark.parametrize("side", ["queries", "corpus"])
def test_broken_vectors_are_errors(spark, bad, message, side):
    good = [(f"g{i}", [1.0, float(i)]) for i in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "_id STRING, vec ARRAY<DOUBLE>").coalesce(1)
    broken = frame([*good, ("bad", bad)])
    with pytest.raises(Exception, match=message):
        topk_search(broken if side == "queries" else frame(good), broken if side == "corpus" else frame(good), 2,
                    dim=2).collect()


def big(spark, tasks, n=6000, k=60):
    """A search over ``tasks`` tasks, its queries, and the matrices."""
    rnd = np.random.default_rng(9)
    docs, asked = rnd.normal(size=(n, 8)), rnd.normal(size=(25, 8))
    frame = lambda prefix, m: spark.createDataFrame(
        [("a", f"{prefix}{i:05d}", list(map(float, v))) for i, v in enumerate(m)], "dataset STRING, id STRING, vec ARRAY<DOUBLE>")
    found = search.Search(frame("c", docs).repartition(tasks), {"a": n}, 8, k, {"dot": search.dot_matrix}, False, 0)
    return found, frame("q", asked), docs, asked


@pytest.mark.parametrize("tasks", [4, 16, 64])
def test_hits_do_not_grow_with_tasks(spark, tasks):
    found, asked, docs, matrix = big(spark, tasks)
    hits = found.hits(asked)
    assert hits.count() <= 3 * 25 * 60
    got = {(r["query_id"], r["corpus_id"]) for r in search.rank_hits(hits, 60).collect()}
    scores = np.round(matrix @ docs.T, SCORE_DIGITS)
    assert got == {(f"q{i:05d}", f"c{c:05d}") for i, row in enumerate(scores) for c in np.argsort(-row, kind="stable")[:60]}


def test_a_floor_that_is_too_high_is_found_out(spark, monkeypatch):
    """The sample's best score as the floor leaves most queries short: they are scored again."""
    monkeypatch.setattr(search.Search, "sample_rank", lambda self: 1)
    found, asked, docs, matrix = big(spark, 8, n=1500)
    got = {(r["query_id"], r["corpus_id"]) for r in search.rank_hits(found.hits(asked), 60).collect()}
    scores = np.round(matrix @ docs.T, SCORE_DIGITS)
    assert got == {(f"q{i:05d}", f"c{c:05d}") for i, row in enumerate(scores) for c in np.argsort(-row, kind="stable")[:60]}


def test_the_corpus_is_not_copied_per_block(spark):
    rows = vectors(11, "v", {"a": 60})
    df = spark.createDataFrame(rows, SCHEMA)
    run = topk_search(df, df, 5, dataset="dataset", broadcast_bytes=5000)
    assert "Generate" not in run._jdf.queryExecution().toString()
    assert found(run) == brute(rows, rows, 5)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e7, 1e16])
@pytest.mark.parametrize("grid", [None, 2])
def test_short_products_lose_nothing(scale, grid):
    """Ranks and scores are those of double precision, with close scores, ties and floors."""
    rnd = np.random.default_rng(12)
    make = lambda n: (rnd.integers(-grid, grid + 1, (n, 6)) * 1.0 if grid else rnd.normal(size=(n, 6)))
    asked, docs = make(40), make(3000)
    docs[1000:1500] = docs[:500] * (1 + 1e-7)  # closer than single precision tells apart
    asked, docs = asked * scale, docs * scale
    block = search.Block("a", np.array([f"q{i:04d}" for i in range(40)], dtype=object), asked)
    raw = asked @ docs.T
    raw[3, 7] = -np.inf  # the query q0003 is the document of that id
    for floor in (np.full(40, -np.inf), np.round(np.sort(raw, axis=1)[:, -30], SCORE_DIGITS)):
        scorer = search._Scorer({"a": block._replace(floors=floor[:, None])}, 20, {"dot": search.dot_matrix},
                                {"dot": np.asarray}, True)
        for start in (0, 1000, 2000):
            ids = [f"c{i:04d}" if (i, start) != (7, 0) else "q0003" for i in range(start, start + 1000)]
            scorer.add(search.Block("a", np.array(ids, dtype=object), docs[start:start + 1000]))
        hits = [r for b in scorer.best["a", "dot"].hits() for r in b.to_pylist()]
        for i in range(40):
            mine = sorted((r["score"] for r in hits if r["query_id"] == f"q{i:04d}"), reverse=True)
            assert np.allclose(mine, np.sort(raw[i])[::-1][:20], rtol=1e-12, atol=2e-9)
        assert len(hits) == 800 and ("q0003", "q0003") not in {(r["query_id"], r["corpus_id"]) for r in hits}


def test_samples_are_bounded_and_large_collections_share_them():
    """The sample does not grow with the collection; the hits above its floors grow far less than the collection."""
    at = lambda n: search.Search(None, {"a": n, "b": n // 2, "small": 10}, 64, 100, search.SCORE_FNS, False, search.FLOOR_ROWS)
    for n in (10_000, 10**6, 10**9):
        assert at(n).share() * 1.5 * n * (8 * 64 + 64) <= search.SAMPLE_BYTES + 1
    assert at(10**6).sample_rank() / at(10**6).share() < 10**4 / 20


def test_floors_lie_with_the_queries(spark):
    """One floor per score function, below the k-th best, and none for small collections; no exchange."""
    corpus, queries = vectors(13, "v", {"big": 900, "small": 20}), vectors(14, "q", {"big": 30, "small": 4, "none": 2})
    docs = search._prepare(spark.createDataFrame(corpus, SCHEMA), "_id", "vec", "dataset")
    asked = search._prepare(spark.createDataFrame(queries, SCHEMA).repartition(3), "_id", "vec", "dataset")
    found = search.Search(docs, {"big": 900, "small": 20}, 4, 60, search.SCORE_FNS, False, 100).with_floors(asked)
    assert found._jdf.queryExecution().toString().count("Exchange") <= 4  # the test's own repartition, in four plans
    for r in found.collect():
        scores = sorted((np.dot(r["vec"], c[2]) for c in corpus if c[0] == r["dataset"]), reverse=True)
        assert len(r["floors"]) == 2
        assert r["floors"][1] <= scores[20] if r["dataset"] == "big" else r["floors"][1] == -np.inf


@pytest.mark.parametrize("rank", [None, 1])
def test_blocks_write_no_hits_and_mend_short_queries_once(spark, monkeypatch, tmp_path, rank):
    """Only the run is written, not the tasks' hits; queries with floors that are too high are searched again, all
    blocks' together."""
    if rank:
        monkeypatch.setattr(search.Search, "sample_rank", lambda self: rank)
    written, scans, scan = [], [], search.Search.scan
    monkeypatch.setattr(search, "scratch_dir", lambda s, label: written.append(label) or str(tmp_path / f"{label}{len(written)}"))
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or df.cache())
    monkeypatch.setattr(search.Search, "scan", lambda self, blocks, **kw: scans.append(blocks[0].floors) or scan(self, blocks, **kw))
    queries, corpus = vectors(21, "q", {"a": 40, "small": 6}, grid=2), vectors(22, "c", {"a": 400, "small": 12}, grid=2)
    run = topk_search(spark.createDataFrame(queries, SCHEMA).repartition(3), spark.createDataFrame(corpus, SCHEMA).repartition(5),
                      20, dataset="dataset", broadcast_bytes=15_000, floor_rows=0)
    assert found(run) == brute(queries, corpus, 20)
    assert "hits" not in written
    first = [s is None for s in scans]
    assert first == sorted(first)  # all blocks with their floors, then the short queries without
    assert (True in first) == (rank == 1)


def test_lists_are_ranked_like_hits(spark):
    """Ties, copies, NULL ids, queries that span batches and lists of several rows."""
    rnd = np.random.default_rng(23)
    rows = [("a" if i % 3 else "b", "f", None if q == 4 else f"q{q}", [None if c == 7 else f"c{c}" for c in ids],
             [float(x) for x in rnd.integers(0, 4, len(ids))])
            for i in range(60) for q in range(6) for ids in [rnd.choice(500, rnd.integers(1, 9), replace=False).tolist()]]
    lists = spark.createDataFrame(rows, search._LISTS).repartition(7)
    flat = lists.select(*search._QUERY, F.explode(F.arrays_zip("ids", "scores")).alias("h")).select(
        *search._QUERY, F.col("h.ids").alias("corpus_id"), F.col("h.scores").alias("score"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = search.rank_lists(lists, 25).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs)))
    assert key(got) == key(search.rank_hits(flat, 25).collect())


def test_a_written_run_is_searched_once(spark):
    df = spark.createDataFrame(vectors(24, "v", {"a": 30}), SCHEMA)
    for limits in ({}, {"broadcast_bytes": 5000}):
        run = topk_search(df, df, 5, dataset="dataset", written=True, **limits)
        assert "MapInArrow" not in run._jdf.queryExecution().toString()


@pytest.mark.parametrize("fns", [search.SCORE_FNS, {"distance": lambda a, b: -((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)}])
def test_tiles_are_bounded_on_both_sides(fns, monkeypatch):
    """A chunk is scored in tiles of few documents, with the same hits; ids of queries in any tile are skipped."""
    rnd = np.random.default_rng(25)
    asked, docs = rnd.normal(size=(30, 4)), rnd.normal(size=(500, 4))
    ids = np.array([f"q{i:04d}" if i % 50 == 7 else f"c{i:04d}" for i in range(500)], dtype=object)
    block = search.Block("a", np.array([f"q{i:04d}" for i in range(30)], dtype=object), asked)
    widths = []
    for name in ("best_k", "best_products"):
        one = getattr(search, name)
        monkeypatch.setattr(search, name, lambda a, b, *rest, one=one: widths.append(
            len(b.full) if isinstance(b, search._Rows) else a.shape[1]) or one(a, b, *rest))

    def hits(cols):
        monkeypatch.setattr(search, "TILE_COLS", cols)
        prepare = {n: search.PRODUCTS[f] for n, f in fns.items() if f in search.PRODUCTS}
        scorer = search._Scorer({"a": block}, 9, fns, prepare, True)
        scorer.add(search.Block("a", ids, docs))
        return {(r["score_fn"], r["query_id"], r["corpus_id"], r["score"]) for b in scorer.best.values()
                for part in b.hits() for r in part.to_pylist()}

    whole = hits(500)
    widths.clear()
    assert hits(64) == whole and not any(q == c for _, q, c, _ in whole)
    assert max(widths) <= 64
