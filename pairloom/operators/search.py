"""Exact top-k similarity search over vectors.

Queries are held as blocks of one matrix, the corpus streams by in chunks, and one matrix product
scores a chunk against a block, tile by tile in a tile that fits a core's cache. The score matrix is never written:
a floor per query prunes it, and a task returns each query's best k, not more. A window keeps the final k
(planned as a partial and a final group limit).

The known score functions are inner products of prepared rows. Their tiles are computed in single precision, and what
may reach the floor within its error bound is computed again in double precision. So scores and ranks are those of
double precision; only entries far below the floor are dismissed by the short product. Other functions, very large
entries and tiles with many candidates are scored in double precision throughout.

Beyond ``FLOOR_ROWS`` documents a collection is sampled first. Every task starts from a floor, so the hits
grow with k, not with the number of tasks. The floor is the j-th best score of a query in a hashed sample of at most
``SAMPLE_BYTES``, which is broadcast; the queries get their floors where they lie, once for all blocks. Of a
sample that holds a share s of the collection, the k best documents fall into it k * s times on average; j lies three
standard deviations above, at most k. If j = k the floor is safe. Else a query that found fewer than k documents above its
floor is scored again without one, so the result is exact in any case.

A block of queries is broadcast; its size is bounded by ``BROADCAST_BYTES``, the hits that a task holds included. More
queries are cut into blocks by a hash of their ids and worked off one after the other against a corpus that is written
once: it is neither shuffled nor copied. The tasks' hits of a block leave as lists by query, meet by one exchange and are
merged as arrays; only the ranked run is written. Queries that come out short are then searched for all blocks together.

Scores are ranked after rounding to ``SCORE_DIGITS``, because the last bits of a matrix product
depend on its blocking; equal scores go by ascending ``corpus_id``. A vector that is NULL, of another
width than the first query's, or not finite raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.session import materialize, scratch_dir

SCORE_DIGITS = 9
BROADCAST_BYTES = 64 << 20  # of a query block with its running best hits
SAMPLE_BYTES = 32 << 20  # of the vectors sampled from all large collections
FLOOR_ROWS = 5_000  # documents of a collection beyond which it gets floors
SAMPLED_BEST = 12  # how many of the k best a sample should hold, if it may be that large
HIT_BYTES = 64
LIST_HITS = 32  # hits in one row of a task's lists
TILE_BYTES = 2 << 20  # score tile in a task: fits a core's cache
TILE_COLS = 2048  # documents of a tile: long narrow tiles cost more to prepare than to multiply
CHUNK_ROWS = 8192
EXACT_ROWS = 16384  # candidates scored again at once
SHORT_MAX = 1e15  # rows up to this length are multiplied in single precision

ScoreFn = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot_matrix(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return queries @ docs.T


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def cos_matrix(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return unit_rows(queries) @ unit_rows(docs).T


SCORE_FNS: dict[str, ScoreFn] = {"cos_sim": cos_matrix, "dot_score": dot_matrix}

# Functions that are the inner product of rows, and what is done to the rows before.
PRODUCTS: dict[ScoreFn, Callable[[np.ndarray], np.ndarray]] = {cos_matrix: unit_rows, dot_matrix: np.asarray}

_HITS = "dataset string, score_fn string, query_id string, corpus_id string, score double"
_LISTS = "dataset string, score_fn string, query_id string, ids array<string>, scores array<double>"
_RUN = f"{_HITS}, rank int"
_QUERY = ["dataset", "score_fn", "query_id"]


class Block(NamedTuple):
    """Vectors of one collection, ids ascending; queries may have a floor per score function."""

    dataset: str
    ids: np.ndarray
    matrix: np.ndarray
    floors: np.ndarray | None = None


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; one that is missing, of another width or not finite is an error."""
    if vectors.null_count:
        raise ValueError("every query and document needs a vector, found NULL")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    odd = np.diff(vectors.offsets.to_numpy()) != dim
    if odd.any():
        raise ValueError(f"every vector needs the width {dim}, found {len(vectors[int(odd.argmax())])}")
    matrix = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    if not np.isfinite(matrix).all():  # NULL entries have become NaN
        raise ValueError("every vector needs finite entries, found NULL, NaN or an infinite one")
    return matrix


def _blocks(table: pa.Table | pa.RecordBatch, dim: int) -> list[Block]:
    """The collections of an Arrow table with columns dataset, id, vec and perhaps floors. Rows without a dataset
    belong to none."""
    keys = pa.table({c: table.column(c) for c in ("dataset", "id")})
    order = pc.sort_indices(keys, sort_keys=[("dataset", "ascending"), ("id", "ascending")]).to_numpy()
    matrix = _matrix(table.column("vec"), dim)
    floors = None
    if "floors" in table.schema.names:
        column = table.column("floors")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        floors = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else None
    known = table.num_rows - keys.column("dataset").null_count  # NULLs come last
    names = np.array(keys.column("dataset").to_pylist(), dtype=object)[order]
    ids = np.array(keys.column("id").to_pylist(), dtype=object)[order]
    starts = [0, *(np.flatnonzero(names[1:known] != names[:known - 1]) + 1), known] if known else []
    return [Block(names[a], ids[a:b], matrix[order[a:b]], None if floors is None else floors[order[a:b]])
            for a, b in zip(starts, starts[1:])]


def _margin(bound: np.ndarray) -> np.ndarray:
    """``bound`` less what rounding can add to a score."""
    return bound - (2 * 10.0 ** -SCORE_DIGITS + 1e-15 * np.abs(bound))


def _place(rows: np.ndarray) -> np.ndarray:
    """Places 0.. within equal values of the ascending ``rows``."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _keep(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, k: int, floor: np.ndarray):
    """Rounded values that reach their row's floor, the ``k`` best a row, ties to the lower column."""
    values = np.round(values, SCORE_DIGITS) + 0.0  # no negative zero
    reach = (values >= floor[rows]) & (values > -np.inf)
    rows, cols, values = rows[reach], cols[reach], values[reach]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    keep = _place(rows) < k
    return rows[keep], cols[keep], values[keep]


def best_k(raw: np.ndarray, k: int, floor: np.ndarray):
    """(row, column, rounded score) of each row's k best entries that reach the row's ``floor``.

    Ties after rounding go to the lower column. Entries of -inf are never returned. The matrix is
    pruned with a margin before anything is rounded, so most of it is only compared once.
    """
    candidate = raw >= _margin(floor)[:, None]
    crowded = np.flatnonzero(np.count_nonzero(candidate, axis=1) > k)
    if len(crowded):  # rare once the floors have risen
        some = raw[crowded]
        kth = -np.partition(-some, k - 1, axis=1)[:, k - 1]
        candidate[crowded] &= some >= _margin(kth)[:, None]
    rows, cols = np.nonzero(candidate)
    return _keep(rows, cols, raw[rows, cols], k, floor)


class _Rows(NamedTuple):
    """Rows whose inner products are scores, in double and in single precision."""

    full: np.ndarray
    short: np.ndarray
    norms: np.ndarray

    def part(self, start: int, stop: int) -> _Rows:
        return _Rows(*(a[start:stop] for a in self))


def _rows(matrix: np.ndarray) -> _Rows | None:
    """None if a row is too long for single precision."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    if not (norms <= SHORT_MAX).all():
        return None
    return _Rows(matrix, matrix.astype(np.float32), norms)


def best_products(asked: _Rows, docs: _Rows, k: int, floor: np.ndarray, own: tuple[np.ndarray, np.ndarray]):
    """:func:`best_k` of the inner products without the entries ``own``.

    A product of w terms in single precision is off by less than (w + 4) * 2^-23 times both lengths, the
    rounding of the entries included, so only entries within that of the bound are computed in full.
    """
    rough = asked.short @ docs.short.T
    rough[own] = -np.inf
    slack = (asked.full.shape[1] + 4) * 2.0 ** -23 * asked.norms * docs.norms.max()
    low = lambda bound: np.nextafter((_margin(bound) - slack_of).astype(np.float32), np.float32(-np.inf))[:, None]
    slack_of = slack
    candidate = rough >= low(floor)
    candidate[own] = False
    width = rough.shape[1]
    flat = np.flatnonzero(candidate)
    if len(flat) > k:
        crowded = np.flatnonzero(np.bincount(flat // width, minlength=len(rough)) > k)
        if len(crowded):
            some = rough[crowded]
            kth = np.partition(some, width - k, axis=1)[:, width - k].astype(float)
            slack_of = 2 * slack[crowded]  # of the k-th best and of the entry
            candidate[crowded] &= some >= low(kth)
            flat = np.flatnonzero(candidate)
    if len(flat) > max(rough.size // 8, EXACT_ROWS):  # many ties
        raw = asked.full @ docs.full.T
        raw[own] = -np.inf
        return best_k(raw, k, floor)
    rows, cols = np.divmod(flat, width)
    values = np.empty(len(flat))
    for at in range(0, len(flat), EXACT_ROWS):
        part = slice(at, at + EXACT_ROWS)
        values[part] = np.einsum("ij,ij->i", asked.full[rows[part]], docs.full[cols[part]])
    return _keep(rows, cols, values, k, floor)


class _Best:
    """The best hits seen so far of one block under one score function."""

    def __init__(self, block: Block, name: str, k: int, floor: np.ndarray | None):
        self.block, self.name, self.k = block, name, k
        self.floor = np.full(len(block.ids), -np.inf) if floor is None else np.array(floor, dtype=float)
        self.held: list[pa.Table] = []
        self.n = 0

    def add(self, rows: np.ndarray, ids: pa.Array, values: np.ndarray) -> None:
        self.held.append(pa.table({"row": pa.array(rows, pa.int64()), "id": ids, "score": pa.array(values)}))
        self.n += len(rows)
        if self.n > 2 * self.k * len(self.block.ids):
            self.cut()

    def cut(self) -> None:
        """Drops all but the best k of each query and raises the floors to the k-th best."""
        if not self.held:
            return
        all_ = pa.concat_tables(self.held)
        rows, values = all_.column("row").to_numpy(), all_.column("score").to_numpy()
        order = np.lexsort((-values, rows))
        last = order[_place(rows[order]) == self.k - 1]  # one a query that has k
        self.floor[rows[last]] = values[last]
        all_ = all_.filter(pa.array(values >= self.floor[rows]))
        rows = all_.column("row").to_numpy()
        if len(rows) and np.bincount(rows).max() > self.k:  # ties at the floor go by id
            all_ = all_.sort_by([("row", "ascending"), ("score", "descending"), ("id", "ascending")])
            all_ = all_.filter(pa.array(_place(all_.column("row").to_numpy()) < self.k))
        self.held, self.n = [all_.combine_chunks()], all_.num_rows

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        for table in self.held:
            n = table.num_rows
            asked = pa.array(self.block.ids, pa.string()).take(table.column("row").combine_chunks())
            yield from pa.table([
                pa.array([self.block.dataset], pa.string()).take(pa.array(np.zeros(n, np.int64))),
                pa.array([self.name], pa.string()).take(pa.array(np.zeros(n, np.int64))), asked,
                table.column("id"), table.column("score")],
                names=["dataset", "score_fn", "query_id", "corpus_id", "score"]).to_batches(10_000)

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The hits of :meth:`hits` as lists by query, of at most ``LIST_HITS``."""
        self.cut()
        for table in self.held:
            rows = table.column("row").to_numpy()
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(_place(rows) % LIST_HITS == 0)
            cuts = pa.array(np.append(first, len(rows)).astype(np.int32))
            ids = table.column("id").combine_chunks().take(pa.array(order))
            same = pa.array(np.zeros(len(first), np.int64))
            yield from pa.table([
                pa.array([self.block.dataset], pa.string()).take(same), pa.array([self.name], pa.string()).take(same),
                pa.array(self.block.ids, pa.string()).take(pa.array(rows[first])), pa.ListArray.from_arrays(cuts, ids),
                pa.ListArray.from_arrays(cuts, pa.array(table.column("score").to_numpy()[order]))],
                names=[*_QUERY, "ids", "scores"]).to_batches(10_000)


class _Scorer:
    """Scores chunks against blocks and keeps the best k of each query."""

    def __init__(self, blocks: dict[str, Block], k: int, score_fns: dict[str, ScoreFn], prepare: dict, skip_self: bool):
        self.blocks, self.k, self.score_fns, self.prepare = blocks, k, score_fns, prepare
        self.best = {(d, f): _Best(block, f, k, None if block.floors is None else block.floors[:, i])
                     for d, block in blocks.items() for i, f in enumerate(score_fns)}
        self.rows = {(d, f): _rows(p(block.matrix)) for d, block in blocks.items() for f, p in prepare.items()}
        self.places = {d: {q: i for i, q in enumerate(block.ids)} for d, block in blocks.items()} if skip_self else {}

    def own(self, chunk: Block) -> tuple[np.ndarray, np.ndarray]:
        """Query and document places of equal ids, queries ascending."""
        places = self.places.get(chunk.dataset, {})
        pairs = sorted((places[c], i) for i, c in enumerate(chunk.ids) if c in places)
        return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)

    def add(self, chunk: Block) -> None:
        block = self.blocks.get(chunk.dataset)
        if block is None:
            return
        if len(chunk.ids) > TILE_COLS:
            for at in range(0, len(chunk.ids), TILE_COLS):
                self.add(Block(chunk.dataset, chunk.ids[at:at + TILE_COLS], chunk.matrix[at:at + TILE_COLS]))
            return
        own_rows, own_cols = self.own(chunk)
        tile = max(1, TILE_BYTES // (4 * len(chunk.ids)))
        ids = pa.array(chunk.ids, pa.string())
        for name, score_fn in self.score_fns.items():
            state = self.best[chunk.dataset, name]
            asked, docs = self.rows.get((chunk.dataset, name)), None
            if asked is not None:
                docs = _rows(self.prepare[name](chunk.matrix))
            found = []
            for start in range(0, len(block.ids), tile):
                stop = min(start + tile, len(block.ids))
                a, b = np.searchsorted(own_rows, (start, stop))
                own, floor = (own_rows[a:b] - start, own_cols[a:b]), state.floor[start:stop]
                if docs is not None:
                    rows, cols, values = best_products(asked.part(start, stop), docs, self.k, floor, own)
                else:
                    scores = score_fn(block.matrix[start:stop], chunk.matrix)
                    scores[own] = -np.inf
                    rows, cols, values = best_k(scores, self.k, floor)
                if len(rows):
                    found.append((start + rows, cols, values))
            if found:
                rows, cols, values = (np.concatenate(x) for x in zip(*found))
                state.add(rows, ids.take(pa.array(cols)), values)


def _prepare(df: DataFrame, id_col: str, vec_col: str, dataset: str | None) -> DataFrame:
    name = F.col(dataset).cast("string") if dataset else F.lit("")
    return df.select(name.alias("dataset"), F.col(id_col).cast("string").alias("id"),
                     F.col(vec_col).alias("vec"))


class Search(NamedTuple):
    """What the blocks of one search share."""

    docs: DataFrame
    sizes: dict[str, int]  # documents of each collection
    dim: int
    k: int
    score_fns: dict[str, ScoreFn]
    skip_self: bool
    floor_rows: int

    def products(self) -> dict[str, Callable[[np.ndarray], np.ndarray]]:
        return {name: PRODUCTS[fn] for name, fn in self.score_fns.items() if fn in PRODUCTS}

    def scan(self, blocks: list[Block], lists: bool = False) -> DataFrame:
        """Each task's best ``k`` hits of every query of the blocks, none below its floor; one row a hit or in lists."""
        k, score_fns, prepare, skip_self, dim = self.k, self.score_fns, self.products(), self.skip_self, self.dim
        # Plain tuples: a broadcast value must not need this package on the executors.
        shared = self.docs.sparkSession.sparkContext.broadcast([tuple(b) for b in blocks])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _Scorer({b[0]: Block(*b) for b in shared.value}, k, score_fns, prepare, skip_self)
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK_ROWS):
                    for chunk in _blocks(batch.slice(start, CHUNK_ROWS), dim):
                        scorer.add(chunk)
            for best in scorer.best.values():
                yield from best.lists() if lists else best.hits()

        return self.docs.mapInArrow(run, _LISTS if lists else _HITS)

    def large(self) -> dict[str, int]:
        """Collections that get floors."""
        return {d: n for d, n in self.sizes.items() if n > max(self.floor_rows, 4 * self.k)}

    def share(self) -> float:
        """The share of a large collection that is sampled."""
        rows = SAMPLE_BYTES / (8 * self.dim + 64)
        return min(0.5, SAMPLED_BEST / self.k, rows / max(1, sum(self.large().values())))

    def sample_rank(self) -> int:
        mean = self.k * self.share()
        return min(self.k, math.ceil(mean + 3 * math.sqrt(mean) + 1))

    def with_floors(self, asked: DataFrame) -> DataFrame:
        """``asked`` with ``floors``, one per score function; -inf in small collections."""
        j, score_fns, prepare, skip_self, dim = self.sample_rank(), self.score_fns, self.products(), self.skip_self, self.dim
        cut = round(self.share() * (1 << 30))
        drawn = self.docs.filter(F.col("dataset").isin(list(self.large())) &
                                 (F.pmod(F.xxhash64("dataset", "id"), F.lit(1 << 30)) < cut)).toArrow()
        shared = asked.sparkSession.sparkContext.broadcast([tuple(b) for b in _blocks(drawn, dim)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    blocks = _blocks(batch.slice(at, CHUNK_ROWS), dim)
                    scorer = _Scorer({b.dataset: b for b in blocks}, j, score_fns, prepare, skip_self)
                    for name, ids, matrix, _ in shared.value:
                        for start, stop in _steps(len(ids)):
                            scorer.add(Block(name, ids[start:stop], matrix[start:stop]))
                            for f in score_fns if name in scorer.blocks else ():
                                scorer.best[name, f].cut()  # the next chunk meets the floors of this one
                    for block in blocks:
                        n = len(block.ids)
                        floors = np.stack([scorer.best[block.dataset, f].floor for f in score_fns], axis=1)
                        lists = lambda m: pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block.dataset] * n, pa.string()), pa.array(block.ids, pa.string()),
                             lists(block.matrix), lists(floors)], names=["dataset", "id", "vec", "floors"])

        return asked.mapInArrow(run, "dataset string, id string, vec array<double>, floors array<double>")

    def hits(self, asked: DataFrame) -> DataFrame:
        """Hits of one block of queries that hold every query's best k."""
        large = self.large()
        if large and "floors" not in asked.columns:
            asked = self.with_floors(asked)
        blocks = _blocks(asked.toArrow(), self.dim)
        hits = self.scan(blocks)
        large = [b for b in blocks if b.dataset in large]
        if not large or self.sample_rank() == self.k:
            return hits
        hits = materialize(hits, "hits")
        counts = hits.groupBy("dataset", "score_fn", "query_id").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= self.k).toArrow()
        full = set(zip(*(counts.column(c).to_pylist() for c in ("dataset", "score_fn", "query_id"))))
        short = []
        for block in large:
            rows = [i for i, q in enumerate(block.ids) if any((block.dataset, f, q) not in full for f in self.score_fns)]
            if rows:
                short.append(Block(block.dataset, block.ids[rows], block.matrix[rows]))
        if not short:
            return hits
        again = hits.sparkSession.createDataFrame(
            [(b.dataset, q) for b in short for q in b.ids], "dataset string, query_id string")
        kept = hits.join(F.broadcast(again), ["dataset", "query_id"], "left_anti")  # part of one block: bounded
        return kept.unionByName(self.scan(short))

    def write_run(self, asked: DataFrame, blocks: int, path: str) -> DataFrame:
        """The run of ``asked``, which lies in ``blocks`` folders: one after the other is searched, ranked and appended.

        A query is short of hits if its floor is too high.
        """
        for block in range(blocks):
            part = asked.filter(F.col("block") == block).drop("block")
            rank_lists(self.scan(_blocks(part.toArrow(), self.dim), lists=True), self.k).write.mode("append").parquet(path)
        return self.docs.sparkSession.read.schema(_RUN).parquet(path)

    def short(self, run: DataFrame, asked: DataFrame) -> DataFrame:
        """Queries (dataset, id) of large collections that have fewer than ``k`` hits by some score function."""
        wanted = asked.filter(F.col("dataset").isin(list(self.large()))).select(
            "dataset", "id", F.explode(F.array(*[F.lit(f) for f in self.score_fns])).alias("score_fn"))
        full = run.filter(F.col("rank") == self.k).select(*[F.col(c).alias(f"_{c}") for c in _QUERY])
        met = [F.col(a).eqNullSafe(F.col(f"_{b}")) for a, b in zip(("dataset", "score_fn", "id"), _QUERY)]
        return wanted.join(full, met, "left_anti").select("dataset", "id").distinct()


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """Chunks of ``n`` rows, the first ones small: they raise the floors of the others."""
    start, size = 0, min(1024, CHUNK_ROWS)
    while start < n:
        yield start, min(start + size, n)
        start, size = start + size, min(4 * size, CHUNK_ROWS)


def _dealt(asked: DataFrame, blocks: int) -> DataFrame:
    """``asked`` written down in ``blocks`` folders by a hash of the ids, which the column ``block`` names."""
    path = scratch_dir(asked.sparkSession, "queries")
    cut = asked.withColumn("block", F.pmod(F.xxhash64("dataset", "id"), F.lit(blocks)))
    cut.repartition("block").write.partitionBy("block").parquet(path)
    return asked.sparkSession.read.schema(cut.schema).parquet(path)


def topk_search(queries: DataFrame, corpus: DataFrame, k: int,
                score_fns: dict[str, ScoreFn] | None = None, dataset: str | None = None,
                query_id: str = "_id", corpus_id: str = "_id", vec: str = "vec",
                skip_self: bool = False, dim: int | None = None,
                broadcast_bytes: int = BROADCAST_BYTES, floor_rows: int = FLOOR_ROWS,
                written: bool = False) -> DataFrame:
    """The exact ``k`` best documents per query, score function and collection.

    ``skip_self`` drops hits whose document id equals the query id. ``score_fns`` maps names to
    functions of two matrices. ``dim`` is the vector width, read off one query if not given.
    Ids are unique within a collection. ``broadcast_bytes`` bounds a block of queries; collections
    of more than ``floor_rows`` documents get floors. ``written`` is for a run that is read several times: it
    is written down once, as that of several blocks always is.
    """
    score_fns = score_fns or SCORE_FNS
    asked = _prepare(queries, query_id, vec, dataset)
    docs = _prepare(corpus, corpus_id, vec, dataset)

    # Counting needs no vectors, so none are encoded for it; one row a collection.
    side = lambda df, name: df.select("dataset", F.lit(name).alias("side"))
    counts = side(asked, "q").unionByName(side(docs, "d")).groupBy("dataset", "side").count().collect()
    sizes = {r["dataset"]: r["count"] for r in counts if r["side"] == "d"}
    if dim is None:
        one = asked.select(F.size("vec").alias("dim")).first()
        dim = one["dim"] if one else 1
    search = Search(docs, sizes, dim, k, score_fns, skip_self, floor_rows)
    large = search.large()
    # Vector, id and the hits that a task holds: above a floor each of several tasks finds a part of them.
    held = lambda name: -(-k // 4) if name in large else k
    row_bytes = lambda hits: 8 * dim + hits * len(score_fns) * HIT_BYTES + 64
    block_bytes = sum(r["count"] * row_bytes(held(r["dataset"])) for r in counts if r["side"] == "q")
    blocks = -(-block_bytes // broadcast_bytes)
    if blocks <= 1:
        run = rank_hits(search.hits(asked), k)
        return materialize(run, "run") if written else run

    spark = asked.sparkSession
    search = search._replace(docs=materialize(docs, "corpus"))
    asked = _dealt(search.with_floors(asked) if large else asked, blocks)
    run = search.write_run(asked, blocks, scratch_dir(spark, "run"))
    if not large or search.sample_rank() == k:
        return run
    short = materialize(search.short(run, asked), "short")
    n = short.count()
    if not n:
        return run
    met = lambda df, key: [df["dataset"].eqNullSafe(short["dataset"]), df[key].eqNullSafe(short["id"])]
    again = asked.join(short, met(asked, "id"), "left_semi").select("dataset", "id", "vec")
    blocks = -(-n * row_bytes(k) // broadcast_bytes)
    found = search.write_run(_dealt(again, blocks), blocks, scratch_dir(spark, "run"))
    return run.join(short, met(run, "query_id"), "left_anti").unionByName(found)


def _ranked(lists: pa.Table, query: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ranked ``k`` best hits of each query; ``query`` numbers the queries of the rows, ascending."""
    ids, values = (lists.column(c).combine_chunks().flatten() for c in ("ids", "scores"))
    rows = np.repeat(np.arange(lists.num_rows), pc.list_value_length(lists.column("ids")).to_numpy())
    values = values.to_numpy(zero_copy_only=False)
    kinds = ids.dictionary_encode()
    code = np.empty(len(kinds.dictionary) + 1, dtype=np.int64)
    code[pc.sort_indices(kinds.dictionary).to_numpy()] = np.arange(len(kinds.dictionary))
    code[-1] = -1  # NULL comes first
    order = np.lexsort((code[kinds.indices.fill_null(-1).to_numpy()], -values, query[rows]))
    place = _place(query[rows[order]])
    keep, rank = order[place < k], place[place < k] + 1
    at = pa.array(rows[keep])
    yield from pa.table([*(lists.column(c).combine_chunks().take(at) for c in _QUERY), ids.take(pa.array(keep)),
                         pa.array(values[keep]), pa.array(rank.astype(np.int32))],
                        names=[*_QUERY, "corpus_id", "score", "rank"]).to_batches(10_000)


def rank_lists(lists: DataFrame, k: int) -> DataFrame:
    """:func:`rank_hits` of the tasks' lists: the rows of a query meet by one exchange and are merged as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of the last query: it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            new = np.zeros(table.num_rows, dtype=bool)
            for c in _QUERY:
                codes = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            query = np.cumsum(new)
            last = int(np.searchsorted(query, query[-1]))
            if last:
                yield from _ranked(table.slice(0, last), query[:last], k)
            held = [table.slice(last)]
        for table in held:
            yield from _ranked(table, np.zeros(table.num_rows, dtype=np.int64), k)

    return lists.repartition(*_QUERY).sortWithinPartitions(*_QUERY).mapInArrow(run, _RUN)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Rank hits by score, then id, and keep the best ``k`` per query."""
    order = Window.partitionBy("dataset", "score_fn", "query_id").orderBy(
        F.desc("score"), F.asc("corpus_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
