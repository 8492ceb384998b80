"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled training rows: the ``EXAMPLES`` first by a hash of doc_id, as far as
their texts have ``EXAMPLE_BYTES`` together. All their words are indexed. A word's inverse document frequency is
counted over all documents; it is multiplied by the word's weight, the root of its association with the label
(G squared over the examples) plus ``LEAST_WEIGHT``, so that no word is left out. The index holds, for
every word, postings in blocks of examples with the block's greatest weight. The blocks of greatest upper bound of the
cosine are visited first; their k-th cosine closes every block with a lower bound, and
one sweep takes the span of the open ones. Ties go by example id, so the ``NEIGHBOURS``
nearest are those of full comparison. Votes weigh 1 / (distance + 0.05); their share of toxic ones is
calibrated by Platt scaling on the examples themselves, each left out of its own vote.

A document without any word of the examples is equally far from all of them: its vote is that of the
examples without a word (evidence empty), and a text with no word scores alike.

Defined results: NULL text is empty. A NULL label teaches nothing; of several labels of one document the
greatest counts. Rows that agree in doc_id and text are one example. Without examples every score is 0. Rows are scored
one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.columns import LETTERS, LOWER, KeyTable, SpanHash, flat, row_sums, slices
from pairloom.llm.language import held_out

EXAMPLES = 4096  # bounds of the labelled sample
EXAMPLE_BYTES = 64 << 20
BLOCK = 64
NEIGHBOURS = 16
WAVE = 2  # blocks of the first wave
DENSE = 8  # a word in one of so many examples or more also has a row of weights of all examples
LEAST_WEIGHT = 0.03
SLACK = 1e-9  # more than rounding can move a cosine; bounds this close below the last one are still visited
RESULT = "struct<score:double,vote:double,evidence:array<long>,similarity:array<double>>"


def terms_of(hasher: SpanHash, data: np.ndarray, offsets: np.ndarray):
    """Hashes of words, with their rows."""
    hashes, _, _, first = hasher.words(LOWER[data], offsets, LETTERS)
    return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def association(toxic: np.ndarray, row: np.ndarray, term: np.ndarray, size: int) -> np.ndarray:
    """G squared of every term with the label; ``row``, ``term``: each term of each example once."""
    n, t = len(toxic), float(toxic.sum())
    held = np.bincount(term, minlength=size).astype(float)
    hits = np.bincount(term, toxic[row], size)

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))

    total = (part(hits, held * t / n) + part(held - hits, held * (n - t) / n)
             + part(t - hits, (n - held) * t / n) + part((n - t) - (held - hits), (n - held) * (n - t) / n))
    return np.maximum(2 * total, 0)


def vectors(table: KeyTable, hasher: SpanHash, data, offsets):
    """Sparse counts of a slice: row, term, count, by row and term."""
    hashes, row = terms_of(hasher, data, offsets)
    term = table.find(hashes)
    hit = term >= 0
    size = len(table.keys)
    kinds, count = np.unique(row[hit] * size + term[hit], return_counts=True)
    return kinds // size, kinds % size, count


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and how many documents there are."""

    def run(batches):
        table, hasher = KeyTable(terms), SpanHash()
        held, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            data, offsets = flat(batch.column(0))
            for _, _, part, at in slices(data, offsets):
                held += np.bincount(vectors(table, hasher, part, at)[1], minlength=len(terms) + 1)
        held[-1] = n
        some = np.flatnonzero(held)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i:i + 100_000]), pa.array(held[some[i:i + 100_000]])],
                                             names=["k", "n"])

    rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(terms) + 1, np.int64)
    counts[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts[:-1], int(counts[-1])


def examples(docs: DataFrame, sample: DataFrame) -> list:
    """(doc_id, toxic, hashes, counts of the words) of every row of the sample."""

    def run(batches):
        hasher = SpanHash()
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j, part, at in slices(data, offsets):
                hashes, row = terms_of(hasher, part, at)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])
                                     if len(row) else row)
                count = np.diff(np.append(new, len(row)))
                row, hashes = row[new], hashes[new]
                cuts = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j],
                     pa.ListArray.from_arrays(cuts, pa.array(hashes.view(np.int64))),
                     pa.ListArray.from_arrays(cuts, pa.array(count))], names=["doc_id", "toxic", "terms", "counts"])

    own = docs.join(F.broadcast(sample), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    found = own.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, terms array<long>, counts array<long>")
    rows = [(i, t, tuple(h), tuple(c)) for i, t, h, c in found.toArrow().to_pandas().itertuples(index=False)]
    return sorted(rows, key=lambda r: r[:2] + (r[2],))


class Index:
    """Block-max inverted index over the examples that have a term.

    Examples stand in the order of their heaviest terms, so that a block holds alike ones and its bounds
    are close. Postings lie term by term, each in example order; ``cuts`` says where a block's begin.
    """

    def __init__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.state = state

    @classmethod
    def build(cls, terms, worth, rows, block: int = BLOCK) -> "Index":
        """``rows``: (doc_id, toxic, numbers of terms, counts); ``worth``: weight of each term."""
        bare = [r[1] for r in rows if not len(r[2])]
        full = [r for r in rows if len(r[2])]
        prior = float(np.mean([r[1] for r in rows])) if rows else 0.0
        own = cls({"terms": terms, "worth": worth, "block": block, "prior": prior, "slope": (1.0, 0.0),
                   "bare": (sum(bare) + prior) / (len(bare) + 1) if rows else 0.0})
        weighed = []
        for place, r in enumerate(full):
            t, w = own.weigh(np.asarray(r[2]), np.asarray(r[3]))
            weighed.append((t[np.lexsort((t, -w))][:8].tolist(), place, t, w))
        weighed.sort(key=lambda r: r[:2])
        blocks = -(-len(weighed) // block)
        at = np.repeat(np.arange(len(weighed)), [len(r[2]) for r in weighed]).astype(np.int64)
        term = np.concatenate([*(r[2] for r in weighed), np.zeros(0, np.int64)])
        weight = np.concatenate([*(r[3] for r in weighed), np.zeros(0)])
        order = np.lexsort((at, term))
        at, weight, term = at[order], weight[order], term[order]
        cell = term * max(1, blocks) + at // block
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else cell
        ends = np.arange(len(terms) + 1)
        begin = np.searchsorted(term, ends)
        often = np.flatnonzero(np.diff(begin) * DENSE > len(weighed))
        line = np.full(len(terms), -1)
        line[often] = np.arange(len(often))
        lines = np.zeros((len(often), blocks * block))
        for k, t in enumerate(often):
            lines[k, at[begin[t]:begin[t + 1]]] = weight[begin[t]:begin[t + 1]]
        return cls(own.state | {
            "ids": np.array([r[0] for r in full], np.int64), "toxic": np.array([r[1] for r in full], np.float64),
            "place": np.array([r[1] for r in weighed], np.int64),  # of the examples in the order of the blocks
            "blocks": blocks, "at": at, "weight": weight, "begin": begin, "line": line, "lines": lines,
            # Of each term the blocks that have it, where its postings begin there, and the greatest weight.
            "cell_begin": np.searchsorted(term[heads], ends), "cell_block": cell[heads] % max(1, blocks),
            "cell_post": np.append(heads, len(cell)),
            "peak": np.maximum.reduceat(weight, heads) if len(heads) else weight})

    @property
    def postings(self) -> dict:
        """Of each term that an example has: places and weights."""
        return {t: (self.place[self.at[a:b]], self.weight[a:b])
                for t, (a, b) in enumerate(zip(self.begin[:-1], self.begin[1:])) if a < b}

    def weigh(self, terms, counts):
        w = (1 + np.log(counts)) * self.worth[terms]
        return terms, w / np.sqrt((w * w).sum())

    def cells(self, terms):
        """All cells (term, block) of the terms: which term, which cell."""
        begin = self.cell_begin[terms]
        n = self.cell_begin[terms + 1] - begin
        return np.repeat(np.arange(len(terms)), n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

    def gather(self, which, cell, q, first: int, size: int):
        """Cosines by place from ``first`` on, from the postings of some cells."""
        begin = self.cell_post[cell]
        n = self.cell_post[cell + 1] - begin
        post = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.bincount(self.at[post] - first, self.weight[post] * np.repeat(q[which], n), size)
        return found.astype(np.float64, copy=False)  # counts of nothing are integers

    def sweep(self, terms, q, which, cell, low: int, high: int):
        """Cosines of the examples of blocks ``low`` to ``high`` - 1."""
        first, last = low * self.block, high * self.block
        line = self.line[terms]
        inside = (line[which] < 0) & (self.cell_block[cell] >= low) & (self.cell_block[cell] < high)
        score = self.gather(which[inside], cell[inside], q, first, last - first)
        part = np.empty(last - first)
        for k in np.flatnonzero(line >= 0).tolist():
            np.multiply(self.lines[line[k], first:last], q[k], out=part)
            score += part
        return score

    def better(self, best, some, score, k: int, without: int):
        """The k best of ``best`` and of the examples of blocks ``some``, by cosine and place."""
        found = np.flatnonzero(score >= best[1][-1] - SLACK if len(best[1]) == k else score > 0)
        score = score[found]
        if len(found) > 4 * k:  # the k-th greatest score bounds what can be among the k nearest
            high = np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1] - SLACK)
            found, score = found[high], score[high]
        at = self.place[some[found // self.block] * self.block + found % self.block]
        keep = at != without
        at, score = np.concatenate([best[0], at[keep]]), np.concatenate([best[1], score[keep]])
        order = np.lexsort((at, -np.round(score, 12)))[:k]
        return at[order], score[order]

    def nearest(self, terms, counts, k: int, without: int = -1):
        """Places and cosines of the k nearest examples, the first by id among equals.

        The blocks of greatest bound come first; then those whose bound is not below the k-th cosine.
        """
        terms, q = self.weigh(terms, counts)
        which, cell = self.cells(terms)
        bound = np.bincount(self.cell_block[cell], q[which] * self.peak[cell], self.blocks)
        best = np.zeros(0, np.int64), np.zeros(0)
        some = np.sort(np.argsort(-bound, kind="stable")[:WAVE])
        some = some[bound[some] > 0]
        if not len(some):
            return best
        visited = np.isin(self.cell_block[cell], some)
        score = self.gather(which[visited], cell[visited], q, 0, self.blocks * self.block)
        best = self.better(best, some, score.reshape(-1, self.block)[some].ravel(), k, without)
        bound[some] = 0
        open_ = np.flatnonzero(bound >= best[1][-1] - SLACK if len(best[1]) == k else bound > 0)
        open_ = open_[bound[open_] > 0]
        if not len(open_):
            return best
        low, high = int(open_[0]), int(open_[-1]) + 1
        score = self.sweep(terms, q, which, cell, low, high)
        score.reshape(-1, self.block)[some[(some >= low) & (some < high)] - low] = 0  # visited before
        return self.better(best, np.arange(low, high), score, k, without)

    def vote(self, terms, counts, k: int = NEIGHBOURS, without: int = -1):
        at, cosine = self.nearest(terms, counts, k, without)
        if not len(at):
            return self.bare, at, cosine
        weight = 1 / (1 - np.minimum(cosine, 1) + 0.05)
        return float((weight * self.toxic[at]).sum() / weight.sum()), at, cosine

    def calibrate(self, rows) -> None:
        """Platt scaling of votes on the examples, each without its own."""
        x, y, full = [], [], -1
        for _, label, terms, counts in rows:
            if len(terms):
                full += 1
                x.append(self.vote(np.array(terms), np.array(counts), without=full)[0])
            else:
                x.append(self.bare)
            y.append(label)
        x, y = np.array(x), np.array(y, float)
        if not len(x):
            return
        # Targets off 0 and 1 keep the slope finite when the votes separate the labels.
        hot = y.sum()
        target = np.where(y > 0, (hot + 1) / (hot + 2), 1 / (len(y) - hot + 2))
        a, b = 4.0, -2.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a - step[0], b - step[1]
        if a < 0:  # votes that say nothing leave the share of toxic examples
            a, b = 0.0, float(np.log(target.mean() / (1 - target.mean())))
        self.slope = self.state["slope"] = (a, b)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope[0] * vote + self.slope[1])))) if self.prior > 0 else 0.0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = EXAMPLES,
          most_bytes: int = EXAMPLE_BYTES) -> Index:
    """The index over a bounded sample; ``labels`` (doc_id, label) are training rows only."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))
    narrow = texts.select("doc_id", "digest", F.octet_length("text").alias("n")).distinct().join(own, "doc_id")
    first = narrow.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(limit).collect()
    spent = np.cumsum([r["n"] for r in first])
    rows = [(r["doc_id"], r["digest"], r["toxic"]) for r, n in zip(first, spent) if n <= most_bytes]
    sample = docs.sparkSession.createDataFrame(rows, "doc_id long, digest long, toxic int")
    found = examples(texts, sample)
    sizes = [len(r[2]) for r in found]
    hashes = np.concatenate([*(np.array(r[2], np.int64) for r in found), np.zeros(0, np.int64)])
    terms, term = np.unique(hashes.view(np.uint64), return_inverse=True)
    toxic = np.array([r[1] for r in found], float)
    row = np.repeat(np.arange(len(found)), sizes)
    counts, n = document_counts(texts, terms) if len(terms) else (np.zeros(0, np.int64), 0)
    idf = np.log((n + 1) / (counts + 1)) + 1
    g2 = association(toxic, row, term, len(terms)) if len(terms) else np.zeros(0)
    cuts = np.cumsum(sizes)[:-1] if sizes else []
    found = [(r[0], r[1], t, np.array(r[3])) for r, t in zip(found, np.split(term, cuts))]
    index = Index.build(terms, idf * (np.sqrt(g2) + LEAST_WEIGHT), found)
    index.calibrate(found)
    return index


def score(index: Index, text: Column, spark) -> Column:
    """Struct of score, raw vote and the nearest examples with their cosines."""
    shared = spark.sparkContext.broadcast(index.state)  # plain arrays, so that executors need no package

    def run(column: pa.Array) -> pa.Array:
        own = Index(shared.value)
        table, hasher, seen = KeyTable(own.terms), SpanHash(), {}
        bare = (own.score(own.bare), own.bare, [], [])
        out = [bare] * len(column)
        data, offsets = flat(column)
        for i, j, part, at in slices(data, offsets) if len(own.terms) else ():
            row, term, count = vectors(table, hasher, part, at)
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            for r in np.flatnonzero(np.diff(cuts)):
                t, c = term[cuts[r]:cuts[r + 1]], count[cuts[r]:cuts[r + 1]]
                key = (t.tobytes(), c.tobytes())
                if key not in seen:
                    vote, near, cosine = own.vote(t, c)
                    seen[key] = (own.score(vote), vote, own.ids[near].tolist(), cosine.tolist())
                out[i + r] = seen[key]
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=["score", "vote", "evidence", "similarity"])

    return F.arrow_udf(run, RESULT)(text)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    index = train(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    found = score(index, F.col("text"), docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.score", F.when(F.col("f.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "f.evidence")
