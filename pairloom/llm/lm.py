"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

The model reads subword ids (an end id closes every text). One causal attention head asks with the
embedding of the id before the target and looks at the ids before earlier places (content) and at the
distance (a learned bias); its weights copy the ids that stood at those places. A learned gate mixes that
distribution with bigram and unigram statistics of all training texts, so the result is a distribution
over all ids. Texts are read in overlapping windows of 64 ids: the last 32 are targets, each id is a
target once, and the windows of a batch go through one masked attention.

Training: every task takes gradient steps (Adagrad) on all windows of its training texts, from the same
start; the parameters are averaged with the windows as weights, in rounds of bounded width. In training a target's
own occurrence doesn't count among the bigrams. Bigrams, unigrams and word counts cover all training texts.
What goes to the tasks is bounded: ``MAX_PAIRS`` most frequent bigrams, ``ROWS`` embedding rows (rare ids share
by hash), ``TOP_WORDS`` words that the base score looks up in place; the counts of all other bigrams and words
meet their documents in a join.

Defined results: NULL text is empty: one end token, and its base score and score are those of the end alone.
A NULL doc_id is held out. Rows that agree in doc_id and text give equal rows. Without training rows
counts are 0 and the score is uniform over the ids.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.columns import LOWER, NO_BLANKS, U64, KeyTable, SpanHash, flat, mix, slices
from pairloom.llm.language import held_out, most_frequent
from pairloom.llm.subwords import Subwords, default_path
from pairloom.llm.suffixes import KEY
from pairloom.session import materialize

VOCABULARY = 49_408
BEGIN, END = 49_406, 49_407
TARGETS, CONTEXT = 32, 32
WIDTH = 16  # of embeddings
OWN_ROWS, ROWS = 4096, 5120
MAX_PAIRS = 1 << 20  # looked up in place; the others come by a join
TOP_WORDS = 300_000
BATCH = 128  # windows
RATE = 0.1
DISCOUNT = 0.75
END_WORD = 0x0A0A0A0A0A0A0A0A  # stands for the end token among word hashes
AVERAGED = 32  # models averaged at once


def ids_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Row key, doc_id, held_out and ids (with the end) of every document."""

    def run(batches):
        coder = Subwords(tokenizer)
        for batch in batches:
            data, offsets = flat(batch.column(5))
            for i, j, part, at in slices(data, offsets, 1 << 19):
                ids, first = coder.ids(part, at)
                ids = np.insert(ids, first[1:], END).astype(np.int32)
                cuts = pa.array((first + np.arange(len(first))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[i:j] for k in range(5)), pa.ListArray.from_arrays(cuts, pa.array(ids))],
                    names=[*KEY, "doc_id", "held_out", "ids"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*row_key(text), F.col("doc_id").cast("long"),
                       held_out(F.col("doc_id"), 7, 2).alias("held_out"), text.alias("text"))
    return rows.mapInArrow(run, "k0 long, k1 long, k2 long, doc_id long, held_out boolean, ids array<int>")


def row_key(text):
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k0"),
            F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def _counted(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _counter(keys_of):
    """A function on batches that counts the keys (64-bit) of a task and sends each once."""

    def run(batches):
        state, held = {}, []
        for batch in batches:
            for keys in keys_of(batch, state):
                held.append(np.unique(keys, return_counts=True))
                if len(held) > 8:
                    held = [_counted(held)]
        keys, n = _counted(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[i:i + 100_000].view(np.int64)), pa.array(n[i:i + 100_000].astype(np.int64))],
                names=["key", "n"])

    return run


def _lists(column, limit: int = 1 << 18):
    """(first row, last row + 1, ids, offsets) of consecutive rows of about ``limit`` ids."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, j, values[ends[i]:ends[j]].astype(np.int64), ends[i:j + 1] - ends[i]
        i = j


def _before(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = BEGIN  # every text has its end id, so no row is empty
    return before


def pair_counts(train: DataFrame) -> DataFrame:
    def keys_of(batch, _):
        for _, _, ids, at in _lists(batch.column(0), 1 << 20):
            yield _before(ids, at) * VOCABULARY + ids

    found = train.select("ids").mapInArrow(_counter(keys_of), "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    def keys_of(batch, state):
        hasher = state.setdefault("hasher", SpanHash())
        data, offsets = flat(batch.column(0))
        for i, j, part, at in slices(data, offsets):
            hashes = hasher.words(LOWER[part], at, NO_BLANKS)[0]
            yield np.concatenate([hashes, np.full(j - i, END_WORD, U64)])

    found = docs.select("text").mapInArrow(_counter(keys_of), "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def statistics(pairs: DataFrame, max_pairs: int = MAX_PAIRS) -> dict:
    """Unigram and bigram probabilities; what the discount takes from all bigrams goes by the unigrams."""
    ends = pairs.groupBy(F.expr(f"key % {VOCABULARY}").alias("id")).agg(F.sum("n").alias("n")).toPandas()
    begins = pairs.groupBy(F.expr(f"key div {VOCABULARY}").alias("id")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toPandas()
    kept = most_frequent(pairs, max_pairs).toPandas().sort_values("key")
    one = np.full(VOCABULARY, 0.1)
    one[ends["id"]] += ends["n"]
    one /= one.sum()
    total, kinds = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    total[begins["id"]], kinds[begins["id"]] = begins["n"], begins["kinds"]
    key, n = kept["key"].to_numpy(np.int64), kept["n"].to_numpy(float) - DISCOUNT
    rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    share = n / total[key // VOCABULARY] if len(key) else n
    order = np.argsort(-one, kind="stable")[:OWN_ROWS]
    rows = OWN_ROWS + (mix(np.arange(VOCABULARY).astype(U64)) % U64(ROWS - OWN_ROWS)).astype(np.int64)
    rows[order] = np.arange(OWN_ROWS)
    return {"one": one, "rest": rest, "pairs": key, "share": share.astype(np.float32), "rows": rows,
            "total": total}


class Bigrams:
    def __init__(self, s: dict) -> None:
        self.s, self.table = s, KeyTable(s["pairs"].view(U64))
        self.share = s["share"] if len(s["share"]) else np.zeros(1, np.float32)

    def of(self, before: np.ndarray, ids: np.ndarray, row=None, rare=None, own: int = 0) -> np.ndarray:
        """Probabilities; ``rare``: sorted (row, key) in one number and n of pairs beyond the table.

        ``own`` occurrences of each pair are not counted.
        """
        key = before * VOCABULARY + ids
        at = self.table.find(key.view(U64))
        share, total = np.where(at >= 0, self.share[at], 0), np.maximum(self.s["total"][before], 1)
        if rare is not None and len(rare[0]):
            miss = np.flatnonzero(at < 0)
            wanted = row[miss] << 32 | key[miss]
            place = np.minimum(np.searchsorted(rare[0], wanted), len(rare[0]) - 1)
            hit = rare[0][place] == wanted
            share[miss[hit]] = (rare[1][place[hit]] - DISCOUNT) / total[miss[hit]]
        if own:
            share = np.maximum(share - own / total, 0)
        return share + self.s["rest"][before] * self.s["one"][ids]


def with_rare(ids: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """``ids`` with rare_keys and rare_n: each row's pairs that the table in ``shared`` doesn't hold."""

    def run(batches):
        table = KeyTable(shared.value["pairs"].view(U64))
        for batch in batches:
            for low, high, own, at in _lists(batch.column(3)):
                key = _before(own, at) * VOCABULARY + own
                row = np.repeat(np.arange(high - low), np.diff(at))
                miss = table.find(key.view(U64)) < 0
                found = np.unique(row[miss] << 32 | key[miss])
                rows = pa.array((found >> 32) + low)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(3)), pa.array(found & 0xFFFFFFFF)], names=[*KEY, "key"])

    wanted = ids.select(*KEY, "ids").mapInArrow(run, "k0 long, k1 long, k2 long, key long")
    met = wanted.join(pairs, "key").groupBy(*KEY).agg(F.collect_set(F.struct("key", "n")).alias("rare"))
    met = materialize(met.select(*KEY, F.col("rare.key").alias("rare_keys"), F.col("rare.n").alias("rare_n")), "lm-rare")
    none = F.array().cast("array<long>")
    return ids.join(met, KEY, "left").withColumns({c: F.coalesce(c, none) for c in ("rare_keys", "rare_n")})


def _rare(keys, n, low: int, high: int):
    """Pairs beyond the table of rows ``low`` to ``high`` - 1, as ``Bigrams.of`` reads them."""
    cuts = keys.offsets.to_numpy().astype(np.int64)[low:high + 1]
    row = np.repeat(np.arange(high - low), np.diff(cuts))
    found = row << 32 | keys.values.to_numpy()[cuts[0]:cuts[-1]]
    order = np.argsort(found)
    at = n.offsets.to_numpy().astype(np.int64)[low]
    return found[order], n.values.to_numpy()[at:at + len(found)][order]


def start() -> dict:
    draw = np.random.default_rng(11)
    embedding = draw.normal(0, 0.5, (ROWS, WIDTH)).astype(np.float32)
    return {"ask": embedding.copy(), "key": embedding.copy(), "gate": np.full(ROWS, -1.0, np.float32),
            "far": np.zeros(TARGETS + CONTEXT, np.float32)}


def windows(at: np.ndarray):
    """For every block of targets: its row's first id, its first target, and the row's end."""
    blocks = -(-np.diff(at) // TARGETS)
    row = np.repeat(np.arange(len(blocks)), blocks)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return at[row], at[row] + turn * TARGETS, at[row + 1]


DISTANCE = CONTEXT + np.arange(TARGETS)[:, None] - np.arange(TARGETS + CONTEXT)[None, :]
FAR = np.clip(DISTANCE, 0, None)
LIMIT = np.float32(60)  # of what goes into exp: far above any trained weight, below overflow
ONES = np.ones(TARGETS + CONTEXT, np.float32)


class Room:
    """Arrays in which one batch works after the other; the system would clear new ones page by page."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


def forward(p: dict, ids, before, rows, bigram, first, begin, end, room: Room | None = None):
    """Masked attention of a batch of windows; probabilities of the targets and what backward needs.

    The context of a window is in its text as a whole or, where the text begins with the window, not at all.
    Places beyond the text's end come after its last target. What backward needs lasts until ``room`` is used again.
    """
    room, n = room or Room(), len(begin)
    place = begin[:, None] + np.arange(-CONTEXT, TARGETS)
    target = np.minimum(place[:, CONTEXT:], len(ids) - 1)
    live = place[:, CONTEXT:] < end[:, None]
    r_key = rows.take(before.take(place, mode="clip"))
    r_ask = np.ascontiguousarray(r_key[:, CONTEXT:])
    ask = p["ask"].take(r_ask, axis=0, mode="clip", out=room.of("ask", n, TARGETS, WIDTH))
    key = p["key"].take(r_key, axis=0, mode="clip", out=room.of("key", n, CONTEXT + TARGETS, WIDTH))
    far = np.where(DISTANCE > 0, p["far"][FAR], np.float32(-1e9))  # causal
    weight, same = (room.of(name, n, TARGETS, CONTEXT + TARGETS) for name in ("weight", "same"))
    total = _attend(weight, ask, key, far, begin == first)
    there = ids.take(place, mode="clip").astype(np.uint16)
    np.equal(there[:, None, :], there[:, CONTEXT:, None], out=same, casting="unsafe")
    some = total > 0
    total[~some] = 1
    copied = np.vecdot(weight, same) / total
    gate = np.where(some, 1 / (1 + np.exp(-p["gate"][r_ask])), 0)
    likely = bigram[target]
    return gate * copied + (1 - gate) * likely, live, target, (
        room, weight, same, total, copied, gate, likely, ask, key, r_ask, r_key, begin)


def _attend(weight, ask, key, far, opening) -> np.ndarray:
    """Puts the attention of targets to places into ``weight``, not yet divided by the sums that it returns."""
    for limited in (False, True):
        np.matmul(ask, key.transpose(0, 2, 1), out=weight)
        weight += far
        if limited:
            np.minimum(weight, LIMIT, out=weight)
        with np.errstate(over="ignore"):
            np.exp(weight, out=weight)
            weight[opening, :, :CONTEXT] = 0
            total = np.matmul(weight, ONES)
        if total.max() < 1e26:  # else some weight may be above LIMIT
            break
    return total


def backward(p: dict, memory: dict, prob, live, held) -> None:
    """One Adagrad step for the mean negative log probability of the live targets.

    A row that no window of the batch looks at has no gradient and stays as it is.
    """
    room, weight, same, total, copied, gate, likely, ask, key, r_ask, r_key, begin = held
    scale = np.where(live, 1 / np.maximum(prob, 1e-12), 0) / max(1, live.sum())
    d_gate = -(copied - likely) * scale * gate * (1 - gate)
    # The gradient of a logit is lean * weight * (same - copied); lean is of the target alone.
    lean = (-(gate * scale) / total).astype(np.float32)
    d = same
    d -= copied[:, :, None]
    d *= weight
    d_far = np.matmul(lean.T[:, None, :], d.transpose(1, 0, 2))[:, 0]
    d_ask = np.matmul(d, key, out=room.of("d_ask", *ask.shape))
    d_ask *= lean[:, :, None]
    ask *= lean[:, :, None]
    d_key = np.matmul(d.transpose(0, 2, 1), ask, out=room.of("d_key", *key.shape))
    # The context of a window mostly is the block before it: then both bring their gradients by the same places.
    alone = np.concatenate([[True], begin[1:] != begin[:-1] + TARGETS])
    own, ahead = d_key[:, CONTEXT:], d_key[:, :CONTEXT]
    others = ahead[alone]
    ahead[alone] = 0
    own[:-1] += ahead[1:]
    seen = np.concatenate([r_ask.ravel(), r_key[alone, :CONTEXT].ravel()])
    touched = np.flatnonzero(np.bincount(seen, minlength=ROWS))
    at = np.empty(ROWS, np.intp)
    at[touched] = np.arange(len(touched))
    at = at[seen]

    def table(*grads) -> np.ndarray:
        """Sums of the gradients of the places in ``seen`` by row."""
        flat_grads = [g.reshape(-1, g.shape[-1]) for g in grads]
        sizes = [len(g) for g in flat_grads]
        columns = room.of("columns", flat_grads[0].shape[1], sum(sizes), kind=np.float64)
        for g, end in zip(flat_grads, np.cumsum(sizes)):
            columns[:, end - len(g):end] = g.T
        return np.stack([np.bincount(at[:sum(sizes)], g, len(touched)) for g in columns], axis=1)

    d_far = np.bincount(FAR.ravel(), d_far.ravel(), TARGETS + CONTEXT)
    for name, where, g in (("ask", touched, table(d_ask)), ("key", touched, table(own, others)),
                           ("gate", touched, table(d_gate[:, :, None])[:, 0]), ("far", slice(None), d_far)):
        sums = g * g
        sums += memory[name][where]
        memory[name][where] = sums
        sums += 1e-10
        p[name][where] -= RATE * g.astype(np.float32) / np.sqrt(sums.astype(np.float32))


def learn(p: dict, memory: dict, s: dict, grams: Bigrams, batch) -> int:
    """Steps on all windows of a batch (ids, rare_keys, rare_n); how many windows there were."""
    n, room = 0, Room()
    for low, high, ids, at in _lists(batch.column(0)):
        before, row = _before(ids, at), np.repeat(np.arange(high - low), np.diff(at))
        bigram = grams.of(before, ids, row, _rare(batch.column(1), batch.column(2), low, high), own=1)
        first, begin, end = windows(at)
        for i in range(0, len(first), BATCH):
            prob, live, _, held = forward(p, ids, before, s["rows"], bigram, first[i:i + BATCH],
                                          begin[i:i + BATCH], end[i:i + BATCH], room)
            backward(p, memory, prob, live, held)
            n += len(first[i:i + BATCH])
    return n


def fit(train: DataFrame, shared) -> dict:
    """Parameters averaged over the tasks' own trainings."""

    def run(batches):
        s = shared.value
        grams, p = Bigrams(s), start()
        memory, n = {k: np.zeros(v.shape) for k, v in p.items()}, 0
        for batch in batches:
            n += learn(p, memory, s, grams, batch)
        if n:
            yield _model([(n, p)])

    def average(batches):
        held = [pickle.loads(raw) for batch in batches for raw in batch.column(1).to_pylist()]
        if held:
            yield _model(held)

    schema = "n long, model binary"
    models = materialize(train.select("ids", "rare_keys", "rare_n").mapInArrow(run, schema), "lm-models")
    while (count := models.count()) > AVERAGED:
        dealt = models.repartition(-(-count // AVERAGED))
        models = materialize(dealt.mapInArrow(average, schema), "lm-models")
    held = [pickle.loads(r["model"]) for r in models.collect()]
    return _mean(held)[1] if held else start()


def _mean(held: list) -> tuple[int, dict]:
    n = sum(k for k, _ in held)
    return n, {name: sum(p[name] * np.float32(k / n) for k, p in held) for name in held[0][1]}


def _model(held: list) -> pa.RecordBatch:
    n, p = _mean(held)
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([pickle.dumps((n, p))], pa.binary())],
                                      names=["n", "model"])


def scored(ids: DataFrame, shared) -> DataFrame:
    """Row key, doc_id, held_out and score (log10 probability) of every row of ids."""

    def run(batches):
        s, p = shared.value
        grams, room = Bigrams(s), Room()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for low, high, own, at in _lists(batch.column(5)):
                before = _before(own, at)
                row = np.repeat(np.arange(high - low), np.diff(at))
                bigram = grams.of(before, own, row, _rare(batch.column(6), batch.column(7), low, high))
                logs = np.zeros(len(own))
                first, begin, end = windows(at)
                for i in range(0, len(first), BATCH):
                    prob, live, target, _ = forward(p, own, before, s["rows"], bigram, first[i:i + BATCH],
                                                    begin[i:i + BATCH], end[i:i + BATCH], room)
                    logs[target[live]] = np.log10(prob[live])
                out[low:high] = np.add.reduceat(logs, at[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(out)],
                                             names=[*KEY, "doc_id", "held_out", "score"])

    return ids.select(*KEY, "doc_id", "held_out", "ids", "rare_keys", "rare_n").mapInArrow(
        run, "k0 long, k1 long, k2 long, doc_id long, held_out boolean, score double")


def base_scores(docs: DataFrame, counts: DataFrame, tokens: int, kinds: int, top_words: int = TOP_WORDS) -> DataFrame:
    """Row key, n_tokens, n_known, base_score: add-one word statistics of the training texts."""
    top = most_frequent(counts, top_words).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(
        (top["key"].to_numpy(np.int64).view(U64), top["n"].to_numpy(np.int64)))
    whole = float(tokens + kinds + 1)

    def run(batches):
        hasher = SpanHash()
        keys, n = shared.value
        table = KeyTable(keys)
        n = n if len(n) else np.zeros(1, np.int64)
        cost = np.log10((n + 1) / whole)
        for batch in batches:
            own = np.stack([batch.column(k).to_numpy() for k in range(3)])
            data, offsets = flat(batch.column(3))
            for i, j, part, at in slices(data, offsets):
                hashes, _, _, first = hasher.words(LOWER[part], at, NO_BLANKS)
                row = np.concatenate([np.repeat(np.arange(j - i), np.diff(first)), np.arange(j - i)])
                hashes = np.concatenate([hashes, np.full(j - i, END_WORD, U64)])
                place = table.find(hashes)
                hit = place >= 0
                words = np.bincount(row, minlength=j - i)
                known = np.bincount(row[hit], minlength=j - i)
                base = np.bincount(row[hit], cost[place[hit]], j - i)
                order = np.lexsort((hashes[~hit], row[~hit]))
                r, h = row[~hit][order], hashes[~hit][order]
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else r
                times = np.diff(np.append(new, len(r)))
                r, h = r[new], h[new]
                m = j - i
                rows = np.concatenate([np.arange(m), r]) + i
                name = mix((own[1, i:j] ^ own[0, i:j]).view(U64))  # spreads the rows that bring the sums
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(own[k][rows]) for k in range(3)),
                     pa.array(np.concatenate([name, h]).view(np.int64)),
                     pa.array(np.concatenate([np.ones(m, np.int64), np.zeros(len(r), np.int64)])),
                     pa.array(np.concatenate([words, np.zeros(len(r), np.int64)])),
                     pa.array(np.concatenate([known, times]).astype(np.int64)),
                     pa.array(np.concatenate([base, np.zeros(len(r))]))],
                    names=[*KEY, "key", "own", "words", "known", "base"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*row_key(text), text.alias("text")).mapInArrow(
        run, "k0 long, k1 long, k2 long, key long, own long, words long, known long, base double")
    met = rows.join(counts.withColumnRenamed("n", "c"), "key", "left")
    rare, c = F.col("own") == 0, F.coalesce("c", F.lit(0))
    known = F.when(rare, F.when(c > 0, F.col("known")).otherwise(0)).otherwise(F.col("known"))
    base = F.when(rare, F.col("known") * F.log10((c + 1) / F.lit(whole))).otherwise(F.col("base"))
    sums = met.groupBy(*KEY).agg(F.sum("words").alias("w"), F.sum(known).alias("k"), F.sum(base).alias("b"),
                                 F.sum("own").alias("times"))  # rows that repeat bring everything again
    return sums.select(*KEY, F.expr("w div times").alias("n_tokens"), F.expr("k div times").alias("n_known"),
                       (F.col("b") / F.col("times")).alias("base_score"))


def score_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    ids = materialize(ids_of(docs, tokenizer or default_path()), "lm-ids")
    pairs = materialize(pair_counts(ids.filter("NOT held_out")), "lm-pairs")
    s = statistics(pairs)
    shared = spark.sparkContext.broadcast(s)
    ids = with_rare(ids, pairs, shared)
    model = fit(ids.filter("NOT held_out"), shared)
    counts = materialize(word_counts(docs.filter(~held_out(F.col("doc_id"), 7, 2))), "lm-words")
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    base = base_scores(docs, counts, tokens, kinds)
    found = scored(ids, spark.sparkContext.broadcast((s, model)))
    return found.join(base, KEY).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score", "score")
