"""Removal of repeated byte strings with a distributed, common-prefix-aware suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Instead of all
suffixes only those at anchors are sorted: the anchor of a string of ``LENGTH`` bytes is the place of
its least hashed ``GRAM``-byte gram (the first of equals), which depends on the string alone, so equal
strings have their anchors at equal distances and every string is met at its anchor.

1. Anchors whose gram occurs once in the corpus are dropped; grams are counted by hash, after each
   task has joined what it knows.
2. Tasks sort the remaining suffixes and front-code the runs: each suffix is sent as the length of the
   prefix it shares with the one before it and the rest. Runs are exchanged by gram, so equal suffixes meet.
3. A loser tree merges the runs and compares from the known common prefix on, never before it; it yields
   the common prefix of neighbours, which cuts the merged suffixes into groups of one gram. In a group,
   strings of LENGTH bytes around the anchor that occur twice are marked.

Hot grams (more than ``hot`` places in one task's portion) would make one long group. Their strings are
hashed and counted one by one instead, also after each task has joined what it knows, so a passage
that stands in a third of all documents is dealt over all tasks. Equal documents count as one
document with a mark, by a 128-bit digest on narrow rows.

Defined results: NULL text is empty. Matches never cross documents; texts below LENGTH bytes lose nothing.
Rows with equal doc_id and text are two places of the same strings. A NULL doc_id is as good as any other.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.columns import SMALL_SLICE, U64, SpanHash, bound_batches, flat, mix, slices
from pairloom.session import materialize

LENGTH = 200
GRAM = 64
PORTION = 600_000  # anchors a task holds before it deals them out
RUN = 40_000  # suffixes of a sorted run
HOT = 64
BATCH = 10_000  # suffixes whose strings are compared at once
KEY = ["k0", "k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """Key of the row's content and doc_id, and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k0"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys, from prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(hasher: SpanHash, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of every anchor: gram hash, row, place in the row, least and greatest distance to a string's start."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() < length:
        return np.zeros(0, U64), none, none, none, none
    sums = hasher.prefix(data)
    at = np.arange(len(data) - gram + 1)
    hashes = hasher.of(sums, at, at + gram)
    order = (hashes >> U64(32) << U64(32)) | at.astype(U64)
    least = sliding_least(order, length - gram + 1)
    room = np.repeat(offsets[1:], sizes)[:len(least)] - np.arange(len(least)) >= length
    start = np.flatnonzero(room)
    anchor = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    place = anchor[first]
    row = np.searchsorted(offsets, place, "right") - 1
    return hashes[place], row, place - offsets[row], place - start[last], place - start[first]


def _repeated(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (last is first), and for each ordered row the size of its group."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    return order, np.repeat(size, size)


def _dealt(kind: int, part: np.ndarray, *columns: np.ndarray):
    """(part, kind, blob) of the rows of each part."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(part[order[a]]), kind, _pack(*[c[order[a:b]] for c in columns])


def _rows(found: list) -> pa.RecordBatch:
    part, kind, blob = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
        names=["part", "kind", "blob"])


BLOBS = "part int, kind int, blob binary"


def shared_anchors(rows: DataFrame, parts: int, length: int, gram: int, hot: int) -> DataFrame:
    """Key of the document and ``a`` (place, distances, hot) of anchors whose gram occurs again."""

    def deal(held):
        keys, h, doc, place, near, far = held
        order, size = _repeated(place, keys[2][doc], keys[1][doc], h)
        order = order[np.concatenate([[True], ~(
            (np.diff(h[order]) == 0) & (np.diff(keys[1][doc][order]) == 0) & (np.diff(keys[2][doc][order]) == 0)
            & (np.diff(place[order]) == 0))])]  # equal documents count once
        h, doc, place, near, far = h[order], doc[order], place[order], near[order], far[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(begin, len(h)))
        many = np.repeat(size > hot, size)
        # 0: to be counted, 1: known to be hot and dealt out at random, 2: tells that a gram is hot.
        state = many.astype(np.uint8)
        part = np.where(many, mix(h + (np.arange(len(h)) >> 6).astype(U64)), mix(h)) % U64(parts)
        tell = begin[size > hot]
        columns = [np.concatenate([c, c[tell]]) for c in (h, keys[0][doc], keys[1][doc], keys[2][doc],
                                                          place.astype(np.int64), near.astype(np.uint8), far.astype(np.uint8))]
        state = np.concatenate([state, np.full(len(tell), 2, np.uint8)])
        part = np.concatenate([part, mix(h[tell]) % U64(parts)]).astype(np.int64)
        yield _rows(list(_dealt(0, part, *columns, state)))

    def spread(batches):
        hasher, held, n = SpanHash(), [], 0
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            data, offsets = flat(batch.column(3))
            for i, _, part, at in slices(data, offsets, SMALL_SLICE):
                h, row, *rest = anchors(hasher, part, at, length, gram)
                held.append((h, *[k[i + row] for k in keys], *rest))
                n += len(h)
                if n >= PORTION:
                    yield from deal(_join(held))
                    held, n = [], 0
        if n:
            yield from deal(_join(held))

    def _join(held):
        h, k0, k1, k2, place, near, far = (np.concatenate(c) for c in zip(*held))
        return (k0, k1, k2), h, np.arange(len(h)), place, near, far

    def count(batches):
        held = [_unpack(raw) for batch in batches for raw in batch.column(2).to_pylist()]
        if not held:
            return
        h, k0, k1, k2, place, near, far, state = (np.concatenate(c) for c in zip(*held))
        told = np.unique(h[state == 2])
        is_hot = (state == 1) | np.isin(h, told)
        use = np.flatnonzero(state < 2)
        order = use[np.lexsort((k0[use], place[use], k2[use], k1[use], h[use]))]
        same = np.zeros(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            same[1:] = (h[a] == h[b]) & (k1[a] == k1[b]) & (k2[a] == k2[b]) & (place[a] == place[b])
        order = order[~same]  # of equal documents the first
        begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(order) else order
        size = np.diff(np.append(begin, len(order)))
        keep = order[(np.repeat(size, size) > 1) | is_hot[order]]
        packed = (place[keep] << 17) | (near[keep].astype(np.int64) << 9) | (far[keep].astype(np.int64) << 1) | is_hot[keep]
        for i in range(0, len(keep), 50_000):
            own = keep[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k0[own]), pa.array(k1[own]), pa.array(k2[own]), pa.array(packed[i:i + 50_000])],
                names=[*KEY, "a"])

    dealt = rows.mapInArrow(spread, BLOBS).repartition(parts, "part")
    return dealt.mapInArrow(count, "k0 long, k1 long, k2 long, a long")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while a[known:known + 16] == b[known:known + 16]:
        known += 16
    while a[known] == b[known]:
        known += 1
    return known


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefixes with the suffix before, lengths and bytes of the rests, of sorted suffixes."""
    shared = np.zeros(len(suffixes), np.uint8)
    for k in range(1, len(suffixes)):
        shared[k] = common_prefix(suffixes[k - 1], suffixes[k], 0)
    rests = [s[c:] for s, c in zip(suffixes, shared.tolist())]
    return shared, np.array([len(r) for r in rests], np.uint8), b"".join(rests)


def decode(shared, sizes, rests):
    """(suffix, common prefix with the one before) of a front-coded run."""
    at, before = 0, b""
    for common, size in zip(shared.tolist(), sizes.tolist()):
        before = before[:common] + rests[at:at + size]
        at += size
        yield before, common


class LoserTree:
    """Merges front-coded runs; yields (run, place in the run, suffix, common prefix with the last one).

    Every head knows its common prefix with the last suffix that came out. Of two heads the one with
    the longer is the smaller one; only equally long ones are compared, from there on.
    """

    def __init__(self, runs) -> None:
        self.streams = [decode(*run) for run in runs]
        self.width = max(1, 1 << (len(runs) - 1).bit_length())
        self.heads: list = [next(s, None) for s in self.streams]
        self.heads += [None] * (self.width - len(runs))
        self.heads = [(h[0], 0) if h else None for h in self.heads]
        self.losers = [0] * self.width
        self.place = [0] * self.width
        self.winner = self._play(1) if self.width > 1 else 0

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = self._match(a, b)
        self.losers[node] = lose
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[1] != y[1]:
            return (a, b) if x[1] > y[1] else (b, a)
        s, t = x[0], y[0]
        common = common_prefix(s, t, x[1])
        if s[common:common + 1] < t[common:common + 1] or (s[common:common + 1] == t[common:common + 1] and a < b):
            self.heads[b] = (t, common)
            return a, b
        self.heads[a] = (s, common)
        return b, a

    def __iter__(self):
        heads, losers, match, place = self.heads, self.losers, self._match, self.place
        while heads[self.winner] is not None:
            run = self.winner
            suffix, common = heads[run]
            yield run, place[run], suffix, common
            place[run] += 1
            heads[run] = next(self.streams[run], None)
            node = (run + self.width) >> 1
            while node:
                run, losers[node] = match(run, losers[node])
                node >>= 1
            self.winner = run


def _marks(flags: np.ndarray, begin: np.ndarray, place: np.ndarray):
    """Runs of flags inside the stretches that start at ``begin``: stretch, first and last flag's place."""
    before = np.concatenate([[False], flags[:-1]])
    before[begin] = False
    after = np.concatenate([flags[1:], [False]])
    after[begin[1:] - 1] = False
    low, high = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    return np.searchsorted(begin, low, "right") - 1, place[low], place[high]


def strings_around(hasher: SpanHash, contexts: list[bytes], far: np.ndarray, length: int):
    """Of all strings around anchors: entry, place in the context, distance to the anchor, hash."""
    size = np.array([len(c) for c in contexts], np.int64)
    number = size - length + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    first = np.cumsum(number) - number
    entry = np.repeat(np.arange(len(contexts)), number)
    inner = np.arange(number.sum()) - np.repeat(first, number)
    start = begin[entry] + inner
    return entry, first, inner, far[entry] - inner, hasher.of(hasher.prefix(data), start, start + length)


def repeated_strings(rows: DataFrame, parts: int, length: int, gram: int, hot: int) -> DataFrame:
    """Key of the document, first and last+1 byte of stretches covered by strings that occur again."""
    found = materialize(shared_anchors(rows, parts, length, gram, hot), "suffixes-anchors")
    lists = found.groupBy(*KEY).agg(F.collect_list("a").alias("anchors"))
    own = rows.dropDuplicates(KEY).join(lists, KEY)

    def runs(batches):
        hasher, cold, hots = SpanHash(), [], []
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            for key, raw, marks in zip(keys, batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist()):
                for a in marks:
                    place, near, far = a >> 17, (a >> 9) & 255, (a >> 1) & 255
                    item = (raw[place:place + length - near], raw[place - far:place], far, place, key)
                    (hots if a & 1 else cold).append(item)
                    if len(cold) >= RUN:
                        yield _rows(list(run_of(hasher, cold)))
                        cold = []
                    if len(hots) >= RUN:
                        yield _rows(list(strings_of(hasher, hots)))
                        hots = []
        if cold:
            yield _rows(list(run_of(hasher, cold)))
        if hots:
            yield _rows(list(strings_of(hasher, hots)))

    def gram_hashes(hasher, items):
        data = np.frombuffer(b"".join(x[0][:gram] for x in items), np.uint8)
        at = np.arange(len(items)) * gram
        return hasher.of(hasher.prefix(data), at, at + gram)

    def run_of(hasher, items):
        items.sort(key=lambda x: x[0])
        part = (mix(gram_hashes(hasher, items)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            some = [items[k] for k in order[a:b]]
            yield int(part[order[a]]), 0, _pack(
                *front_code([x[0] for x in some]), [x[1] for x in some],
                np.array([x[2:4] for x in some], np.int64).reshape(-1, 2),
                np.array([x[4] for x in some], np.int64).reshape(-1, 3))

    def strings_of(hasher, items):
        for i in range(0, len(items), BATCH):
            some = items[i:i + BATCH]
            far, place = np.array([x[2:4] for x in some], np.int64).reshape(-1, 2).T
            key = np.array([x[4] for x in some], np.int64).reshape(-1, 3)
            grams = gram_hashes(hasher, some)
            entry, first, inner, distance, h = strings_around(hasher, [x[1] + x[0] for x in some], far, length)
            second = mix(grams[entry] + distance.astype(U64))
            order, size = _repeated(second, h)
            many = np.zeros(len(h), bool)
            many[order] = size > 1
            start = (place - far)[entry] + inner
            # What occurs twice here is known; one of each tells the others.
            e, low, high = _marks(many, first, start)
            spread = mix(key[e, 1].view(U64) + low.astype(U64)) % U64(parts)
            yield from _dealt(2, spread.astype(np.int64), key[e], low, high + length)
            tell = order[np.flatnonzero((size > 1) & np.concatenate(
                [[True], (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])]))]
            ask = np.concatenate([np.flatnonzero(~many), tell])
            part = (mix(h[ask]) % U64(parts)).astype(np.int64)
            known = np.zeros(len(ask), bool)
            known[len(ask) - len(tell):] = True
            yield from _dealt(1, part, h[ask], second[ask], known, key[entry[ask]], start[ask])

    def answer(key, low, high):
        return pa.RecordBatch.from_arrays(
            [pa.array(key[:, k].copy()) for k in range(3)] + [pa.array(low), pa.array(high)],
            names=[*KEY, "low", "high"])

    def compare(hasher, entries, group):
        """Strings around the anchors of whole groups; entries: context, far, place, key."""
        far, place = np.array([x[1:3] for x in entries], np.int64).reshape(-1, 2).T
        key = np.array([x[3] for x in entries], np.int64).reshape(-1, 3)
        entry, first, inner, distance, h = strings_around(hasher, [x[0] for x in entries], far, length)
        order, size = _repeated(distance, np.array(group)[entry], h)
        many = np.zeros(len(h), bool)
        many[order] = size > 1
        e, low, high = _marks(many, first, (place - far)[entry] + inner)
        return answer(key[e], low, high + length)

    def merge(batches):
        hasher, blobs, asked = SpanHash(), [], []
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == 0:
                    blobs.append(_unpack(raw))
                elif kind == 1:
                    asked.append(_unpack(raw))
                else:
                    yield answer(*_unpack(raw))
        if asked:
            h, second, known, key, start = (np.concatenate(c) for c in zip(*asked))
            order, size = _repeated(second, h)
            many = np.zeros(len(h), bool)
            many[order] = size > 1
            hit = np.flatnonzero(many & ~known)
            yield answer(key[hit], start[hit], start[hit] + length)
        if not blobs:
            return
        ready, groups, open_, number = [], [], [], 0
        for run, k, suffix, common in LoserTree([b[:3] for b in blobs]):
            if common < gram and open_:
                if len(open_) > 1:
                    ready += open_
                    groups += [number] * len(open_)
                    number += 1
                open_ = []
                if len(ready) >= BATCH:
                    yield compare(hasher, ready, groups)
                    ready, groups = [], []
            far, place = blobs[run][4][k]
            open_.append((blobs[run][3][k] + suffix, far, place, blobs[run][5][k]))
        if len(open_) > 1:
            ready += open_
            groups += [number] * len(open_)
        if ready:
            yield compare(hasher, ready, groups)

    dealt = own.select(*KEY, "text", "anchors").mapInArrow(runs, BLOBS).repartition(parts, "part")
    return dealt.mapInArrow(merge, "k0 long, k1 long, k2 long, low long, high long")


def marks(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Key and ``spans`` (first byte, last + 1) to remove, for documents that lose something."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.filter(F.octet_length("text") >= length).select(*KEY)
    again = narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2")
    copies = narrow.join(again, ["k1", "k2"]).distinct().select(
        *KEY, F.lit(0).cast("long").alias("low"), F.lit((1 << 62)).cast("long").alias("high"))
    found = repeated_strings(rows, parts, length, gram, hot).unionByName(copies)
    return materialize(found.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("spans")), "suffixes-marks")


def keep(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the spans merged where they meet."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        high = min(high, len(raw))
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    out, at = [], 0
    for low, high in merged:
        out.append(raw[at:low])
        at = high
    return b"".join([*out, raw[at:]]), [tuple(m) for m in merged]


KEPT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary,kept_sha256:string,removed:array<struct<low:long,high:long>>>"


def _cut(with_bytes: bool):
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = [[] for _ in range(6)]
        raws = text.cast(pa.binary()).fill_null(b"")
        for raw, own in zip(raws, spans):
            raw = raw.as_py()
            kept, merged = keep(raw, [(s["low"], s["high"]) for s in own.as_py()]) if own.is_valid else (raw, [])
            for column, x in zip(out, (len(raw), len(raw) - len(kept), len(merged), kept if with_bytes else None,
                                       None if with_bytes else hashlib.sha256(kept).hexdigest(),
                                       [{"low": a, "high": b} for a, b in merged])):
                column.append(x)
        span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), span]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[
            "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "removed"])

    return F.arrow_udf(run, KEPT)


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    rows = keyed(docs)
    found = rows.join(marks(rows, length, gram, hot), KEY, "left")
    doc_id = F.when(F.col("k0") != -(1 << 63), F.col("k0")).alias("doc_id")
    return found.select(doc_id, _cut(False)("text", "spans").alias("f")).select(
        "doc_id", "f.n_bytes", "f.n_removed", "f.n_spans", "f.kept_sha256", "f.removed")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated strings; a character that is cut through goes whole."""
    bound_batches(spark)
    found = marks(keyed(docs))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k0"),
                      F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), F.struct("*").alias("row"))
    whole = F.arrow_udf(_decoded, "string")(_cut(True)("row.text", "spans")["kept"])
    changed = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(whole)
    rows = own.join(found, KEY, "left").select("row", changed.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _decoded(raw: pa.Array) -> pa.Array:
    return pa.array([x.as_py().decode("utf-8", "ignore") if x.is_valid else "" for x in raw], pa.string())
