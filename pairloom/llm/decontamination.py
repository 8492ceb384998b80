"""Benchmark decontamination by template canonicalisation.

Texts become templates: words that begin with a digit are numbers, capitalised words inside a
sentence are names, unit words after a number are units, each replaced by its placeholder; all other
words are lower-cased. Windows of five template words of the benchmark are hash-joined with those of
all documents. A document holds an item if, within twice the item's length, it has at least 0.8 of the
item's windows, and the placeholders' values agree: one value of the item stands for one
value of the document throughout, and the other way round, in at least 0.8 of the places. So a
question asked again with other numbers or names is found, and one with values at random isn't.

Only windows of three plain words or more find places, else any list of names would match any other. The others
count too: along the shift of those found, they are compared word by word, so the coverage is of all of the
item's windows. A second set has every window of the lower-cased words as they stand, without placeholders and
without that floor: 0.8 of it holds an item as well, so copies of numbers, names and units alone or in another
case are found. Of both answers the greater coverage counts, templates first. An item shorter than
five words is one window. An item without a window of three plain words that is asked again with other values isn't
found. The benchmark goes to the tasks in portions of bounded size, one pass over
the documents for each, so neither side is shuffled and none is cut.

Defined results: NULL or word-less text holds nothing and is held by nothing. Rows are judged one by
one: repeated rows are reported alike, of repeated items each. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.columns import KeyTable, LETTERS, LOWER, SpanHash, U64, bound_batches, flat, hash_words, mix, slices

WINDOW = 5
PLAIN = 3
SIMILARITY = 0.8
PORTION_CHARS = 4_000_000  # benchmark text that goes to the tasks at once
NUMBER, NAME, UNIT = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3))
UNITS = ("mm cm m km g kg mg t s ms min h l ml w kw v a hz mb gb tb inch inches foot feet yard yards mile "
         "miles pound pounds ounce ounces meter meters metre metres gram grams liter liters litre litres "
         "second seconds minute minutes hour hours day days week weeks month months year years dollar "
         "dollars euro euros cent cents percent degree degrees").split()
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n"]] = True
HIT = ("array<struct<item_id:long,coverage:double,n_windows:long,first_word:long,last_word:long,"
       "n_slots:long,slot_consistency:double,slots_equal:double,kind:string>>")


class Templates:
    """Template words of rows: token hashes, whether each is a placeholder, value hashes, row starts."""

    def __init__(self) -> None:
        self.hasher, self.units = SpanHash(), KeyTable(hash_words(UNITS))

    def of(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        values, starts, ends, first = self.hasher.words(low, offsets, LETTERS)
        if not len(values):
            return values, np.zeros(0, bool), values, first
        opening = np.zeros(len(values), bool)
        opening[first[:-1][first[:-1] < first[1:]]] = True
        stops = np.concatenate([[0], np.cumsum(STOPS[data])])
        opening[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        head = data[starts]
        number = (head >= 48) & (head <= 57)
        name = (head >= 65) & (head <= 90) & ~opening
        unit = np.zeros(len(values), bool)
        unit[1:] = number[:-1]
        unit &= ~number & (self.units.find(values) >= 0)
        tokens = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, values)))
        return tokens, number | name | unit, values, first

    @staticmethod
    def windows(tokens, slots, first, width, plain: int = PLAIN):
        """Place, row and hash of each window of ``width`` words that has enough plain ones."""
        n = len(tokens) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        hashes, held = np.full(n, width, U64), np.zeros(n, np.int64)
        for k in range(width):
            hashes = mix(hashes * U64(0x9FB21C651E98DF25) + tokens[k:k + n])
            held += slots[k:k + n]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        good = np.flatnonzero((row[:n] == row[width - 1:]) & (held <= max(0, width - plain)))
        return good, row[good], hashes[good]


def index_items(rows: list[tuple[int, str]]) -> dict:
    """Windows of benchmark items for the join: hash -> (item, place)."""
    data, offsets = flat(pa.array([t for _, t in rows], pa.string()))
    tokens, slots, values, first = Templates().of(data, offsets)
    sizes = np.diff(first)
    # Inside a sentence of a document, an item's capital first word reads as a name: both count.
    heads = first[:-1][sizes > 0]
    texts = [t.lstrip() for _, t in rows]
    capital = heads[[bool(t) and "A" <= t[0] <= "Z" for t, n in zip(texts, sizes) if n]] if len(heads) else heads
    named, named_slots = tokens.copy(), slots.copy()
    named[capital], named_slots[capital] = NAME, True
    widths = np.minimum(sizes, WINDOW)
    all_widths = sorted({int(w) for w in widths if w})
    free = np.zeros(len(tokens), bool)

    def postings(variants, plain):
        keys, items, places = [], [], []
        for width in all_widths:
            for some, marks in variants:
                place, row, hashes = Templates.windows(some, marks, first, width, plain)
                use = widths[row] == width
                if some is named:
                    use &= np.isin(place, capital)
                keys.append(hashes[use])
                items.append(row[use])
                places.append(place[use] - first[row[use]])
        keys = np.concatenate([*keys, np.zeros(0, U64)])
        order = np.argsort(keys, kind="stable")
        keys, begin = np.unique(keys[order], return_index=True)
        items = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)[order]
        places = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)[order]
        return {"keys": keys, "begin": np.append(begin, len(items)), "items": items, "places": places}

    templates, literal = postings([(tokens, slots), (named, named_slots)], PLAIN), postings([(values, free)], 0)
    finding = np.zeros(len(tokens), bool)  # places of windows that the join can find
    finding[first[templates["items"]] + templates["places"]] = True
    return {"ids": [i for i, _ in rows], "sets": [templates, literal], "sizes": sizes,
            "kinds": np.where(sizes > 0, sizes - widths + 1, 0), "finding": finding, "first": first,
            "tokens": tokens, "named": named, "values": values, "widths": all_widths}


def _stretch(doc_places, item_places, reach):
    """Windows of the item in the best stretch of the document, its first and its last hit."""
    low, count, best = 0, {}, (0, 0, 0)
    for high, place in enumerate(doc_places):
        count[item_places[high]] = count.get(item_places[high], 0) + 1
        while place - doc_places[low] > reach:
            w = item_places[low]
            count[w] -= 1
            if not count[w]:
                del count[w]
            low += 1
        if len(count) > best[0]:
            best = (len(count), low, high)
    return best


def _judge_literal(index, item, doc_places, item_places):
    """The best stretch of one document for the item's words as they stand, or None."""
    size, kinds = int(index["sizes"][item]), int(index["kinds"][item])
    found, low, high = _stretch(doc_places, item_places, 2 * size)
    if found < SIMILARITY * kinds:
        return None
    return {"item_id": index["ids"][item], "coverage": found / kinds, "n_windows": kinds,
            "first_word": int(doc_places[low]), "last_word": int(doc_places[high]) + min(WINDOW, size) - 1,
            "n_slots": 0, "slot_consistency": 1.0, "slots_equal": 1.0, "kind": "exact" if found == kinds else "near"}


def _judge(index, item, doc_places, item_places, tokens, slots, values):
    """The best stretch of one document for one item, or None. Arrays are sorted by document place."""
    size, kinds, own = int(index["sizes"][item]), int(index["kinds"][item]), int(index["first"][item])
    width = min(WINDOW, size)
    _, low, high = _stretch(doc_places, item_places, 2 * size)
    pairs = set()
    # Values are compared along the most frequent shift, as a window can stand in an item repeatedly.
    hits = list(zip(doc_places[low:high + 1], item_places[low:high + 1]))
    shifts = Counter(at - place for at, place in hits)
    shift = min(shifts, key=lambda x: (-shifts[x], x))
    # Windows that find nothing by themselves: the same template words along that shift.
    at = shift + np.arange(size)
    there = tokens[np.clip(at, 0, len(tokens) - 1)]
    equal = (there == index["tokens"][own:own + size]) | (there == index["named"][own:own + size])
    equal &= (at >= 0) & (at < len(tokens))
    whole = np.convolve(equal, np.ones(width, int), "valid") == width
    hits += [(int(shift + p), int(p)) for p in np.flatnonzero(whole & ~index["finding"][own:own + kinds])]
    found = len({place for _, place in hits})
    if found < SIMILARITY * kinds:
        return None
    for at, place in hits:
        for k in range(width):
            if at - place == shift and slots[at + k]:
                pairs.add((int(at + k), int(index["values"][own + place + k]), int(values[at + k])))
    forth, back = {}, {}
    for _, a, b in pairs:
        forth.setdefault(a, {}).setdefault(b, 0)
        forth[a][b] += 1
        back.setdefault(b, {}).setdefault(a, 0)
        back[b][a] += 1
    agree = sum(max(forth[a], key=lambda x: (forth[a][x], x)) == b and max(back[b], key=lambda x: (back[b][x], x)) == a
                for _, a, b in pairs)
    n = len(pairs)
    consistency, equal = (agree / n, sum(a == b for _, a, b in pairs) / n) if n else (1.0, 1.0)
    if consistency < SIMILARITY:
        return None
    coverage = found / kinds
    kind = "reparameterised" if equal < 1 else "exact" if coverage == 1 else "near"
    return {"item_id": index["ids"][item], "coverage": coverage, "n_windows": kinds,
            "first_word": int(min(hits)[0]), "last_word": int(max(hits)[0]) + width - 1,
            "n_slots": n, "slot_consistency": consistency, "slots_equal": equal, "kind": kind}


def items_held(shared, text: Column) -> Column:
    """Array of the items of one benchmark portion that a text holds."""

    def run(column: pa.Array) -> pa.Array:
        index, made = shared.value, Templates()
        tables, out = [KeyTable(x["keys"]) for x in index["sets"]], [[] for _ in range(len(column))]
        silent = index["kinds"] - np.add.reduceat(np.append(index["finding"], False).astype(np.int64), index["first"][:-1]) * (index["sizes"] > 0)
        data, offsets = flat(column)
        for i, j, part, at in slices(data, offsets):
            tokens, slots, values, first = made.of(part, at)
            best = {}
            for literal, (own, table) in enumerate(zip(index["sets"], tables)):
                hits = []
                for width in index["widths"]:
                    marks = np.zeros(len(slots), bool) if literal else slots
                    place, row, hashes = made.windows(values if literal else tokens, marks, first, width, 0 if literal else PLAIN)
                    key = table.find(hashes)
                    hit = np.flatnonzero(key >= 0)
                    n = own["begin"][key[hit] + 1] - own["begin"][key[hit]]
                    post = np.repeat(own["begin"][key[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    use = np.repeat(hit, n)
                    hits.append(np.stack([row[use], own["items"][post], place[use], own["places"][post]]))
                if not hits:
                    continue
                rows, items, place, item_place = np.concatenate(hits, axis=1)
                order = np.lexsort((item_place, place, items, rows))
                rows, items, place, item_place = (x[order] for x in (rows, items, place, item_place))
                cuts = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(items, prepend=-1) != 0))
                for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
                    r, item = int(rows[a]), int(items[a])
                    if b - a + (0 if literal else silent[item]) < SIMILARITY * index["kinds"][item]:
                        continue
                    begin, end = first[r], first[r + 1]
                    found = (place[a:b] - begin).tolist(), item_place[a:b].tolist()
                    got = (_judge_literal(index, item, *found) if literal else
                           _judge(index, item, *found, tokens[begin:end], slots[begin:end], values[begin:end]))
                    if got and ((r, item) not in best or got["coverage"] > best[r, item]["coverage"]):
                        best[r, item] = got
            for (r, _), got in sorted(best.items(), key=lambda x: x[0]):
                out[i + r].append(got)
        return pa.array(out, KIND)

    return F.arrow_udf(run, HIT)(text)


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_windows", pa.int64()),
                           ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_slots", pa.int64()),
                           ("slot_consistency", pa.float64()), ("slots_equal", pa.float64()), ("kind", pa.string())]))


def portions(benchmark: DataFrame):
    """Broadcast indexes of bounded portions of the benchmark (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PORTION_CHARS)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            index = index_items(sorted((tuple(r) for r in rows), key=str))
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, ... for every document and item that it holds."""
    out = None
    for shared in portions(benchmark):
        found = docs.select("doc_id", items_held(shared, F.col("text")).alias("_hits")).select(
            "doc_id", F.inline("_hits"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = docs.limit(0).select("doc_id", F.from_json(F.lit("[]"), HIT).alias("_hits"))
        return empty.select("doc_id", F.inline("_hits"))
    return out


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    bound_batches(spark)
    for shared in portions(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = docs.select(F.struct("*").alias("row"), items_held(shared, F.col("text")).alias("hits")).filter(
            "size(hits) = 0").select("row.*")
    return docs
