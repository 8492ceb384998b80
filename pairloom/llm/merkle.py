"""Merkle manifest of a table by time-forward processing: digests travel up, proofs travel down.

Every row is a leaf, H of its columns (H: SHA-256 in lowercase hex, inputs concatenated, digests as hex text;
NULL is ``-``, any other value its UTF-8 byte count, ``:``, value). The leaves of a group ascend by the order
column. While several nodes remain, every two neighbours (a last odd one alone) become their H; what remains is
the group's subroot. The subroots, in the order of their groups (NULL first, then bytewise), likewise give the root.

Nodes are labelled level by level from the leaves, so a child has a smaller label than its parent. A node sends
its digest to its parent's label, and a priority queue ordered by label hands every parent its children's digests
in time. The queue is external: messages are exchanged and sorted on disk by Spark by (group, block), a block being
the aligned subtree of ``2 ** BLOCK_BITS`` nodes, and inside a block a heap holds at most the block's messages. A round takes
all blocks ``BLOCK_BITS`` levels up, so a hundred thousand million leaves take four. Then the sweep is
reversed, labels descending: every node sends its children what stands above them, its own proof and the sibling,
until the leaves hold their whole proofs. Siblings in proofs are stored leaf to root.

Leaves find their places by a range sort and the counts per (partition, group); no task holds more than a block, a
partition or one count a partition, so a group with a third of all rows is spread over its blocks. Leaves and the
digests of each round are written to the shared scratch folder: a lost executor costs its tasks.

Defined results: rows of one doc_id are leaves of their own, ordered by their digests; of rows alike in all
columns each has one of the places, and which one makes no difference to the tree. A NULL doc_id comes first and
is never tampered with. Extra columns are not read. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import materialize

BLOCK_BITS = 10
PART_BITS = 33  # of monotonically_increasing_id: partition above, place in it below
ALONE, LEFT, RIGHT = 0, 1, 2  # where a node's sibling stands
STEP = 33  # bytes of a proof step: the side, then the sibling's digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(*values: Column) -> Column:
    """The leaf of a row with these values, as hex text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t))
                             for t in texts]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written ``rows`` (with ``group``) with ``index``, from 0 in each group by ``order``, and the group's ``n``."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["group", *order, "_tie"]
    placed = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn(
        "_seq", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("_part", F.shiftright("_seq", PART_BITS))
    spans = placed.groupBy(F.col("group").alias("_group"), F.col("_part").alias("_p")).agg(
        F.min("_seq").alias("_start"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_group")  # one row per partition that holds rows of the group
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_group", "_p", "_start", F.sum("_n").over(group).alias("n"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = F.col("group").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))
    return placed.join(spans, found).withColumn("index", F.col("_before") + F.col("_seq") - F.col("_start")).drop(
        "_seq", "_part", "_group", "_p", "_start", "_before")


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return (n - 1).bit_length()


def widths(nodes: int, levels: int) -> list[int]:
    """Nodes of a block on each level, from its own to the top of the round."""
    out = [nodes]
    for _ in range(levels):
        out.append(out[-1] + 1 >> 1)
    return out


def sweep_up(leaves: list[bytes], levels: int) -> list[bytes]:
    """Digests of all nodes of a block by label; the last is the block's."""
    width = widths(len(leaves), levels)
    digests, queue = list(leaves), []
    begin = 0
    for level, count in enumerate(width):
        above = begin + count
        for i in range(count):
            label = begin + i
            if level:  # the queue now hands this node what its children sent
                sent = []
                while queue and queue[0][0] >> 1 == label:
                    sent.append(heappop(queue)[1])
                digests.append(h(*sent))
            if level < levels:
                heappush(queue, (above + (i >> 1) << 1 | i & 1, digests[label]))
        begin = above
    return digests


def sweep_down(digests: list[bytes], nodes: int, levels: int, above: tuple | None) -> list[tuple | None]:
    """Proofs of a block's leaves as chained steps (side, sibling, rest), from the proof of its top."""
    width = widths(nodes, levels)
    begins = np.concatenate([[0], np.cumsum(width)[:-1]]).tolist()
    queue: list = [(-(len(digests) - 1), above)]
    proofs: list = [None] * nodes
    level = levels
    while queue:
        label, proof = heappop(queue)
        label = -label
        while label < begins[level]:
            level -= 1
        if level == 0:
            proofs[label] = proof
            continue
        first = begins[level - 1] + 2 * (label - begins[level])
        if first + 1 < begins[level]:
            heappush(queue, (-first, (RIGHT, digests[first + 1], proof)))
            heappush(queue, (-first - 1, (LEFT, digests[first], proof)))
        else:
            heappush(queue, (-first, (ALONE, b"", proof)))
    return proofs


def steps_of(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(side, sibling's hex digest) of a stored proof, leaf to root."""
    for i in range(0, len(path), STEP):
        yield path[i], path[i + 1:i + STEP].hex().encode() if path[i] != ALONE else b""


def _chain(path: bytes) -> tuple | None:
    chain = None
    for side, sibling in reversed(list(steps_of(path))):
        chain = (side, sibling, chain)
    return chain


def _stored(chain: tuple | None) -> bytes:
    out = []
    while chain:
        side, sibling, chain = chain
        out.append(bytes([side]) + (bytes.fromhex(sibling.decode()) if sibling else bytes(STEP - 1)))
    return b"".join(out)


def _block(table: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """A block's nodes in order, their digests, and the levels that this round takes them up."""
    table = table.sort_by("index")
    levels = min(BLOCK_BITS, levels_of(table.column("n")[0].as_py()))
    return table, [d.hex().encode() for d in table.column("digest").to_pylist()], levels


def _blocks(level: DataFrame) -> DataFrame:
    return level.withColumn("block", F.shiftright("index", BLOCK_BITS))


def _up(level: DataFrame) -> DataFrame:
    """The tops of the blocks, which are the next round's nodes: group, index, n, digest."""
    def run(table: pa.Table) -> pa.Table:
        table, leaves, levels = _block(table)
        top = sweep_up(leaves, levels)[-1]
        n = table.column("n")[0].as_py()
        return table.slice(0, 1).select(["group", "block"]).append_column(
            "n", pa.array([-(-n // (1 << BLOCK_BITS))], pa.int64())).append_column(
            "digest", pa.array([bytes.fromhex(top.decode())], pa.binary()))

    made = _blocks(level.select("group", "index", "n", "digest")).groupBy("group", "block").applyInArrow(
        run, "group string, block long, n long, digest binary")
    return made.withColumnRenamed("block", "index")


def _down(level: DataFrame, tops: DataFrame, extra: str = "") -> DataFrame:
    """``level`` with ``path`` and ``subroot``, from those of the blocks (group, block, path, subroot)."""
    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        table, leaves, levels = _block(table)
        proofs = sweep_down(sweep_up(leaves, levels), len(leaves), levels, _chain(top.column("path")[0].as_py()))
        path = pa.array([_stored(p) for p in proofs], pa.binary())
        subroot = pa.array([top.column("subroot")[0].as_py()] * len(proofs), pa.binary())
        return table.drop_columns(["n", "block"]).append_column("path", path).append_column("subroot", subroot)

    schema = f"group string, index long, digest binary, {extra}path binary, subroot binary"
    named = [c.split()[0] for c in extra.split(",") if c.strip()]
    blocks = _blocks(level.select("group", "index", "n", "digest", *named))
    return blocks.select("group", "index", "n", "digest", *named, "block").groupBy("group", "block").cogroup(
        tops.groupBy("group", "block")).applyInArrow(run, schema)


def _climb(level: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every round; the last holds one node a group."""
    rounds = [level]
    for _ in range(-(-levels_of(most) // BLOCK_BITS)):
        rounds.append(materialize(_up(rounds[-1]), "merkle-level"))
    return rounds


def _tops(proofs: DataFrame) -> DataFrame:
    return proofs.select("group", F.col("index").alias("block"), "path", "subroot")


def proofs(leaves: DataFrame) -> DataFrame:
    """``leaves`` (doc_id, group, digest, altered) with ``path``, ``subroot`` and ``root`` of every leaf.

    ``digest`` is the leaf as 32 bytes; ``altered`` is carried along. The driver gets counts and the root.
    """
    spark = leaves.sparkSession
    schema = "doc_id long, group string, digest binary, altered binary, path binary, subroot binary, root string"
    written = materialize(leaves.select("doc_id", "group", "digest", "altered"), "merkle-leaves")
    placed = numbered(written, ["doc_id", "digest"])
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema)
    rounds = _climb(placed, most)
    subroots = rounds[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    crown = numbered(subroots, ["name"])
    crown_rounds = _climb(crown, crown.agg(F.max("n")).first()[0])
    root = crown_rounds[-1].first()["digest"]
    above = crown_rounds[-1].select("group", F.col("index").alias("block"), F.lit(b"").alias("path"),
                                    F.col("digest").alias("subroot"))
    for level in reversed(crown_rounds[1:-1]):
        above = _tops(_down(level, above))
    if len(crown_rounds) > 1:
        top = _down(crown, above, "name string, ")
    else:
        top = crown.withColumn("path", F.lit(b""))
    above = top.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("block"), "path",
                       F.col("digest").alias("subroot"))
    above = materialize(above, "merkle-groups")
    for level in reversed(rounds[1:-1]):
        above = materialize(_tops(_down(level, above)), "merkle-paths")
    if len(rounds) > 1:
        below = _down(placed, above, "doc_id long, altered binary, ")
    else:  # every group is a lone leaf
        below = placed.join(above.withColumnRenamed("group", "_group"),
                            F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
    return below.select("doc_id", "group", "digest", "altered", "path", "subroot",
                        F.lit(root.hex()).alias("root"))


def siblings(path: Column) -> Column:
    """The siblings of a proof concatenated leaf to root, as their hex text."""
    def run(paths: pa.Array) -> pa.Array:
        return pa.array([b"".join(s for _, s in steps_of(p)).decode() for p in paths.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(path)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    def run(digests: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for own, path_ in zip(digests.to_pylist(), paths.to_pylist()):
            at = own.hex().encode()
            for side, sibling in steps_of(path_):
                at = h(sibling, at) if side == LEFT else h(at, sibling)
            out.append(at.decode())
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(digest, path)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang",
             order: str = "doc_id", altered: Column | None = None) -> DataFrame:
    """Leaf, proof, subroot and root of every row of ``docs``; ``order`` is a BIGINT."""
    return proofs(docs.select(F.col(order).cast("long").alias("doc_id"), F.col(group).cast("string").alias("group"),
                              F.unhex(leaf_digest(*map(F.col, columns))).alias("digest"),
                              (F.lit(None) if altered is None else F.unhex(altered)).cast("binary").alias("altered")))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and what folding shows where n_chars was tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    altered = F.when(tampered, leaf_digest(*[more if c == "n_chars" else F.col(c) for c in COLUMNS]))
    rows = manifest(docs, altered=altered)
    return rows.select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
