"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi join on narrow edges, so a node with very many
neighbours costs one combined row per task in the aggregate, and adaptive execution can split it
in the join. Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize


def _forest(batches):
    """Edges of a task replaced by at most one per node, to the least node it reaches in the task."""
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["v", "u"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (v > u): large star hangs greater neighbours, small star lesser ones, to the least."""
    if large:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        hung = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        joined = edges.join(least, "v")
        hung = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(
            least.select("v", F.col("m").alias("u")))
    return hung.filter("v != u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) of longs; component is the least node.

    Edges from a node to itself or to NULL say nothing. No edges give no rows.
    """
    narrow = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u")
    state = materialize(narrow.mapInArrow(_forest, "v long, u long").distinct(), "components")
    mark = None
    while True:
        state = materialize(_star(_star(state, True), False), "components")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return state.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
