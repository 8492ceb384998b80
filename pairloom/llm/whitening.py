"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

An entry c becomes the whole number x = floor(256 * c), and the fit list holds each distinct vector once. With A the
centred fit list over sqrt(n), the method builds orthonormal v_1, v_2, ... (as wide as a vector) and u_1, u_2, ... (as
long as the list) with A v_j = beta_{j-1} u_{j-1} + alpha_j u_j and A^T u_j = alpha_j v_j + beta_j v_{j+1}. The SVD
of the small bidiagonal matrix of alphas and betas gives the components and their deviations.

The long vectors never exist as a whole: u_j = A w_j for a short w_j, so one step is one pass over the rows that forms
y = A w and A^T y block by block, and Spark adds up the partial sums. Full reorthogonalisation of the u's works on short vectors,
too: u_i . A p = (A^T u_i) . p, and A^T u_i is known from step i. v's are reorthogonalised twice against all before.
A chain ends when its leading triplets have converged to rounding, or when nothing is left of it; then a new
start orthogonal to all v's looks for what the chain can't see (equal deviations), until its own leading value has
settled below the last component's.

Vectors are packed into blocks of bounded size in the narrowest integers that hold them, written once, and read by
every pass. The driver holds sums per dimension and short vectors, never rows.

Defined results: rows without a vector, or with a NULL or non-finite entry, are dropped; repeated rows and
repeated vec_ids each get rows of their own; only distinct vectors count in the fit. A component needs a deviation
above ``LEAST`` of the largest: fewer than two distinct vectors, an empty table or a table without variance give
no rows. The sign of a component makes its largest entry positive. Vectors of different widths raise, as does a ``deviation``
beyond a BIGINT. Extra columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 2 << 20  # of one block as doubles
CONVERGED = 8 * np.finfo(float).eps  # residual of a component, to the largest deviation
PROBED = 1e-6  # residual at which the leading value of a later chain has settled
NOTHING = 1e-13  # a rest this small, to the largest deviation, ends a chain
LEAST = 1e-12
WIDTHS = ("<i1", "<i2", "<i4", "<i8")


class Fit(NamedTuple):
    n: int
    sums: list[int]
    square: int  # sum of all squared entries of the fit list
    blocks: DataFrame | None


class Components(NamedTuple):
    """Unit vectors as rows, eigenvalues of the covariance, and the shares of its trace."""

    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """x = floor(256 * c) of complete vectors, one row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) and len(flat) % len(vectors):
        raise ValueError("vectors differ in width")
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in width")
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(vectors), -1)


def _width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place in WIDTHS of the narrowest integer that holds both."""
    out = np.zeros(np.shape(low), np.int64)
    for bits in (7, 15, 31):
        out += (low < -(1 << bits)) | (high >= 1 << bits)
    return out


def complete(rows: DataFrame, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & fine)


def fit_list(rows: DataFrame, vector: str = "embedding") -> Fit:
    """The distinct vectors in written blocks, their number and sums."""
    def keys(batches):
        for batch in batches:
            x = whole_numbers(batch.column(0))
            if not x.shape[1]:
                continue
            kind = _width(x.min(axis=1), x.max(axis=1))
            out: list = []
            for k in np.unique(kind).tolist():
                some = x[kind == k].astype(WIDTHS[k])
                raw, step = some.tobytes(), some.shape[1] * some.itemsize
                out += [bytes([k]) + raw[i:i + step] for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])

    def pack(batches):
        held: list[np.ndarray] = []

        def block():
            x = np.stack(held)
            k = int(_width(x.min(), x.max()))
            square = sum(int(s) for s in (x.astype(object) ** 2).sum(axis=1)) if k == 3 else int((x * x).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int64()), pa.array([k], pa.int32()),
                 pa.array([[str(sum(c.tolist())) for c in x.T] if k == 3 else
                           [str(s) for s in x.sum(axis=0).tolist()]], pa.list_(pa.string())),
                 pa.array([str(square)]), pa.array([x.astype(WIDTHS[k]).tobytes()], pa.binary())],
                names=["n", "kind", "sums", "square", "data"])

        for batch in batches:
            for key in batch.column(0).to_pylist():
                x = np.frombuffer(key, WIDTHS[key[0]], offset=1).astype(np.int64)
                if held and len(x) != len(held[0]):
                    raise ValueError("vectors differ in width")
                held.append(x)
                if len(held) * len(x) * 8 >= BLOCK_BYTES:
                    yield block()
                    held = []
        if held:
            yield block()

    distinct = complete(rows, vector).select(vector).mapInArrow(keys, "key binary").distinct()
    blocks = materialize(distinct.mapInArrow(
        pack, "n long, kind int, sums array<string>, square string, data binary"), "whitening-blocks")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    total = blocks.agg(F.sum("n").alias("n"), exact("square").alias("square"), F.min(F.size("sums")).alias("low"),
                       F.max(F.size("sums")).alias("high")).first()
    if total["n"] is None:
        return Fit(0, [], 0, None)
    if total["low"] != total["high"]:
        raise ValueError("vectors differ in width")
    sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(exact("s").alias("s")).collect()
    return Fit(total["n"], [int(r["s"]) for r in sorted(sums)], int(total["square"]), blocks)


def _over_blocks(fit: Fit, per_block) -> np.ndarray:
    """The sum over all blocks of ``per_block(centred rows)``, a vector: added up in tasks, then by Spark."""
    mean = np.array([s / fit.n for s in fit.sums])

    def run(batches):
        total = None
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = per_block(np.frombuffer(data, WIDTHS[kind]).reshape(-1, len(mean)) - mean)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(np.float64))], names=["i", "x"])

    parts = fit.blocks.select("kind", "data").mapInArrow(run, "i int, x double")
    return np.array([r["x"] for r in sorted(parts.groupBy("i").agg(F.sum("x").alias("x")).collect())])


def product(fit: Fit, p: np.ndarray) -> tuple[float, np.ndarray]:
    """|A p|^2 and A^T A p in one pass."""
    def both(x: np.ndarray) -> np.ndarray:
        y = x @ p
        return np.append(x.T @ y, y @ y)

    out = _over_blocks(fit, both) / fit.n
    return float(out[-1]), out[:-1]


class _Chain:
    """Alphas and betas of one run of the recurrence."""

    def __init__(self) -> None:
        self.alphas: list[float] = []
        self.betas: list[float] = []

    def triplets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors as rows, and residuals."""
        small = np.diag(self.alphas) + np.diag(self.betas[:-1], 1)
        left, values, right = np.linalg.svd(small)
        return values, right, abs(self.betas[-1] * left[-1])


def bidiagonalise(multiply, width: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values and right vectors of A, given p -> (|A p|^2, A^T A p)."""
    draw = np.random.default_rng(seed)
    vs, ws, zs = (np.zeros((0, width)) for _ in range(3))
    found_values, found_vectors, largest = np.zeros(0), np.zeros((0, width)), 0.0

    def against(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - vs.T @ (vs @ r)
        return r

    while len(vs) < width:
        v = against(against(draw.standard_normal(width)))
        v /= np.linalg.norm(v)
        chain, first, w, beta = _Chain(), len(vs), np.zeros(width), 0.0
        need = wanted if not len(found_values) else 1
        while True:
            p = v - beta * w
            for _ in range(2):
                p = p - ws.T @ (zs @ p)
            size, g = multiply(p)
            alpha = math.sqrt(max(size, 0.0))
            largest = max(largest, alpha)
            vs = np.vstack([vs, v])
            if alpha <= NOTHING * largest:
                alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
            else:
                w, z = p / alpha, g / alpha
                ws, zs = np.vstack([ws, w]), np.vstack([zs, z])
            rest = against(z - alpha * v)
            beta = float(np.linalg.norm(rest))
            if beta <= NOTHING * largest or len(vs) == width:
                beta = 0.0
            chain.alphas.append(alpha)
            chain.betas.append(beta)
            values, right, residual = chain.triplets()
            largest = max(largest, float(values[0]))
            lead = values[:need] > (found_values[wanted - 1] if len(found_values) >= wanted else -1.0)
            if need < wanted and lead.any():
                need = min(wanted, len(found_values) + wanted)  # this chain has something new: whole precision
            bound = CONVERGED if need == wanted else PROBED
            if beta == 0.0 or (len(values) >= need and (residual[:need] <= bound * largest).all()):
                break
            v = rest / beta
        before = len(found_values)
        some = len(values) if beta == 0.0 else need
        found_vectors = np.vstack([found_vectors, right[:some] @ vs[first:]])
        found_values = np.append(found_values, values[:some])
        order = np.argsort(-found_values, kind="stable")[:wanted]
        settled = before >= wanted and (order < before).all()
        found_values, found_vectors = found_values[order], found_vectors[order]
        if settled:
            break
    return found_values, found_vectors


def principal(fit: Fit, components: int = COMPONENTS) -> Components:
    """The leading components of the fit list."""
    width = len(fit.sums)
    none = Components(np.zeros((0, width)), np.zeros(0), np.zeros(0))
    trace = (fit.n * fit.square - sum(s * s for s in fit.sums)) / fit.n ** 2 if fit.n else 0.0
    if trace <= 0:
        return none
    values, vectors = bidiagonalise(lambda p: product(fit, p), width, min(components, width))
    keep = values > LEAST * values[0]
    values, vectors = values[keep], vectors[keep]
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    lead = np.take_along_axis(vectors, abs(vectors).argmax(axis=1)[:, None], axis=1)
    return Components(vectors * np.sign(lead), values ** 2, values ** 2 / trace)


def identity_error(fit: Fit, found: Components) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = len(found.values)
    turn = (found.vectors / np.sqrt(found.values)[:, None]).T
    mean = _over_blocks(fit, lambda x: (x @ turn).sum(axis=0)) / fit.n

    def squares(x: np.ndarray) -> np.ndarray:
        y = x @ turn - mean
        return (y.T @ y).ravel()

    return float(abs(_over_blocks(fit, squares).reshape(k, k) / fit.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exactly."""
    reach = n * int(abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * reach * reach < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return (off * off).sum(axis=1).tolist()


def whiten(rows: DataFrame, fit: Fit, found: Components, row_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """Every complete row by component: its whitened coordinate and its exact deviation from the mean."""
    k = len(found.values)
    n, sums = fit.n, fit.sums
    mean = np.array([s / n for s in sums])
    turn = (found.vectors / np.sqrt(found.values)[:, None]).T

    def run(batches):
        for batch in batches:
            x = whole_numbers(batch.column(1))
            if not len(x):
                continue
            y = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.repeat(pa.array(deviations(x, n, sums), pa.int64()).to_numpy(), k)), pa.array(y.ravel())],
                names=["_id", "component", "deviation", "whitened"])

    narrow = complete(rows, vector).select(F.col(row_id).cast("long").alias("_id"), vector)
    return narrow.mapInArrow(run, "_id long, component int, deviation long, whitened double").withColumnRenamed(
        "_id", row_id)


def whitened_rows(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``embeddings``."""
    spark = rows.sparkSession
    fit = fit_list(rows)
    found = principal(fit, components)
    if not len(found.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    shares = F.element_at(F.array(*[F.lit(float(e)) for e in found.explained]), F.col("component"))
    return whiten(rows, fit, found).select(
        "vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        shares.alias("explained"), F.lit(identity_error(fit, found)).alias("identity_error"))
