"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

A is the matrix of centred vectors, a row each, kept as a table of whole numbers.
The right vectors v_k, one per step, live on the driver: at most as many as there are
dimensions, each of that length. A left vector u_k has an entry for every row and is
never gathered: it stands as the short p_k with u_k = A p_k. A step is one pass over
the table: each task takes its rows' A q and adds up A' (A q), of which Spark sums a
row per dimension. Both families are reorthogonalised in full against all before:
v_k among themselves, u_k by u_j' u = p_j' (A' u), which needs no further pass; where
that correction is large, the pass is repeated with what is left.

Where a step finds nothing new (repeated singular values, or no variance left), the
next v is any direction orthogonal to all before. The steps end where every direction
is taken, or where the components asked for have converged and the variance that no
step has seen is below the least of them, so that none can have been missed.

Cases: null vectors, vectors with null or non-finite entries and those shorter than the
longest one are dropped; repeated rows and null ids are rows of their own; fewer
components come out where fewer have a variance (none for equal vectors); an empty table gives an empty
result; entries beyond 2 ** 46 count as that; the deviation is null where it exceeds 63 bits.
Of other columns only those named in `keep` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
_MOST = float(1 << 46)


def whole_numbers(rows: DataFrame, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """keep and x: floor(SCALE * entry) + SHIFT of every vector whose entries are all finite."""
    v = F.col(column)
    finite = rows.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    entry = lambda c: F.floor(SCALE * F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c.cast("double")))).cast("long") + F.lit(SHIFT)
    return finite.select(*(keep or ["vec_id"]), F.transform(v, entry).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' whole numbers."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of of(rows' matrix), a short vector, over all batches. A task sends its own sum, and Spark adds them by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = rows.select("x").mapInArrow(run, f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(found), np.int64 if kind == "long" else np.float64)
    for k, v in found:
        out[k] = v
    return out


def _unlike(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v without its part in the basis' rows; twice, as once leaves rounding."""
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def _fresh(basis: np.ndarray, d: int) -> np.ndarray:
    """A unit vector orthogonal to the basis: of the axes, the one that is least in it."""
    left = 1 - (basis**2).sum(0) if len(basis) else np.ones(d)
    v = np.zeros(d)
    v[int(np.argmax(left))] = 1.0
    v = _unlike(basis, v) if len(basis) else v
    return v / np.linalg.norm(v)


def bidiagonalised(product: Callable[[np.ndarray], np.ndarray], d: int, mass: float, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and singular values of A, the largest `wanted` of them at least.

    product(q) gives A' A q and |A q|^2 behind it, from one pass; mass is |A|^2, the sum of its squared entries.
    """
    eps = np.finfo(float).eps
    tiny = 64 * eps * np.sqrt(mass)
    vs, ps, gs = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # v_k, p_k with u_k = A p_k, and A' u_k
    alphas, betas = [], []
    # A first direction with a part in every axis, the same in every run.
    v, beta = np.sin(np.arange(1, d + 1) * 1.618) + 1.5, 0.0
    v /= np.linalg.norm(v)
    while True:
        q = v - beta * ps[-1] if len(ps) else v
        for _ in range(3):
            found = product(q)
            g, size = found[:d], found[d]
            c = ps @ g
            q, g, size = q - ps.T @ c, g - gs.T @ c, max(size - c @ c, 0.0)
            if c @ c <= 1e-20 * max(size, tiny**2):
                break
        alpha = np.sqrt(size)
        if alpha <= tiny:
            alpha, q, g = 0.0, np.zeros(d), np.zeros(d)
        vs = np.vstack([vs, v])
        alphas.append(alpha)
        ps, gs = np.vstack([ps, q / (alpha or 1)]), np.vstack([gs, g / (alpha or 1)])
        k = len(alphas)
        if k == d:
            break
        w = _unlike(vs, gs[-1] - alpha * v)
        beta = float(np.linalg.norm(w))
        if beta <= tiny:
            beta = 0.0
        if k >= wanted:
            b = np.diag(alphas) + np.diag(betas, 1)
            left, s, _ = np.linalg.svd(b)
            rest = mass - float(np.sum(np.square(alphas)) + np.sum(np.square(betas)))
            if np.all(beta * np.abs(left[-1, :wanted]) <= 4 * eps * s[0]) and rest < 0.5 * s[wanted - 1] ** 2:
                break
        v = w / beta if beta else _fresh(vs, d)
        betas.append(beta)
    _, s, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    return right @ vs, s


def whitened_vectors(rows: DataFrame, column: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """keep (vec_id by default), component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark, keep = rows.sparkSession, keep or ["vec_id"]
    own = [T.StructField(c, rows.schema[c].dataType) for c in keep]
    types = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType(own + T._parse_datatype_string(types).fields)
    # The table stays: the result, which is made when it is asked for, reads it.
    tables = Tables(spark)
    x = tables.put("vectors", whole_numbers(rows, column, keep))
    sizes = x.groupBy(F.size("x").alias("d")).count().agg(F.max("d").alias("d"), F.max_by("count", "d").alias("n"), F.sum("count").alias("all")).first()
    d, n = sizes["d"] or 0, sizes["n"] or 0
    if d == 0:
        return spark.createDataFrame([], schema)
    if n < sizes["all"]:
        x = x.where(F.size("x") == d)
    sums = summed(x, lambda m: m.sum(0), "long")
    centred = lambda m: (m * n - sums) / n  # noqa: E731  whole numbers up to the division
    mass = float(summed(x, lambda m: np.array([np.square(centred(m)).sum()]))[0])

    def product(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            a = centred(m)
            u = a @ q
            return np.append(a.T @ u, u @ u)

        return summed(x, part)

    vectors, s = bidiagonalised(product, d, mass, min(components, d)) if mass > 0 else (np.zeros((0, d)), np.zeros(0))
    there = int(np.sum(s[:components] > 1e-10 * s[0])) if len(s) else 0
    if there == 0:
        return spark.createDataFrame([], schema)
    variance = s[:there] ** 2 / n
    onto = vectors[:there].T / np.sqrt(variance)
    explained = variance / (mass / n)
    mean = summed(x, lambda m: (centred(m) @ onto).sum(0)) / n

    def products(m: np.ndarray) -> np.ndarray:
        w = centred(m) @ onto - mean
        return (w.T @ w).ravel()

    error = float(np.max(np.abs(summed(x, products).reshape(there, there) / n - np.eye(there))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                m = _matrix(batch)
                c = m * n - sums
                fits = np.square(c.astype(float)).sum(1) < 2.0**63 * (1 - 1e-9)
                deviation = np.square(c).sum(1)
                again = np.repeat(np.arange(len(m)), there)
                columns = [batch.column(k).take(pa.array(again)) for k in range(len(keep))]
                columns += [pa.array(np.tile(np.arange(1, there + 1, dtype=np.int32), len(m))), pa.array(np.full(len(again), n)), pa.array(deviation[again], pa.int64(), mask=~fits[again]), pa.array((c / n @ onto).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(again), error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return x.select(*keep, "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitened_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
