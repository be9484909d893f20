"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

Vectors become whole numbers. The fit list holds each distinct one once; its count n and sums S are exact, and so is n*x - S, which
every product starts from: a row is centred before it is multiplied. The covariance V is never formed. A pass over the fit list gives V Q for a block
Q of vectors, X'(X Q) / n summed task by task; what comes back is as large as the block, whatever the number of rows.

The basis grows by the part of V Q that is orthogonal to all of it (taken off twice). Where that part has no full rank the
iteration has met an invariant subspace: it is started again there with random vectors orthogonal to the basis. Ritz pairs of the whole basis are
taken after each pass, and their residuals V y - e y are known without another one; the iteration ends when those of all wanted components are
small, or when the basis spans everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import let_go, ready, table
from .negatives import finite, matrix

#: An entry c is the whole number floor(SCALE * c) + SHIFT, and no farther from SHIFT than MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 31
#: Components that are wanted, vectors of a block, residual (a part of the largest eigenvalue) that ends the iteration, and least eigenvalue (likewise) of a component.
COMPONENTS, BLOCK, RESIDUAL, LEAST = 16, 16, 1e-13, 1e-10
LONG = (1 << 63) - 1


@dataclass
class Whitener:
    """n distinct vectors, sums of x - SHIFT by dimension, components as columns with their eigenvalues, the trace, passes taken."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n*x - S)^2, exact; the largest long where it is more."""
        y = self.n * x - self.sums
        if len(y) and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 > LONG:
            return np.array([min(LONG, sum(v * v for v in row)) for row in y.tolist()], np.int64)
        return (y * y).sum(axis=1)


def _summed(fit: DataFrame, dims: int, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over the fit list of make(rows of a batch), an array of one shape; tasks add up their own batches, Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(matrix(batch.column(0), dims, MOST)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    got = fit.mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    return got["v"].to_numpy()[np.argsort(got["at"].to_numpy())]


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """An orthonormal block orthogonal to the basis: the directions of the given block as far as they are more than rounding beside scale,
    then random ones, as many as the block has columns or dimensions are left."""
    dims = len(basis)
    out = np.zeros((dims, 0))
    wanted = min(block.shape[1], dims - basis.shape[1])
    fresh = block
    while out.shape[1] < wanted:
        held = np.hstack([basis, out])
        for _ in range(2):
            fresh = fresh - held @ (held.T @ fresh)
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        u = u[:, s > 1e-12 * scale]
        for _ in range(2):
            u = u - held @ (held.T @ u)
        out = np.hstack([out, np.linalg.qr(u)[0][:, : wanted - out.shape[1]]])
        fresh, scale = rng.standard_normal((dims, wanted)), 1.0
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors, passes) of the wanted largest of a symmetric matrix that only its product times(Q) is known of.

    A block finds no more copies of a repeated eigenvalue than it is wide, so it is as wide as pairs are wanted, or wider.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    block = max(block, wanted)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = _orthogonal(rng.standard_normal((dims, min(block, dims))), basis, rng, 1.0)
    passes = 0
    while True:
        image = times(new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        h = basis.T @ images
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = vectors[:, :wanted]
        off = np.linalg.norm(images @ top - basis @ top * values[:wanted], axis=0)
        if basis.shape[1] == dims or basis.shape[1] >= wanted and (off <= residual * abs(values[0])).all():
            found = basis @ top
            return values[:wanted], found / np.linalg.norm(found, axis=0), passes
        new = _orthogonal(image, basis, rng, max(abs(values[0]), np.finfo(float).tiny))


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): entries as whole numbers without SHIFT, which cancels out; null and non-finite vectors left out."""
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.where(finite("vector")).select("vec_id", x.alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitener | None:
    """The whitener of rows (vec_id, x), None where no row is there. Distinct vectors are written to the shared folder for the passes and deleted after."""
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size("x")).alias("dims")).first()["dims"]
    if dims is None:
        return None
    dims = max(1, dims)
    path = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    # A shorter vector's missing entries are 0, so they are filled in before vectors are told apart.
    full = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    rows.select(full.alias("x")).distinct().write.parquet(path)
    held = spark.read.parquet(path)
    try:
        sums = _summed(held, dims, lambda x: np.append(x.sum(axis=0), len(x)), "long")
        sums, n = sums[:-1], int(sums[-1])

        def centred(x: np.ndarray) -> np.ndarray:
            return (n * x - sums) / n

        trace = _summed(held, dims, lambda x: np.array([(centred(x) ** 2).sum()]), "double")[0] / n

        def times(q: np.ndarray) -> np.ndarray:
            def product(x: np.ndarray) -> np.ndarray:
                c = centred(x)
                return c.T @ (c @ q)

            return _summed(held, dims, product, "double").reshape(q.shape) / n

        values, vectors, passes = lanczos(times, dims, components, block)
        there = values > max(LEAST * values[0], 0)
        out = Whitener(n, sums, vectors[:, there], values[there], float(trace), passes)
        k = out.components.shape[1]
        if k:
            moments = _summed(held, dims, lambda x: np.vstack([(w := out.whitened(x)).T @ w, w.sum(axis=0)]), "double").reshape(k + 1, k) / n
            out.identity_error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(k)).max())
        return out
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whiten(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of vectors (vec_id, vector) and component.

    A row whose vector is null or has an entry that is null or not finite is left out; what a vector lacks against the longest is 0. Repeated rows are
    each answered and count once in the fit; a null vec_id is kept. Components are numbered by falling eigenvalue, of equal ones in no
    stated order. A component without variance (below 1e-10 of the largest) can't be scaled to one and has no rows, so a table of one distinct
    vector, like an empty one, gives none. Entries beyond 2^31 / 64 count as that; a deviation beyond the longs as the largest. Other columns are passed over.
    """
    spark = ready(vectors.sparkSession)
    rows = _integers(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components, block)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    dims, k = len(model.sums), len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            if m := batch.num_rows:
                x = matrix(batch.column(1), dims, MOST)
                each = np.repeat(np.arange(m), k)
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                columns = [np.full(m * k, model.n), model.deviations(x)[each], model.whitened(x).ravel(), (model.values / model.trace)[number - 1], np.full(m * k, model.identity_error)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), pa.array(number), *map(pa.array, columns)], names)

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir):
    """Every embedding in the sixteen whitened components of largest variance. Nulls, ties, repeated rows and empty tables as in whiten."""
    return whiten(table(ready(spark), sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
