"""Whitening of embeddings by shifted Cholesky QR: Gram passes on Spark, triangular factors on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litflow.llm.centroids import finite, rows_of
from litflow.llm.common import stored

#: x = floor(SCALE * c) + SHIFT; beyond ``LIMIT`` a scaled component counts as ``LIMIT``.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 31
#: Orthogonalising passes at most, and how far from the identity the last Gram matrix may be.
PASSES, NEAR = 6, 1e-12
#: Directions of an almost orthogonal matrix with this little square length are rounding, and so are components whose
#: variance is this small a part of the largest.
DEAD, RANK = 1e-14, 1e-24


def _exact(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, x) of the rows without null or non-finite entries."""
    limit = F.lit(float(LIMIT))
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("c")).where((F.size("c") > 0) & finite(F.col("c")))
    return kept.select("id", F.transform("c", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)) + SHIFT).alias("x"))


def _width(fit: DataFrame) -> int | None:
    """The commonest length, of several the smallest."""
    row = fit.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return None if row is None else row["w"]


def _gram(fit: DataFrame, width: int, form: Callable[[np.ndarray], np.ndarray], out: int) -> np.ndarray:
    """Sum of y yᵀ over the rows y = form(x) of ``out`` entries: one triangle of each task is shuffled and added."""
    upper = np.triu_indices(out)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((out, out))
        for batch in batches:
            if batch.num_rows:
                y = form(rows_of(batch.column(0), width))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], ["at", "v"])

    sums = fit.select("x").mapInArrow(run, "at int, v double").where("v <> 0").groupBy("at").agg(F.sum("v").alias("v"))
    g = np.zeros((out, out))
    for r in sums.collect():  # out * (out + 1) / 2 numbers
        g[upper[0][r["at"]], upper[1][r["at"]]] = r["v"]
    return g + np.triu(g, 1).T


def _cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor R of g + shift = RᵀR; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * np.trace(g), np.finfo(float).tiny)


class Whitening:
    """n, S, unit components (columns), their variances e, the whole variance, and the measured error."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, e: np.ndarray, trace: float, passes: int) -> None:
        self.n, self.sums, self.components, self.e, self.trace, self.passes = n, sums, components, e, trace, passes
        self.error = 0.0

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        return _centred(self.n, self.sums)

    def whitener(self) -> Callable[[np.ndarray], np.ndarray]:
        centred, scaled = self.centred(), self.components / np.sqrt(self.e)
        return lambda x: centred(x) @ scaled


def _centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n as whole part and rest: nothing cancels, however large n or the shift."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(float) - rest


def fit_whitening(exact: DataFrame, components: int) -> tuple[Whitening | None, DataFrame]:
    """The model of the distinct vectors of (id, x), and the rows it holds for: those of the commonest length.

    Centred rows A are orthogonalised by A = Q R: a pass sums the Gram matrix of Q, whose Cholesky factor (shifted in
    the first pass) goes into R, until the Gram matrix is near the identity; directions that A does not have are left
    out after the second pass. The root of the last Gram matrix times R has the singular values and right vectors of A.
    """
    fit = exact.select("x").distinct()
    fit = stored(fit)
    width = _width(fit)
    if width is None:
        return None, exact.limit(0)
    fit, rows = fit.where(F.size("x") == width), exact.where(F.size("x") == width)
    sums = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    centred = _centred(n, s)
    g = _gram(fit, width, centred, width)
    trace = float(np.trace(g)) / n
    if trace <= 0:
        return None, rows.limit(0)
    eps = np.finfo(float).eps / 2
    r = _cholesky(g, 11 * (n * width + width * (width + 1)) * eps * float(np.linalg.norm(g, 2)) if n * width < 1 / (100 * eps) else 1e-3 * float(np.linalg.norm(g, 2)))
    passes, turned = 1, np.linalg.inv(r)  # Q = A turned, A = Q r
    while True:
        g = _gram(fit, width, lambda x, t=turned: centred(x) @ t, turned.shape[1])
        passes += 1
        values, vectors = np.linalg.eigh(g)
        live = values > DEAD
        if not live.all():  # A has fewer directions than columns: go on with those it has
            values, vectors = values[live], vectors[:, live]
            turned, r, g, vectors = turned @ vectors, vectors.T @ r, np.diag(values), np.eye(len(values))
        if np.abs(values - 1).max() <= NEAR * width or passes >= PASSES:
            break
        more = _cholesky(g, 0.0)
        turned, r = turned @ np.linalg.inv(more), more @ r
    _, sigma, right = np.linalg.svd(np.sqrt(values)[:, None] * vectors.T @ r, full_matrices=False)
    e = sigma**2 / n
    keep = min(components, int((e > RANK * e[0]).sum()))
    model = Whitening(n, s, right[:keep].T.copy(), e[:keep], trace, passes)
    model.error = float(np.abs(_gram(fit, width, model.whitener(), keep) / n - np.eye(keep)).max())
    return model, rows


def whiten(vectors: DataFrame, components: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, error of the fit) for each row and component.

    Entries c become x = floor(64 c) + 1000000; the covariance is that of the distinct x (n of them, sums S, divisor
    n, centred first). Rows whose vector is null, empty, or holds a null or non-finite entry have no result, nor have
    rows of another length than the commonest of the distinct vectors (of several the smallest). Components number
    from 1 by falling variance; fewer come if the vectors have fewer directions, and none if all are equal or there
    are none. Repeated rows and null ids are rows like others; other columns are not looked at. ``deviation`` is
    exact, and null where it exceeds a long. Components beyond 2^25 before scaling count as that.
    """
    exact = _exact(vectors, vec_id, embedding)
    kind = exact.schema["id"].dataType
    schema = T.StructType([
        T.StructField(vec_id, kind),
        *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields,
    ])
    model, rows = fit_whitening(exact, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, width, k = model.n, len(model.sums), len(model.e)
    whole, rest = [s // model.n for s in model.sums], [s % model.n for s in model.sums]
    white, explained, error = model.whitener(), model.e / model.trace, model.error

    def deviations(x: np.ndarray) -> list[int | None]:
        off = x - np.array(whole, np.int64)
        if float(np.abs(off).max(initial=0) + 1) * n < (1 << 31) / width**0.5:
            return ((off * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact_sums = (sum((int(v) * n - b) ** 2 for v, b in zip(row, rest, strict=True)) for row in off.tolist())
        return [d if d < 1 << 63 else None for d in exact_sums]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = rows_of(batch.column(1), width)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array(white(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
