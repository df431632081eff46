"""Embedding whitening (operator 11).

Entries become whole numbers, so sums and deviations are exact.  MLlib's
``computeSVD`` takes the centred rows, which stay distributed: a singular value
s of n rows stands for the variance s^2 / n.  The total variance is the sum of
the exact deviations and doesn't come from the decomposition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import tidy
from .scratch import Scratch

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries above take no part: their sums and squares would leave 64 bits at once.
LARGEST = float(1 << 30)
#: Singular values below this share of the largest are noise; so small a variance can't be whitened.
LEAST_SHARE = 1e-5
#: Rows of a slice whose matrices are in memory at the same time.
ROWS = 1024
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """Row count, sums of each dimension, unit eigenvectors as columns, their variances, and the total variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    variances: np.ndarray
    total: float


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part: entries all there, finite, at most LARGEST, and as many as most rows have."""
    good = F.forall("embedding", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good)
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return rows.where(F.size("embedding") == (usual.length if usual else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def column_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Row count and exact sum of each dimension; a task sends one row a dimension and slice of its input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = _matrix(batch.column(0)).sum(0)
                yield pa.RecordBatch.from_pydict({"dimension": pa.array(range(-1, len(sums)), pa.int32()), "total": pa.array([batch.num_rows, *sums.tolist()], pa.int64())})

    parts = rows.select("x").mapInArrow(tidy(add), "dimension int, total long")
    found = dict(parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())  # a row a dimension
    return int(found.pop(-1, 0)), tuple(int(found[i]) for i in range(len(found)))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that is enough, Python's integers otherwise."""
    most = max(int(np.abs(x).max()), 1) if x.size else 1
    if 2 * n * most < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(numerators: np.ndarray) -> list[int]:
    """Sum of the squares of each row, exact."""
    most = max(abs(int(numerators.max())), abs(int(numerators.min()))) if numerators.size else 0
    if numerators.dtype != object and most * most * numerators.shape[1] < 1 << 63:
        return (numerators * numerators).sum(1).tolist()
    return (numerators.astype(object) ** 2).sum(1).tolist()


def _vectors(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One column ``v`` of vectors: ``make`` of the rows' whole numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = np.ascontiguousarray(make(_matrix(batch.column(0))), np.float64)
            starts = pa.array(np.arange(0, made.size + 1, made.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(starts, pa.array(made.ravel()))], ["v"])

    return rows.select("x").mapInArrow(tidy(work), "v array<double>").select(array_to_vector("v").alias("v"))


def _row_matrix(vectors: DataFrame, n: int, width: int) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, width)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of largest variance over all ``rows`` of (vec_id, x); none if no row differs from another.

    Asking the decomposition for over half of the dimensions makes it go by
    the Gramian matrix, which is one pass over the rows and exact to double
    precision; its size follows the dimensions and not the rows.
    """
    n, sums = column_sums(rows)
    width = len(sums)
    if not n:
        return Fit(0, sums, np.zeros((width, 0)), np.zeros(0), 0.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_pydict({"v": [float(sum(deviations(centred(_matrix(batch.column(0)), n, sums)))) / n / n]})

    total = rows.select("x").mapInArrow(tidy(spread), "v double").agg(F.sum("v")).first()[0] / n
    if total == 0:
        return Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    matrix = _row_matrix(_vectors(rows, lambda x: centred(x, n, sums).astype(np.float64) / n), n, width)
    found = matrix.computeSVD(min(width, max(components, width // 2 + 1)), computeU=False, rCond=LEAST_SHARE)
    vectors, singular = found.V.toArray()[:, :components], found.s.toArray()[:components]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Fit(n, sums, vectors * signs, singular**2 / n, total)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    width = len(model.variances)
    made = _vectors(rows, lambda x: _whitened(x, model))
    middle = made.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    around = _vectors(rows, lambda x: _whitened(x, model) - middle)
    gram = _row_matrix(around, model.n, width).computeGramianMatrix().toArray()
    return float(np.abs(gram / model.n - np.eye(width)).max())


def _whitened(x: np.ndarray, model: Fit) -> np.ndarray:
    return (centred(x, model.n, model.sums).astype(np.float64) / model.n) @ (model.vectors / np.sqrt(model.variances))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``embeddings`` has a whole-number vec_id and an array ``embedding``.  Rows
    take no part whose vector is null, empty, of another length than most rows
    have, or holds null, NaN, an infinity or an entry above 2^30.  Rows that
    repeat, or have no id, count and come out each for itself.  A component's
    sign makes its largest entry positive.  Components whose singular value is
    below LEAST_SHARE of the largest have no variance to rescale and are left
    out, so equal rows, a single row and an empty table give no rows; vectors
    of fewer dimensions than ``components`` give fewer.  A deviation of over
    38 digits is null.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = Scratch(spark, "whitening").keep(whole_numbers(embeddings), "whole")
    model = fit(rows, components)
    width = len(model.variances)
    if not width:
        return spark.createDataFrame([], RESULT)
    error = identity_error(rows, model)
    explained = model.variances / model.total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch.column(1))
            exact = [d if d < 10**38 else None for d in deviations(centred(x, model.n, model.sums))]
            small = all(d is not None and d < 1 << 63 for d in exact)
            exact = pa.array(exact, pa.int64()).cast(pa.decimal128(38, 0)) if small else pa.array([None if d is None else _decimal(d) for d in exact], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), exact.take(each),
                    pa.array(_whitened(x, model).ravel()), pa.array(np.tile(explained, len(x))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    made = rows.mapInArrow(tidy(project), "vec_id long, component int, deviation decimal(38,0), whitened double, explained double")
    return made.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def _decimal(whole: int):
    from decimal import Decimal

    return Decimal(whole)


def digest_columns(whitened: DataFrame) -> DataFrame:
    """With deviations as 64-bit numbers, null where one doesn't fit."""
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))
