"""Whitening of vectors: counts, means and centred scatters merged pairwise, eigenvectors, and a second pass that checks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, settle, spread

#: Entries are whole multiples of 1 / SCALE; components that are returned, at most.
SCALE, COMPONENTS = 256, 4
#: A component whose share of the variance is no more than this has none.
LEAST_SHARE = 1e-12
#: Vectors of a partition that are centred at a time.
ROWS = 4096


#: Count, sums, mean and centred scatter of some vectors. Sums are exact where the vectors are whole numbers.
Moments = tuple[int, list, np.ndarray, np.ndarray]


def moments_of(rows: np.ndarray) -> Moments:
    whole = np.issubdtype(rows.dtype, np.integer)
    large = whole and float(np.abs(rows).max()) * len(rows) >= 2.0**62
    sums = [sum(map(int, c)) for c in rows.T] if large else rows.sum(axis=0).tolist()
    mean = np.array([s / len(rows) for s in sums])
    apart = rows - mean
    return len(rows), sums, mean, apart.T @ apart


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of both together, from their own alone (Chan)."""
    n = a[0] + b[0]
    apart = b[2] - a[2]
    sums = [x + y for x, y in zip(a[1], b[1], strict=True)]
    return n, sums, np.array([s / n for s in sums]), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _matrix(held: pa.Array) -> np.ndarray:
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def moments(rows: DataFrame, vector: str, change=lambda x: x) -> Moments | None:
    """Moments of a column of vectors of one length, after ``change`` of each matrix: one value a partition, merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            matrix = _matrix(batch.column(0))
            for at in range(0, len(matrix), ROWS):
                one = moments_of(change(matrix[at : at + ROWS]))
                have = merged(have, one) if have else one
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(have)], pa.binary())], ["m"])

    parts = rows.select(vector).mapInArrow(local, "m binary").rdd.map(lambda r: pickle.loads(r["m"]))
    depth = max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), 16)))
    return parts.treeAggregate(None, _either, _either, depth)


def _either(a: Moments | None, b: Moments | None) -> Moments | None:
    return merged(a, b) if a and b else a or b


def components_of(fitted: Moments, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (d, k), variances (k) and shares of the whole variance (k) of the components by falling variance."""
    covariance = fitted[3] / fitted[0]
    values, axes = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > LEAST_SHARE * trace] if trace > 0 else order[:0]
    return axes[:, order], values[order], values[order] / (trace or 1.0)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Squared length of n times each row less the sums, as exact whole numbers."""
    most = n * float(np.abs(rows).max()) + max(map(abs, sums)) if rows.size else 0.0
    if most * most * rows.shape[1] < 2.0**62:
        apart = n * rows - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1)
    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in rows]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation is beyond a long")
    return np.array(exact, np.int64)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error of each row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry go, and so do those of another length than
    most have (the longer one of lengths as frequent). Every distinct vector of whole numbers counts once in the fit.
    A component without variance is not returned: one distinct vector gives no row, and an empty table none.
    Repeated rows and null ids stay; equal eigenvalues leave the choice of axes open, in a rerun too.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    kept = rows.select(col(id_col).alias("i"), col(vector_col).alias("v")).filter(F.coalesce(F.forall("v", good) & (F.size("v") > 0), F.lit(False)))
    long = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    out = "i {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kept.schema["i"].dataType.simpleString())
    none = lambda: rows.sparkSession.createDataFrame([], out).withColumnRenamed("i", id_col)
    if long is None:
        return none()
    whole = F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    of_length = kept.filter(F.size("v") == long["d"])
    distinct = settle(of_length.select(whole.alias("x")).distinct())
    fitted = moments(distinct, "x")
    axes, values, explained = components_of(fitted, components)
    if not len(values):
        return none()
    n, sums, mean, _ = fitted
    shared = rows.sparkSession.sparkContext.broadcast((n, sums, mean, axes / np.sqrt(values)))  # a few vectors
    second = moments(distinct, "x", lambda x: (x - shared.value[2]) @ shared.value[3])
    error = float(np.abs(second[3] / second[0] - np.eye(len(values))).max())

    @F.arrow_udf("deviation long, whitened array<double>")
    def change(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n, sums, mean, by = shared.value
        for held in batches:
            x = _matrix(held) if len(held) else np.zeros((0, len(sums)), np.int64)
            yield pa.StructArray.from_arrays([pa.array(deviations(x, n, sums), pa.int64()), pa.array(list((x - mean) @ by), pa.list_(pa.float64()))], ["deviation", "whitened"])

    done = spread(of_length.select("i", "v")).select("i", change(whole).alias("y")).select("i", "y.deviation", F.posexplode("y.whitened").alias("k", "whitened"))
    share = F.array(*(F.lit(float(x)) for x in explained))
    return done.select(
        F.col("i").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
