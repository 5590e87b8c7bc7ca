"""Metric cells: directions grouped around pivots, pruned by the triangle inequality.

A set of unit vectors is dealt to the nearest of a few pivots (its *cell*).  For a query
direction u, a pivot p and a vector a of p's cell, the angles obey
``|angle(u, p) - angle(a, p)| <= angle(u, a)``, so the angles to the pivots, computed once
a row, decide which cells, and which rows of a cell, can lie within a given angle.

Pivots come from a spherical k-means over a sample of at most ``SAMPLE`` vectors (the
smallest by hash), the only vectors that reach the driver.  They decide how much is
pruned, never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemap.functions.scalar import dot

SAMPLE = 2048
MAX_CELLS = 64
ANGLE_EPS = 1e-6        # rounding of dot products and arc cosines


def n_cells(n_rows: int) -> int:
    """About the square root of the rows, at most ``MAX_CELLS``."""
    return max(1, min(MAX_CELLS, math.isqrt(n_rows)))


def pivots_of(df: DataFrame, unit: str, k: int, rounds: int = 8) -> list[list[float]]:
    """``k`` (or fewer) pivot directions for the unit vectors of ``df``."""
    rows = df.select(unit).orderBy(F.xxhash64(unit)).limit(SAMPLE).collect()
    width = max((len(r[0]) for r in rows), default=0)
    if not width:
        return []
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, :len(r[0])] = r[0]
    # farthest-first seeds, then a few rounds of spherical k-means
    centre, near = [x[0]], x @ x[0]
    while len(centre) < min(k, len(x)) and near.min() < 1 - 1e-9:
        centre.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c.tolist()


def pivot_column(spark, pivots: list[list[float]]) -> Column:
    """The pivots as one scalar (bounded: ``MAX_CELLS`` vectors)."""
    return spark.createDataFrame([(pivots,)], "p array<array<double>>").select("p").scalar()


def angles(unit: str, pivots: str) -> Column:
    """Angles of a unit vector to every pivot."""
    return F.transform(pivots, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit, p)))))


def with_angles(df: DataFrame, unit: str, pivots: list[list[float]], out: str) -> DataFrame:
    """Add ``out``, the angles to the pivots (computed in their own projection)."""
    return (df.withColumn("_piv", pivot_column(df.sparkSession, pivots))
            .withColumn(out, angles(unit, "_piv")).drop("_piv"))


def with_cell(df: DataFrame, unit: str, pivots: list[list[float]], cell: str, angle: str) -> DataFrame:
    """Add the nearest pivot's number and the angle to it."""
    df = with_angles(df, unit, pivots, "_every").withColumn(angle, F.array_min("_every"))
    return df.withColumn(cell, (F.array_position("_every", F.col(angle)) - 1).cast("int")).drop("_every")


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros; a null entry counts as zero."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    n = np.diff(ends)
    out = np.zeros((len(n), width))
    flat = lists.values.slice(ends[0], ends[-1] - ends[0]).fill_null(0.0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    col = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], n)
    out[row[col < width], col[col < width]] = flat[col < width]     # longer queries meet zeros
    return out
