"""Cosine similarities of all columns of one sparse matrix, above a threshold.

The matrix comes in long form (row, column, value).  Two columns meet only through a row
that holds both, so pairs are made from the outer products of rows.  To keep them few and
exact, rows are put in one order, short rows first, and every column keeps the beginning of
its entries in that order (its *prefix*), up to where the norm of the rest falls below the
threshold.  Two columns with cosine >= t share a row within both prefixes: of the two, take
the one whose prefix ends first; were all shared rows behind that end, the product could
not exceed the norm of its rest, which is below t.  Long rows, whose outer products are
large, lie in the rests.  The candidates' cosines are then computed in full, each pair from
the column with fewer entries.

Up to ``FEW_COLUMNS`` columns a task can hold the sums of all pairs: there the outer
products of whole rows are summed where the rows lie, with no candidates, and only one sum
per pair and task is shuffled.

Rows of equal length stand or fall together, so prefixes follow from sums per (column, row
length): no window holds a frequent column's entries.

Defined results: entries of one cell add up; zero and null values, null rows and columns
are dropped; pairs come once, column_a < column_b; negative values are allowed; a cosine
that is the threshold but for rounding (1e-9) counts as reaching it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemap.session import materialise

_EPS = 1e-9
FEW_COLUMNS = 2048      # up to so many columns a task can hold the sums of all pairs (32 MB)
DENSE_ROWS = 512        # rows multiplied at once


def prefix_entries(unit: DataFrame, threshold: float) -> DataFrame:
    """(_row, _col, _x, _rest): the prefix entries of every column and the norm of its rest;
    ``unit`` is (_row, _col, _x) with columns of norm 1."""
    rows = unit.groupBy("_row").agg(F.count(F.lit(1)).alias("_len"))
    e = unit.join(rows, "_row")
    sums = e.groupBy("_col", "_len").agg(F.sum(F.col("_x") * F.col("_x")).alias("_s"))
    behind = Window.partitionBy("_col").orderBy(F.desc("_len")).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_from", F.sum("_s").over(behind))       # squared norm from this length on
    need = threshold * threshold - 4 * _EPS
    kept = sums.where(F.col("_from") >= need)
    rest = sums.groupBy("_col").agg(F.max(F.when(F.col("_from") < need, F.col("_from"))).alias("_r"))
    kept = kept.select("_col", "_len").join(
        rest.select("_col", F.sqrt(F.coalesce("_r", F.lit(0.0))).alias("_rest")), "_col")
    return e.join(kept, ["_col", "_len"]).select("_row", "_col", "_x", "_rest")


def column_candidates(unit: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: every pair that can reach the threshold."""
    p = prefix_entries(unit, threshold)
    left = p.select("_row", F.col("_col").alias("a"), F.col("_x").alias("_xa"), F.col("_rest").alias("_ra"))
    right = p.select("_row", F.col("_col").alias("b"), F.col("_x").alias("_xb"), F.col("_rest").alias("_rb"))
    met = left.join(right, "_row").where("a < b").groupBy("a", "b").agg(
        F.sum(F.col("_xa") * F.col("_xb")).alias("_part"), F.max(F.greatest("_ra", "_rb")).alias("_rest"))
    # what the prefixes share, and at most the larger rest besides
    return met.where(F.col("_part") + F.col("_rest") >= threshold - 1e-6).select("a", "b")


def all_products(unit: DataFrame, out: str) -> DataFrame:
    """(a, b, out) with a < b: the inner products of all column pairs that share a row.  A row
    moves once; tasks sum the outer products of their rows in a matrix over the (at most
    ``FEW_COLUMNS``) columns, and the tasks' sums add up."""
    cols = unit.select("_col").distinct().withColumn("_k", F.row_number().over(Window.orderBy("_col")) - 1)
    width = cols.count()
    rows = unit.join(F.broadcast(cols), "_col").groupBy("_row").agg(
        F.collect_list("_k").alias("_ks"), F.collect_list("_x").alias("_xs"))       # bounded by the columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for whole in batches:
            for at in range(0, whole.num_rows, DENSE_ROWS):
                ks, xs = (whole.slice(at, DENSE_ROWS).column(i) for i in (0, 1))
                part = np.zeros((len(ks), width))
                of_row = np.repeat(np.arange(len(ks)), np.diff(ks.offsets.to_numpy()))
                part[of_row, ks.flatten().to_numpy()] = xs.flatten().to_numpy()
                total += part.T @ part
        a, b = np.nonzero(np.triu(total, 1))
        for at in range(0, len(a), 100_000):
            i, j = a[at:at + 100_000], b[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(total[i, j])], ["_a", "_b", out])

    sums = rows.select("_ks", "_xs").mapInArrow(run, f"_a int, _b int, {out} double")
    sums = sums.groupBy("_a", "_b").agg(F.sum(out).alias(out))
    named = lambda k, c: cols.select(F.col("_k").alias(k), F.col("_col").alias(c))
    return sums.join(F.broadcast(named("_a", "a")), "_a").join(F.broadcast(named("_b", "b")), "_b").select("a", "b", out)


def column_similarities(entries: DataFrame, row: str, column: str, value: str, threshold: float,
                        out: str = "sim") -> DataFrame:
    """(``column``_a, ``column``_b, out) of all column pairs with cosine >= ``threshold`` > 0."""
    if threshold <= 0:
        raise ValueError("column_similarities needs threshold > 0 (columns without a common row have cosine 0)")
    cells = entries.select(F.col(row).alias("_row"), F.col(column).alias("_col"), F.col(value).cast("double").alias("_v"))
    cells = cells.where("_row IS NOT NULL AND _col IS NOT NULL").groupBy("_row", "_col").agg(
        F.sum("_v").alias("_v")).where("_v <> 0")
    norms = cells.groupBy("_col").agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"),
                                      F.count(F.lit(1)).alias("_c"))
    unit = materialise(cells.join(norms, "_col").select(
        "_row", "_col", (F.col("_v") / F.col("_n")).alias("_x"), "_c"), "columns-unit")
    if unit.select("_col").distinct().count() <= FEW_COLUMNS:
        return _reached(all_products(unit, out), column, threshold, out)
    pairs = column_candidates(unit.select("_row", "_col", "_x"), threshold)
    size = unit.select("_col", "_c").distinct()
    pairs = (pairs.join(size.select(F.col("_col").alias("a"), F.col("_c").alias("_ca")), "a")
             .join(size.select(F.col("_col").alias("b"), F.col("_c").alias("_cb")), "b"))
    few = F.col("_ca") <= F.col("_cb")
    pairs = pairs.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("_few"),
                         F.when(few, F.col("b")).otherwise(F.col("a")).alias("_many"))
    x = unit.select(F.col("_col").alias("_few"), "_row", F.col("_x").alias("_x1"))
    y = unit.select(F.col("_col").alias("_many"), "_row", F.col("_x").alias("_x2"))
    dots = pairs.join(x, "_few").join(y, ["_many", "_row"]).groupBy("a", "b").agg(
        F.sum(F.col("_x1") * F.col("_x2")).alias(out))
    return _reached(dots, column, threshold, out)


def _reached(dots: DataFrame, column: str, threshold: float, out: str) -> DataFrame:
    return dots.where(F.col(out) >= threshold - _EPS).select(
        F.col("a").alias(f"{column}_a"), F.col("b").alias(f"{column}_b"), out)
