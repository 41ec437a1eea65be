"""Sums of products for all pairs of rows of a sparse matrix, by blocks.

``cells`` is a matrix in long form (row, column, whole number). Rows and
columns are dealt into blocks by hash; a block of cells is one row of Spark's
table, and every pair of row blocks of a column block is one more, on which a
task multiplies two small dense matrices. A column that all rows share (lines
without a time stand at one) is spread over as many tasks as there are pairs of row blocks,
and no pair of rows is formed before it is summed over a column block.

Exact: numbers are cut into signed limbs of 20 bits; products of limbs summed
over at most 4096 columns stay below 2 ** 53, and the limbs' results are put
together as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BLOCK_ROWS = 256
BLOCK_COLUMNS = 256
LIMB = 20
EXACT_COLUMNS = 4096
_EXACT = pa.decimal128(38, 0)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    size, sign, out = np.abs(x), np.sign(x), []
    while size.any() or not out:
        out.append((sign * (size & ((1 << LIMB) - 1))).astype(np.float64))
        size = size >> LIMB
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of two matrices of whole numbers, exact (object numbers where 64 bits do not hold them)."""
    total: np.ndarray | None = None
    for lo in range(0, a.shape[1], EXACT_COLUMNS):
        x, y = _limbs(a[:, lo : lo + EXACT_COLUMNS]), _limbs(b[:, lo : lo + EXACT_COLUMNS])
        wide = len(x) + len(y) > 2
        part = 0
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                got = (p @ q.T).astype(np.int64)
                part = part + (got.astype(object) * (1 << LIMB * (i + j)) if wide else got)
        total = part if total is None else total.astype(object) + part if wide or total.dtype == object else total + part
    return total if total is not None else np.zeros((len(a), len(b)), np.int64)


def _dense(rows: list, columns: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(np.array(rows, dtype=object), return_inverse=True)
    m = np.zeros((len(names), len(at)), np.int64)
    m[place, np.searchsorted(at, columns)] = values
    return names, m


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ca, cb = np.array(row["ca"], np.int64), np.array(row["cb"], np.int64)
            at = np.intersect1d(ca, cb)
            if not len(at):
                continue
            in_a, in_b = np.isin(ca, at), np.isin(cb, at)
            ra, ma = _dense([r for r, k in zip(row["ra"], in_a) if k], ca[in_a], np.array(row["va"], np.int64)[in_a], at)
            rb, mb = _dense([r for r, k in zip(row["rb"], in_b) if k], cb[in_b], np.array(row["vb"], np.int64)[in_b], at)
            got = products(ma, mb)
            i, j = np.nonzero(got)
            if row["same"]:
                i, j = i[i <= j], j[i <= j]
            values = got[i, j]
            first, second = ra[i], rb[j]
            turned = first > second
            out = pa.array([Decimal(int(v)) for v in values], _EXACT) if values.dtype == object else pa.array(values).cast(_EXACT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(turned, second, first), pa.string()), pa.array(np.where(turned, first, second), pa.string()), out],
                ["a", "b", "product"],
            )


def pair_products(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, product): for rows a <= b that share a column, the sum over columns of the values' products.

    ``cells`` holds each (row, column) once, the column as a whole number; it
    is read twice. Rows are strings, null is none.
    """
    spark = cells.sparkSession
    ship_package(spark)
    size = cells.agg(F.approx_count_distinct(row).alias("r"), F.approx_count_distinct(column).alias("c")).first()
    n_rows, n_columns = -(-int(size["r"]) // BLOCK_ROWS) or 1, -(-int(size["c"]) // BLOCK_COLUMNS) or 1
    dealt = cells.where(F.col(row).isNotNull()).select(
        F.pmod(F.xxhash64(column), F.lit(n_columns)).cast("int").alias("kc"),
        F.pmod(F.xxhash64(row), F.lit(n_rows)).cast("int").alias("kr"),
        F.col(row).alias("r"), F.col(column).cast("long").alias("c"), F.col(value).cast("long").alias("v"),
    )
    block = dealt.groupBy("kc", "kr").agg(F.collect_list(F.struct("r", "c", "v")).alias("x"))
    left = block.select("kc", F.col("kr").alias("from"), F.explode(F.sequence(F.col("kr"), F.lit(n_rows - 1))).alias("kr"), F.col("x").alias("a"))
    pairs = left.join(block, ["kc", "kr"]).select(
        F.col("a.r").alias("ra"), F.col("a.c").alias("ca"), F.col("a.v").alias("va"),
        F.col("x.r").alias("rb"), F.col("x.c").alias("cb"), F.col("x.v").alias("vb"), (F.col("from") == F.col("kr")).alias("same"),
    )
    parts = pairs.mapInArrow(_multiply, "a string, b string, product decimal(38,0)")
    return parts.groupBy("a", "b").agg(F.sum("product").cast("decimal(38,0)").alias("product"))
