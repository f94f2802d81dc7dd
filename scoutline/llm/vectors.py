"""Rows with vectors: which take part, matrices of Arrow batches, bounded samples, and tiles for joins of blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Components that a task holds of one side of a tile, and that a sample has, at most.
TILE_VALUES, SAMPLE_VALUES = 1 << 20, 1 << 20


def usable(rows: DataFrame, ident: str, vector: str, *others: str, factor: int = 1) -> DataFrame:
    """(ident long, others, vector) of rows that have an id and a vector of components finite also as so many times themselves.

    Of rows with one id the least (others, vector) counts. The vector is an array of floats where it was, else of doubles.
    """
    kind = rows.schema[vector].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    limit = F.lit(float("inf")).cast("double")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * factor) < limit, F.lit(False)))
    kept = rows.select(F.col(ident).cast("long").alias(ident), *others, F.col(vector).cast(f"array<{number}>").alias(vector))
    kept = kept.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).where(finite)
    if kept.groupBy(ident).count().where("count > 1").isEmpty():
        return kept
    return kept.groupBy(ident).agg(F.min(F.struct(*others, vector)).alias("r")).select(ident, *[F.col("r")[c].alias(c) for c in (*others, vector)])


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles; shorter ones are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    if len(lists):
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def as_lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists of doubles."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel(), pa.float64()))


def sample(rows: DataFrame, ident: str, vector: str, total: int, width: int, most: int) -> pa.Table:
    """At most so many rows, and SAMPLE_VALUES components, of least hash of their id, on the driver; total: the number of rows."""
    n = max(1, min(most, SAMPLE_VALUES // max(width, 1)))
    h = F.xxhash64(F.lit(17), ident)
    if total > 2 * n:  # about 1.5 n rows pass, far fewer than the 2 ** 20 parts would tell apart of any table
        part = max(1, round(1.5 * n / total * (1 << 20)))
        rows = rows.where(F.pmod(h, F.lit(1 << 20)) < part)
    return rows.withColumn("_h", h).orderBy("_h", ident).limit(n).drop("_h").toArrow()


@dataclass(frozen=True)
class Tiles:
    """How many rows of a group make a block on either side of a join of blocks."""

    width: int

    def count(self, rows: Column | str) -> Column:
        """Blocks of a group of so many rows, at least one."""
        size = max(16, TILE_VALUES // max(self.width, 1))
        return F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(rows) if isinstance(rows, str) else rows, F.lit(0)) / size)).cast("int")

    @staticmethod
    def block(ident: str, count: str) -> Column:
        """The block that a row falls into."""
        return F.pmod(F.xxhash64(F.lit(5), ident), F.col(count)).cast("int")

    @staticmethod
    def every(count: str) -> Column:
        """One row for each block of the other side."""
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))
