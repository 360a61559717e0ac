"""Vectors shared by the two searches: which take part, and one node for equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, vec array<double>) of the rows whose vectors hold finite numbers only (and, if asked, aren't zero)."""
    vec = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    good &= F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    if nonzero:
        good &= F.exists(vec, lambda x: x != 0)
    return table.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def nodes_and_members(vectors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the distinct vectors, id being their least vec_id, and (id, vec_id) of the `most` least ids of each.

    Equal vectors tie in every search, and ties go to the smaller vec_id: no answer needs more than `most` of them. Both are
    combined before the shuffle, so one vector may hold any share of the rows.
    """
    nodes = vectors.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec")
    key = vectors.select("vec_id", "vec", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id")).alias("k")).where(F.col("k") <= most)
    members = key.select(F.first_value("vec_id").over(Window.partitionBy("vec").orderBy("vec_id")).alias("id"), "vec_id")
    return nodes, members


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    n = len(column)
    return np.asarray(column.flatten(), dtype=dtype).reshape(n, -1) if n else np.empty((0, 0), dtype)
