"""Vector scores as columns, and the nearest rows."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a worker scores at once, about; more rows are scored slice by slice.
AT_ONCE = 1 << 20


def _scored(column: Column, query: list[float], score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """score(rows, query) in double precision, over Arrow batches of this column alone; null where a vector is null, holds a null or has another length."""
    q = np.array(query, np.float64)
    size = len(q)

    def scores(vectors: pa.Array) -> pa.Array:
        good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False))
        if vectors.flatten().null_count:
            holes = pc.is_null(vectors.flatten()).to_numpy(zero_copy_only=False)
            good[np.asarray(pc.list_parent_indices(vectors))[holes]] = False
        numbers = np.asarray(vectors.filter(pa.array(good)).flatten()).reshape(int(good.sum()), size)
        step = max(1, AT_ONCE // max(size, 1))
        told = np.zeros(len(good))
        # sums row by row, not a matrix product: equal vectors must have equal scores wherever they stand
        told[good] = np.concatenate([np.zeros(0), *(score(numbers[k : k + step].astype(np.float64), q) for k in range(0, len(numbers), step))])
        return pa.array(told, mask=~good)

    return F.arrow_udf(scores, "double")(column)


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x * q).sum(1)


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    sizes = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    return np.divide(_dot(x, q), sizes, out=np.zeros(len(x)), where=sizes != 0)


def _euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.sqrt(((x - q) ** 2).sum(1)))


def dot(column: Column, query: list[float]) -> Column:
    return _scored(column, query, _dot)


def cosine(column: Column, query: list[float]) -> Column:
    """0 where a norm is 0."""
    return _scored(column, query, _cosine)


def euclidean(column: Column, query: list[float]) -> Column:
    """1 / (1 + distance)."""
    return _scored(column, query, _euclidean)


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def nearest(df: DataFrame, field: str, query: list[float], k: int, metric: str = "cosine", dimensions: int | None = None, where: Column | None = None, id_col: str = "_id") -> DataFrame:
    """The k rows of the highest score, ties by id: filter, score, then a top-k in each task and one merge."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if dimensions is not None and len(query) != dimensions:
        raise ValueError(f"the query has {len(query)} dimensions, the index {dimensions}")
    rows = df if where is None else df.where(where)
    rows = rows.where(F.size(field) == len(query))  # also drops nulls
    return rows.withColumn("_score", METRICS[metric](F.col(field), query)).orderBy(F.desc("_score"), F.asc(id_col)).limit(k)
