"""An approximate vector index: cells around centroids, saved as a table partitioned by cell; a search reads the few cells nearest to it."""

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import nearest

#: Vectors that centroids are fitted on, at most; rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12


def centroids_of(x: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        gaps = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        own = gaps.argmin(1)
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for k, i in zip(np.flatnonzero(n == 0), np.argsort(-gaps.min(1))):
            c[k] = x[i]
    return c


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose squared distances order as the metric does: unit vectors for cosine."""
    if metric != "cosine":
        return x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def build(df: DataFrame, field: str, dimensions: int, path: str, metric: str = "cosine", cells: int | None = None, id_col: str = "_id", keep=()) -> dict:
    """Index every row whose vector has `dimensions` numbers, at `path`; returns the index: its cells, and how many rows were indexed and left out.

    Centroids come from a sample of at most SAMPLE rows; all rows are then dealt to cells in one pass without a shuffle of vectors but by cell.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"an approximate index has no metric {metric}")
    rows = df.select(id_col, *keep, F.col(field).cast("array<float>").alias(field))
    good = rows.where((F.size(field) == dimensions) & ~F.exists(field, lambda v: v.isNull() | F.isnan(v)))
    total, n = rows.count(), good.count()
    sample = good.select(field).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < math.ceil(SAMPLE / max(n, 1) * (1 << 20))).limit(SAMPLE).collect()
    x = prepared(np.array([r[0] for r in sample], np.float64).reshape(-1, dimensions), metric)
    cells = min(cells or max(1, round(math.sqrt(n) / 2)), max(1, len(x)), 4096)
    c = centroids_of(x, cells) if len(x) else np.zeros((1, dimensions))

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        y = prepared(np.asarray(v.flatten(), np.float64).reshape(len(v), dimensions), metric)
        return pa.array(((c * c).sum(1) - 2 * y @ c.T).argmin(1).astype(np.int32))

    good.withColumn("cell", cell(field)).repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index = {"field": field, "dimensions": dimensions, "metric": metric, "indexed": n, "left_out": total - n, "id_col": id_col}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(index), c.tolist())], "index string, centroids array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return index


def search(spark: SparkSession, path: str, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """The k nearest rows of the `probes` nearest cells (by default a quarter of them, 8 at least), by exact scores. Other cells aren't read."""
    saved = spark.read.parquet(f"{path}/cells").first()
    index, c = json.loads(saved["index"]), np.array(saved["centroids"])
    if len(query) != index["dimensions"]:
        raise ValueError(f"the query has {len(query)} dimensions, the index {index['dimensions']}")
    q = prepared(np.array([query], np.float64), index["metric"])[0]
    order = np.argsort(((c - q) ** 2).sum(1), kind="stable")[: probes or max(8, len(c) // 4)]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(*order.tolist())).drop("cell")
    return nearest(rows, index["field"], query, k, index["metric"], index["dimensions"], where, index["id_col"])
