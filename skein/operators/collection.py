"""Collections: a table under a name, with the document API on top."""

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import crypto
from skein.functions.filters import FilterError, compile_filter
from skein.functions.vectors import METRICS, nearest
from skein.operators import audit, pipeline, updates
from skein.operators.schema import Schema

SYSTEM = {"_audit", "_schema"}


def check_name(name: str) -> str:
    if not name or "::" in name or len(name.encode()) > 128 or name.startswith("_") and name not in SYSTEM:
        raise FilterError(f"not a collection name: {name!r}")
    return name


class Collection:
    """Reads are lazy plans; writes return the collection after them, whose plan can be saved.

    Every write stamps _changed_at. With a caller, `log` gathers audit entries of each write; with a schema, rows are checked as they
    are written and upgraded as they are read; with `secret` (fields -> types, and a key), these fields are stored encrypted.
    """

    def __init__(self, df: DataFrame, name: str = "docs", id_col: str = "_id", indexes: dict | None = None, schema: Schema | None = None, caller: str | None = None, log: DataFrame | None = None, secret: tuple[dict, bytes] | None = None):
        self.df, self.name, self.id_col = df, check_name(name), id_col
        self.indexes = indexes or {"btree": [], "compound": [], "fts": [], "vector": {}}
        self.schema, self.caller, self.log, self.secret = schema, caller, log, secret

    def _with(self, df: DataFrame) -> "Collection":
        log = self.log
        if self.caller:
            before, after = (x.drop("_changed_at") for x in (self.df, df))
            told = audit.entries(updates.changes_between(before, after, self.id_col), self.name, self.caller, updates.now_ms(), id_col=self.id_col)
            log = told if log is None else log.unionByName(told)
        return Collection(df, self.name, self.id_col, self.indexes, self.schema, self.caller, log, self.secret)

    def rows(self) -> DataFrame:
        """Documents as they are read: decrypted and upgraded. aggregate() sees them as stored."""
        df = crypto.decrypted(self.df, *self.secret, self.id_col) if self.secret else self.df
        return self.schema.read(df) if self.schema else df

    def _stored(self, rows: DataFrame, label: str) -> DataFrame:
        rows = self.schema.written(rows, label) if self.schema else rows
        return crypto.encrypted(rows, [f for f in self.secret[0] if f in rows.columns], self.secret[1], self.id_col) if self.secret else rows

    def find(self, where=None, sort: dict | None = None, skip: int = 0, limit: int | None = None, fields: list[str] | None = None, timeout: float | None = None) -> DataFrame:
        """Filter, sort, skip, limit, project. Pages without a sort go along the ids. With a timeout the rows are computed at once and kept."""
        df = self.rows()
        out = df.where(compile_filter(where, df.schema))
        if sort:
            out = out.orderBy(*pipeline.sort_columns(sort, out, self.id_col))
        elif skip or limit is not None:
            out = pipeline.in_id_order(out, self.id_col)
        out = out.offset(skip) if skip else out
        out = out if limit is None else out.limit(limit)
        out = out.select([F.col(f"`{c}`") for c in out.columns if c == self.id_col or c in fields]) if fields else out
        return out if timeout is None else within(out, timeout)

    def page(self, number: int = 1, size: int = 50) -> dict:
        """A page of all documents along the ids, for browsing: 1 to 500 documents, numbered from 1; out of range is clamped."""
        number, size, total = max(1, number), min(max(1, size), 500), self.count()
        return {"documents": self.find(skip=(number - 1) * size, limit=size), "total": total, "page": number, "per_page": size, "pages": max(1, -(-total // size))}

    def find_one(self, where=None) -> DataFrame:
        return self.find(where, limit=1)

    def find_by_id(self, key) -> DataFrame:
        return self.find({self.id_col: key}).limit(1)

    def find_by_ids(self, keys: DataFrame) -> DataFrame:
        return updates.looked_up(self.rows(), keys, self.id_col)

    def count(self, where=None) -> int:
        return self.find(where).count()

    def aggregate(self, stages: list[dict]) -> DataFrame:
        return pipeline.aggregate(self.df, stages, self.id_col)

    def find_nearest(self, field: str, query: list[float], k: int, where=None) -> DataFrame:
        index = self.indexes["vector"].get(field)
        if index is None:
            raise FilterError(f"no vector index on {field}")
        df = self.rows()
        return nearest(df, field, query, k, index["metric"], index["dimensions"], None if not where else compile_filter(where, df.schema), self.id_col)

    def insert_many(self, rows: DataFrame, made_id=None, stamp=None) -> "Collection":
        """Rows get new ids (or `made_id`) and lose fields that are the engine's own."""
        new = updates.fresh(rows, self.id_col, stamp, made_id)
        return self._with(self.df.unionByName(self._stored(new, "insert"), allowMissingColumns=True))

    def insert_with_ids(self, rows: DataFrame) -> "Collection":
        """Rows with ids of their own, stored as they are."""
        return self._with(self.df.unionByName(self._stored(rows, "insert"), allowMissingColumns=True))

    def replace_many_with_ids(self, rows: DataFrame, revision: str | None = None) -> "Collection":
        return self._with(updates.upserted(self.df, self._stored(rows, "replace"), self.id_col, revision))

    def update_many(self, where, update: dict, stamp=None) -> "Collection":
        return self._with(updates.updated(self.df, where, update, updates.now_ms() if stamp is None else stamp))

    def update_one(self, where, update: dict, stamp=None) -> "Collection":
        first = self.find_one(where).select(self.id_col).collect()
        return self.update_many({self.id_col: first[0][0]}, update, stamp) if first else self

    def delete_many(self, where) -> "Collection":
        return self._with(updates.deleted(self.df, where))

    def delete_one(self, where) -> "Collection":
        first = self.find_one(where).select(self.id_col).collect()
        return self._with(updates.deleted(self.df, {self.id_col: first[0][0]})) if first else self

    def create_index(self, field: str) -> None:
        self.indexes["btree"] = sorted({*self.indexes["btree"], field})

    def create_compound_index(self, fields: list[str]) -> None:
        if len(fields) < 2 or len(set(fields)) < len(fields) or any(not f or "::" in f for f in fields):
            raise FilterError(f"not fields of a compound index: {fields}")
        if tuple(fields) not in self.indexes["compound"]:
            self.indexes["compound"].append(tuple(fields))

    def create_fts_index(self, field: str) -> None:
        self.indexes["fts"] = sorted({*self.indexes["fts"], field})

    def create_vector_index(self, field: str, dimensions: int, metric: str = "cosine") -> None:
        if metric not in METRICS:
            raise FilterError(f"unknown metric {metric}")
        self.indexes["vector"].setdefault(field, {"dimensions": dimensions, "metric": metric})

    def vector_coverage(self, field: str) -> DataFrame:
        """(indexed, left_out): how many rows have a vector of the index's length, and how many a search passes over."""
        good = F.coalesce(F.size(F.col(field)) == self.indexes["vector"][field]["dimensions"], F.lit(False))
        return self.rows().agg(F.count_if(good).alias("indexed"), F.count_if(~good).alias("left_out"))

    def drop_index(self, kind: str, field) -> None:
        field = tuple(field) if kind == "compound" else field
        if field not in self.indexes[kind]:
            raise FilterError(f"no {kind} index on {field}")
        self.indexes[kind].pop(field) if kind == "vector" else self.indexes[kind].remove(field)

    def list_indexes(self) -> dict:
        return {"btree": list(self.indexes["btree"]), "fts": list(self.indexes["fts"]), "vector": sorted(self.indexes["vector"])}


class QueryTimeout(TimeoutError):
    """A query that took longer than it was given."""


def within(df: DataFrame, seconds: float) -> DataFrame:
    """df, computed and kept; its jobs are cancelled after so many seconds."""
    context, tag = df.sparkSession.sparkContext, f"skein-{uuid.uuid4().hex}"
    late: list = []

    def stop() -> None:
        late.append(True)
        context.cancelJobsWithTag(tag)

    timer, kept = threading.Timer(seconds, stop), df.persist()
    context.addJobTag(tag)
    timer.start()
    try:
        kept.count()
    except Exception as e:
        kept.unpersist()
        if late:
            raise QueryTimeout(f"not done in {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return kept


class Database:
    """Collections of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.collections = spark, {}

    def collection(self, name: str, df: DataFrame | None = None, id_col: str = "_id") -> Collection:
        if df is not None:
            self.collections[name] = Collection(df, name, id_col)
        return self.collections[name]

    def list_collection_names(self) -> list[str]:
        return sorted(n for n in self.collections if not n.startswith("_"))


def due(version: int, steps: dict) -> list[int]:
    """The versions of steps above `version`, which must be positive, in ascending order."""
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in steps):
        raise FilterError("migration versions must be positive")
    return [v for v in sorted(steps) if v > version]


def migrate(version: int, steps: dict, df: DataFrame) -> tuple[int, DataFrame]:
    """Apply the steps above `version` as one plan."""
    for v in due(version, steps):
        version, df = v, steps[v](df)
    return version, df


def migrate_saved(df: DataFrame, steps: dict, path: str) -> tuple[int, DataFrame]:
    """Apply steps {version: function}; the table after each is saved at path/v<version> before the next begins.

    A run that stopped goes on after the last version that was saved whole, and a step that was done isn't done again.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def mark(v: int):
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}.done")
        return place.getFileSystem(conf), place

    def saved(v: int) -> bool:
        files, place = mark(v)
        return files.exists(place)

    version = max((v for v in due(0, steps) if saved(v)), default=0)
    if version:
        df = spark.read.parquet(f"{path}/v{version}")
    for v in due(version, steps):
        steps[v](df).write.mode("overwrite").parquet(f"{path}/v{v}")
        files, place = mark(v)
        files.create(place).close()
        version, df = v, spark.read.parquet(f"{path}/v{v}")
    return version, df
