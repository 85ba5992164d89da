"""Schemas of collections: rows are checked as they are written, stamped with a version, and upgraded as they are read."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.changes import TYPES

#: Fields that replication adds; a schema doesn't see them.
REPLICA_FIELDS = ("_replica_scope", "_remote_rev")


class SchemaError(ValueError):
    """A schema that can't be applied."""


class Schema:
    """required: fields that must be there; types: field -> kind, as in changes.TYPES; checks: name -> a condition over columns.

    version above 0: rows written without _v get it, and rows read below it go through `migrate` (rows, their version) -> columns.
    """

    def __init__(self, required=(), types: dict | None = None, checks: dict[str, Column] | None = None, version: int = 0, migrate: Callable | None = None):
        if migrate and version < 1:
            raise SchemaError("a migration needs a version to lead to")
        if unknown := [k for k in (types or {}).values() if k != "any" and k not in TYPES]:
            raise SchemaError(f"unknown type {unknown[0]}")
        self.required, self.types, self.checks, self.version, self.migrate = tuple(required), dict(types or {}), dict(checks or {}), version, migrate

    def fault(self, df: DataFrame) -> Column:
        """What the first fault of a row is, or NULL."""
        faults = [F.when(F.col(f"`{f}`").isNull() if f in df.columns else F.lit(True), F.lit(f"{f}: required")) for f in self.required]
        for f, kind in self.types.items():
            if kind != "any" and f in df.columns and not isinstance(df.schema[f].dataType, TYPES[kind] | T.NullType):
                faults.append(F.when(F.col(f"`{f}`").isNotNull(), F.lit(f"{f}: not {kind}")))
        faults += [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in self.checks.items()]
        return F.coalesce(*faults) if faults else F.lit(None).cast("string")

    def stamped(self, df: DataFrame) -> DataFrame:
        if not self.version:
            return df
        have = F.col("_v") if "_v" in df.columns else F.lit(None).cast("int")
        return df.withColumn("_v", F.coalesce(have, F.lit(self.version)))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that may be written, stamped; the others, with their `reason`)."""
        seen = df.drop(*REPLICA_FIELDS)
        told = df.withColumn("reason", self.fault(seen))
        return self.stamped(told.where("reason is null").drop("reason")), told.where("reason is not null")

    def written(self, df: DataFrame, label: str = "insert") -> DataFrame:
        """df stamped; a job that meets a row with a fault fails, and so writes nothing."""
        bad = self.fault(df.drop(*REPLICA_FIELDS))
        names = df.columns
        checked = df.withColumn("_fault", bad).where(F.when(F.col("_fault").isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"{label}: "), F.col("_fault"))).cast("boolean")))
        return self.stamped(checked.select(*[F.col(f"`{c}`") for c in names]))

    def read(self, df: DataFrame) -> DataFrame:
        """df with rows of an earlier version upgraded: `migrate` gives columns for these, others keep theirs."""
        if not self.migrate:
            return df
        version = F.coalesce(F.col("_v") if "_v" in df.columns else F.lit(None).cast("int"), F.lit(0))
        old = version < self.version
        out = df
        for name, column in self.migrate(df, version).items():
            have = df[f"`{name}`"] if name in df.columns else F.lit(None)
            out = out.withColumn(name, F.when(old, column).otherwise(have))
        return out.withColumn("_v", F.when(old, self.version).otherwise(version))

    def upgraded(self, df: DataFrame) -> DataFrame:
        """Only the rows that read() changes, as it returns them: what to write back."""
        version = F.coalesce(F.col("_v") if "_v" in df.columns else F.lit(None).cast("int"), F.lit(0))
        return self.read(df.where(version < self.version)) if self.migrate else df.where("false")
