"""Change-sets: export, last-write-wins and per-field merges, structural validation, coverage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exported(df: DataFrame, dead: DataFrame, collection: str, since: int = 0, id_col: str = "_id") -> DataFrame:
    """(collection, _id, op, changed_at, doc): own rows changed after `since` (all if 0), and later deletions. Replicas' rows stay out."""
    rows = df.where(F.coalesce(F.col("_changed_at"), F.lit(0)) > since) if since else df
    if "_remote" in df.columns:
        rows = rows.where("_remote is null or not _remote")
    body = F.to_json(F.struct(*[c for c in df.columns if c != id_col]))
    live = rows.select(F.lit(collection).alias("collection"), F.col(id_col).cast("string").alias("_id"), F.lit("upsert").alias("op"), F.coalesce("_changed_at", F.lit(0)).cast("long").alias("changed_at"), body.alias("doc"))
    gone = dead.where(F.col("collection") == collection).where(F.col("deleted_at") > since)
    return live.unionByName(gone.select("collection", F.col("_id").cast("string").alias("_id"), F.lit("delete").alias("op"), F.col("deleted_at").cast("long").alias("changed_at"), F.lit(None).cast("string").alias("doc")))


def merged(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Of changes (collection, _id, op, changed_at, doc), the winner of each document.

    The latest wins; a deletion beats an upsert of its time; of upserts of one time the greater document wins. A maximum, so it
    is combined before the shuffle, and the order and number of merges make no difference.
    """
    rank = F.struct("changed_at", (F.col("op") == "delete").alias("d"), F.coalesce("doc", F.lit("")).alias("t"))
    won = local.unionByName(remote).groupBy("collection", "_id").agg(F.max_by(F.struct("op", "changed_at", "doc"), rank).alias("w"))
    return won.select("collection", "_id", "w.op", "w.changed_at", "w.doc")


def newest_cohort(changes: DataFrame, key: list[str], at: str = "changed_at") -> DataFrame:
    """All distinct changes of the latest time of each key."""
    last = changes.groupBy(*key).agg(F.max(at).alias(at))
    return changes.join(last, [*key, at], "left_semi").distinct()


TYPES = {"bool": T.BooleanType, "int": T.IntegralType, "float": T.FractionalType, "str": T.StringType, "bytes": T.BinaryType, "array": T.ArrayType, "object": T.StructType}


def validated(df: DataFrame, version: int, required=(), types: dict | None = None, defaults: dict | None = None, renames: dict | None = None) -> DataFrame:
    """df with `decision` (accept, coerce or quarantine) and `reason`.

    Rows of a later version pass as they are. Earlier ones get renames, then defaults, then _v, and count as coerced. Then required fields
    must be there and typed fields be of their type; a null passes the type check.
    """
    out = df if "_v" in df.columns else df.withColumn("_v", F.lit(0))
    v = F.coalesce("_v", F.lit(0))
    later, earlier = v > version, v < version
    out = out.withColumn("_later", later).withColumn("_earlier", earlier)
    for old, new in (renames or {}).items():
        if old in out.columns:
            have = F.col(new) if new in out.columns else F.lit(None)
            out = out.withColumn(new, F.when(F.col("_earlier"), F.coalesce(F.col(old), have)).otherwise(have)).withColumn(old, F.when(~F.col("_earlier"), F.col(old)))
    for field, value in (defaults or {}).items():
        have = F.col(field) if field in out.columns else F.lit(None)
        out = out.withColumn(field, F.when(F.col("_earlier"), F.coalesce(have, F.lit(value))).otherwise(have))
    out = out.withColumn("_v", F.when(F.col("_earlier"), F.lit(version)).otherwise(F.col("_v")))
    reason = F.lit(None).cast("string")
    for field, kind in reversed((types or {}).items()):
        if kind != "any" and field in out.columns and not isinstance(out.schema[field].dataType, TYPES[kind] | T.NullType):
            reason = F.when(F.col(field).isNotNull(), F.lit(f"{field}: not {kind}")).otherwise(reason)
    for field in reversed(required):
        reason = F.when(F.col(field).isNull() if field in out.columns else F.lit(True), F.lit(f"{field}: required")).otherwise(reason)
    reason = F.when(~F.col("_later"), reason)
    out = out.withColumn("reason", reason)
    decision = F.when(F.col("reason").isNotNull(), "quarantine").when(F.col("_earlier"), "coerce").otherwise("accept")
    return out.withColumn("decision", decision).drop("_later", "_earlier")


def field_changes(df: DataFrame, collection: str, since: int = 0, id_col: str = "_id") -> DataFrame:
    """(collection, _id, field, value, ts, node): fields whose clock is later than `since`, from _clocks: map<string, struct<t, n>>."""
    names = [c for c in df.columns if not c.startswith("_") and c != id_col]
    values = F.create_map(*[x for c in names for x in (F.lit(c), F.to_json(F.struct(F.col(c).alias("v"))))])
    rows = df.select(F.col(id_col).cast("string").alias("_id"), values.alias("values"), F.explode("_clocks").alias("field", "clock"))
    return rows.where(F.col("clock.t") > since).select(F.lit(collection).alias("collection"), "_id", "field", F.element_at("values", F.col("field")).alias("value"), F.col("clock.t").alias("ts"), F.col("clock.n").alias("node"))


def merged_fields(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Of field changes, the value of the greatest (ts, node) for each field of each document."""
    both = local.unionByName(remote)
    won = both.groupBy("collection", "_id", "field").agg(F.max_by(F.struct("value", "ts", "node"), F.struct(F.coalesce("ts", F.lit(0)), F.coalesce("node", F.lit("")), "value")).alias("w"))
    return won.select("collection", "_id", "field", "w.*")


def grown(local: Column, remote: Column) -> Column:
    """A grow-only set: elements of the other side that are not there yet are appended."""
    return F.concat(local, F.array_except(remote, local))


def surviving(fields: DataFrame, dead: DataFrame) -> DataFrame:
    """Fields of documents whose newest change is later than their deletion."""
    last = fields.groupBy("collection", "_id").agg(F.max("ts").alias("last"))
    kept = last.join(dead, ["collection", "_id"], "left").where("deleted_at is null or last > deleted_at").select("collection", "_id")
    return fields.join(kept, ["collection", "_id"], "left_semi")


#: Replication states, and those that each may turn into. Only a complete one answers for what is not there.
COVERAGE = {"empty": {"hydrating"}, "hydrating": {"complete", "best-effort", "error"}, "complete": {"stale", "error", "hydrating"}, "best-effort": {"hydrating", "error"}, "stale": {"hydrating", "complete", "error"}, "error": {"hydrating"}}


def advance(state: str, to: str) -> str:
    if to not in COVERAGE.get(state, ()):
        raise ValueError(f"coverage can't turn from {state} to {to}")
    return to


def selected(names: list[str], include=None, exclude=()) -> list[str]:
    return sorted(n for n in (include or names) if n not in exclude and not n.startswith("_"))
