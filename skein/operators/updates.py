"""Updates, upserts and deletes as plans from the rows before to the rows after."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import ids
from skein.functions.filters import FilterError, compile_filter, equatable, floating, literal

#: The order in which operators apply.
OPERATORS = ("$set", "$unset", "$inc", "$push", "$pull")


#: Bytes of the integer types.
WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
#: Element types of lists that $push begins.
NEW_LISTS = {int: "bigint", float: "double", bool: "boolean"}


def constant(value, kind: T.DataType | None, what: str) -> Column:
    """A value as a column of the type that a field has; told at once if it isn't of that type. An object becomes a struct, a list an array."""
    if value is None:
        return F.lit(None) if kind is None else F.lit(None).cast(kind)
    if isinstance(value, dict):
        if kind is not None and not isinstance(kind, T.StructType) or kind is not None and set(value) - set(kind.names):
            raise FilterError(f"{what}: {value!r} is not of type {kind.simpleString()}")
        names = list(value) if kind is None else kind.names
        fields = [constant(value.get(n), None if kind is None else kind[n].dataType, f"{what}.{n}").alias(n) for n in names]
        return F.struct(*fields) if fields else F.lit(None)
    if isinstance(value, list):
        if kind is not None and not isinstance(kind, T.ArrayType):
            raise FilterError(f"{what}: a list is not of type {kind.simpleString()}")
        items = F.array(*[constant(x, None if kind is None else kind.elementType, what) for x in value])
        return items if kind is None else items.cast(kind)
    if kind is None:
        return F.lit(value)
    exact = equatable(value, kind) or isinstance(value, float) and floating(kind)
    if not exact or isinstance(kind, T.IntegralType) and not -(1 << 8 * WIDTH[type(kind)] - 1) <= value < 1 << 8 * WIDTH[type(kind)] - 1:
        raise FilterError(f"{what}: {value!r} is not of type {kind.simpleString()}")
    return literal(value, kind).cast(kind)


def without(items: Column, item: Column) -> Column:
    return F.filter(items, lambda x: ~x.eqNullSafe(item))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def updated(df: DataFrame, where, update: dict, stamp: Column | None = None) -> DataFrame:
    """Rows that match get the update; others stay. A stamp goes to _changed_at of changed rows."""
    if unknown := [op for op in update if op not in OPERATORS]:
        raise FilterError(f"unknown update operator {unknown[0]}")
    hit = F.coalesce(compile_filter(where, df.schema), F.lit(False))
    out = df.withColumn("_hit", hit)
    for op in OPERATORS:
        for field, value in update.get(op, {}).items():
            kind = out.schema[field].dataType if field in out.columns else None
            old = F.col(f"`{field}`") if kind is not None else F.lit(None)
            if op == "$set":
                new = constant(value, kind, f"$set: {field}")
            elif op == "$unset":
                new = F.lit(None)
            elif op == "$inc":
                if kind is not None and not isinstance(kind, T.NumericType):
                    raise TypeError(f"$inc: {field} is not a number")
                new = F.coalesce(old, F.lit(0)) + F.lit(value)
            else:
                if kind is not None and not isinstance(kind, T.ArrayType):
                    if op == "$pull":
                        continue
                    raise TypeError(f"$push: {field} is not a list")
                if op == "$pull" and kind is None:
                    continue
                if op == "$pull" and value is not None and not equatable(value, kind.elementType):
                    continue  # nothing there can equal it
                item = constant(value, kind.elementType if kind is not None else None, f"{op}: {field}")
                if op == "$push":
                    empty = F.array().cast(kind if kind is not None else f"array<{NEW_LISTS.get(type(value), 'string')}>")
                    new = F.array_append(F.coalesce(old, empty), item)
                else:
                    new = without(old, item)
            out = out.withColumn(field, F.when(F.col("_hit"), new).otherwise(old))
    if stamp is not None:
        old = F.col("_changed_at") if "_changed_at" in out.columns else F.lit(None).cast("long")
        out = out.withColumn("_changed_at", F.when(F.col("_hit"), stamp).otherwise(old))
    return out.drop("_hit")


def deleted(df: DataFrame, where) -> DataFrame:
    """The rows that don't match. The filter is negated at its leaves, so rows with missing values stay."""
    return df.where(compile_filter({"$not": where or {}}, df.schema))


def tombstones(df: DataFrame, where, collection: str, at: Column, id_col: str = "_id") -> DataFrame:
    return df.where(compile_filter(where, df.schema)).select(F.lit(collection).alias("collection"), F.col(id_col).alias("_id"), at.alias("deleted_at"))


def compacted(dead: DataFrame, before: int) -> DataFrame:
    return dead.where(F.col("deleted_at") >= before)


def upserted(df: DataFrame, new: DataFrame, id_col: str = "_id", revision: str | None = None) -> DataFrame:
    """Rows of `new`, one for an id, replace those of the same id. With a revision column, only if theirs is greater, or the stored one has none.

    Two joins by id and no grouping: Spark broadcasts ids of a small batch by its own size check and merges sorted sides beyond it, so the
    stored table isn't shuffled for a small batch, and its rows never travel inside structs.
    """
    names = df.columns
    if not revision:
        return removed(df, new, id_col).unionByName(new.select(*names))
    mine, theirs = df.select(F.col(id_col).alias("_k"), F.col(revision).alias("_mine")), new.select(F.col(id_col).alias("_k"), F.col(revision).alias("_theirs"))
    wins = F.col("_mine").isNull() | (F.coalesce("_theirs", F.lit(-1)) > F.col("_mine"))  # no stored row has no revision either
    taken = theirs.join(mine, "_k", "left").where(wins).select(F.col("_k").alias(id_col))
    return removed(df, taken, id_col).unionByName(new.join(taken, id_col, "left_semi").select(*names))


ENGINE_FIELDS = ("_changed_at", "_remote", "_remote_rev")


def fresh(new: DataFrame, id_col: str = "_id", stamp: Column | None = None, made_id: Column | None = None) -> DataFrame:
    """Rows to insert: they lose fields that are the engine's own, are stamped, and get new ids (or `made_id`)."""
    id_ = made_id if made_id is not None else ids.new_ids()
    return new.drop(id_col, *ENGINE_FIELDS).select(id_.alias(id_col), "*").withColumn("_changed_at", stamp if stamp is not None else now_ms())


def replaced(df: DataFrame, dead: DataFrame, new: DataFrame, collection: str, id_col: str = "_id", revision: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, tombstones) after an upsert, which ends the tombstones of its ids."""
    gone = dead.join(new.select(F.col(id_col).alias("_id"), F.lit(collection).alias("collection")).distinct(), ["collection", "_id"], "left_anti")
    return upserted(df, new, id_col, revision), gone


def looked_up(df: DataFrame, keys: DataFrame, id_col: str = "_id") -> DataFrame:
    """The documents of a set of ids, each once; ids without a document give nothing."""
    return df.join(keys.select(F.col(id_col)).distinct(), id_col, "left_semi")


def removed(df: DataFrame, gone: DataFrame, id_col: str = "_id") -> DataFrame:
    return df.join(gone.select(F.col(id_col)), id_col, "left_anti")


def changes_between(before: DataFrame, after: DataFrame, id_col: str = "_id") -> DataFrame:
    """(_id, op, changed): insert, update with the fields that differ, or delete. A column that one side lacks is missing there."""
    names = [c for c in dict.fromkeys([*after.columns, *before.columns]) if c != id_col]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(id_col).alias("k"), F.struct(F.lit(1).alias("_there"), *[F.col(f"`{c}`") for c in names if c in df.columns]).alias(name))

    both = side(before, "old").join(side(after, "new"), "k", "full_outer")
    value = lambda df, name, c: F.col(f"{name}.`{c}`") if c in df.columns else F.lit(None)
    changed = F.filter(F.array(*[F.when(~value(before, "old", c).eqNullSafe(value(after, "new", c)), F.lit(c)) for c in names]).cast("array<string>"), lambda x: x.isNotNull())
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.size(changed) > 0, "update")
    return both.select(F.col("k").alias(id_col), op.alias("op"), F.when(op == "update", changed).alias("changed")).where("op is not null")
