"""JSON filters compiled to columns with two-valued logic.

Negation is pushed to the leaves, where a missing (NULL) value makes the negative form true; so every leaf stays a bare
comparison that Parquet scans can use.
"""

import math
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import contains_all, tokenize

COMPARISONS = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
OPPOSITE = {"$gt": "$lte", "$gte": "$lt", "$lt": "$gte", "$lte": "$gt"}
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: Names are looked up in structs down to this depth.
DEPTH = 64


class FilterError(ValueError):
    """A filter, update or pipeline that isn't understood."""


def resolve(schema: T.StructType, path: str) -> tuple[Column | None, T.DataType | None]:
    """The column at a dotted path and its type; (None, None) where the schema has no such field."""
    parts = path.split(".")
    if len(parts) > DEPTH:
        return None, None
    kind, column = schema, None
    for part in parts:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None, None
        column = F.col(f"`{part}`") if column is None else column.getField(part)
        kind = kind[part].dataType
    return column, kind


def family(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float | Decimal):
        return "number"
    if isinstance(value, date):
        return "time"
    return "string" if isinstance(value, str) else "bytes" if isinstance(value, bytes | bytearray) else "other"


def column_family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, TIMES):
        return "time"
    if isinstance(kind, T.StringType):
        return "string"
    return "bytes" if isinstance(kind, T.BinaryType) else "other"


def floating(kind) -> bool:
    return isinstance(kind, T.DoubleType | T.FloatType)


def nan(value) -> bool:
    return isinstance(value, float | Decimal) and math.isnan(value)


def equatable(value, kind: T.DataType) -> bool:
    """Whether a value can equal something in a column of this type: equality doesn't convert, but an integer may name a float or a decimal."""
    if not comparable(value, kind):
        return False
    return not (isinstance(value, float | Decimal) and isinstance(kind, T.IntegralType))


def comparable(value, kind: T.DataType) -> bool:
    """Whether a value has a place in the order of a column of this type. Times may be given as text in ISO form."""
    if isinstance(kind, TIMES):
        return moment(value) is not None
    return family(value) == column_family(kind) != "other" and not nan(value)


def moment(value) -> datetime | None:
    """A date, a time or text in ISO form as a time; None if it is none."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            return None
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day) if isinstance(value, date) else None


def literal(value, kind: T.DataType) -> Column:
    """A constant that the scan can be asked for. A time with a zone is told to a column without one in UTC; one without a zone is the session's."""
    if not isinstance(kind, TIMES):
        return F.lit(value)
    t = moment(value)
    if t.tzinfo and not isinstance(kind, T.TimestampType):
        t = t.astimezone(UTC).replace(tzinfo=None)
    if isinstance(kind, T.DateType):  # a time within a day lies between dates: Spark compares the column as a time
        return F.lit(t.date().isoformat()).cast(kind) if t == datetime(t.year, t.month, t.day) else F.lit(t.isoformat(" ")).cast("timestamp_ntz")
    return F.lit(t.isoformat(" ")).cast(kind)


def checked_pattern(value) -> str:
    """A pattern of the engine that runs it, Java's, with its errors at once. Named groups may be written (?P<name>...)."""
    if not isinstance(value, str):
        raise FilterError(f"$regex needs a text: {value!r}")
    pattern = value.replace("(?P<", "(?<")
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise FilterError(f"$regex: {value!r}: {getattr(e, 'java_exception', e)}") from e
    return pattern


class Compiler:
    def __init__(self, schema: T.StructType):
        self.schema = schema

    def compile(self, spec, positive: bool = True) -> Column:
        if spec is None or spec == {}:
            return F.lit(positive)
        if not isinstance(spec, dict):
            raise FilterError(f"a filter must be an object: {spec!r}")
        return self.joined([self.member(k, v, positive) for k, v in spec.items()], "$and", positive)

    def joined(self, parts: list[Column], how: str, positive: bool) -> Column:
        every = (how == "$and") == positive  # De Morgan
        if not parts:
            return F.lit(every)
        return reduce(lambda a, b: a & b if every else a | b, parts)

    def member(self, key: str, value, positive: bool) -> Column:
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise FilterError(f"{key} needs a list")
            return self.joined([self.compile(x, positive) for x in value], key, positive)
        if key == "$not":
            return self.compile(value, not positive)
        if key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        if not isinstance(value, dict):
            return self.leaf(key, "$eq", value, positive)
        if not value:
            raise FilterError(f"{key}: no operator given")
        return self.joined([self.leaf(key, op, v, positive) for op, v in value.items()], "$and", positive)

    def leaf(self, path: str, op: str, value, positive: bool) -> Column:
        if op in ("$ne", "$nin"):
            return self.leaf(path, "$eq" if op == "$ne" else "$in", value, not positive)
        column, kind = resolve(self.schema, path)
        if op == "$exists":
            return F.lit(bool(value) != positive) if column is None else column.isNotNull() if bool(value) == positive else column.isNull()
        if op == "$eq":
            return self.among(column, kind, [value], positive)
        if op == "$in":
            if not isinstance(value, list):
                raise FilterError("$in and $nin need a list")
            return self.among(column, kind, value, positive)
        if op in COMPARISONS:
            return self.ranged(column, kind, op, value, positive)
        if op == "$contains":
            tokens = tokenize(value)
            if not tokens:
                return F.lit(positive)
            found = contains_all(column, tokens) if column is not None and isinstance(kind, T.StringType) else None
            return self.either(column, found, positive)
        if op == "$regex":
            pattern = checked_pattern(value)
            found = column.rlike(pattern) if column is not None and isinstance(kind, T.StringType) else None
            return self.either(column, found, positive)
        raise FilterError(f"unknown operator {op}")

    def either(self, column, found, positive: bool) -> Column:
        if found is None:
            return F.lit(not positive)
        return found if positive else column.isNull() | ~found

    def among(self, column, kind, values: list, positive: bool) -> Column:
        null = any(v is None for v in values)
        if column is None:
            return F.lit(null == positive)
        if isinstance(kind, T.ArrayType):
            same = [F.array(*[F.lit(x) for x in v]).cast(kind) for v in values if isinstance(v, list)]
            found = reduce(lambda a, b: a | b, [column == v for v in same]) if same else None
        else:
            good = [literal(v, kind) for v in values if v is not None and equatable(v, kind)]
            found = (column == good[0] if len(good) == 1 else column.isin(*good)) if good else None
        if positive:
            parts = ([found] if found is not None else []) + ([column.isNull()] if null else [])
            return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
        if found is None:
            return column.isNotNull() if null else F.lit(True)
        return column.isNotNull() & ~found if null else column.isNull() | ~found

    def ranged(self, column, kind, op: str, value, positive: bool) -> Column:
        if column is None or not comparable(value, kind):
            return F.lit(not positive)
        compare = lambda name: getattr(column, COMPARISONS[name])(literal(value, kind))
        if positive:
            return compare(op) & ~F.isnan(column) if floating(kind) else compare(op)
        missing = column.isNull() | F.isnan(column) if floating(kind) else column.isNull()
        return missing | compare(OPPOSITE[op])


def compile_filter(spec, schema: T.StructType) -> Column:
    """A column that is true for the rows that the filter matches, and false or NULL for others."""
    return Compiler(schema).compile(spec)
