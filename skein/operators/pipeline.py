"""Aggregation pipelines, folded into one DataFrame plan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.filters import FilterError, compile_filter, floating, resolve


def sort_columns(spec: dict, df: DataFrame, id_col: str = "_id") -> list[Column]:
    """Missing first ascending, last descending; ties by id, ascending always."""
    keys = []
    for path, way in spec.items():
        if way not in (1, -1):
            raise FilterError(f"$sort: {path}: {way!r}")
        column, _ = resolve(df.schema, path)
        if column is not None:
            keys.append(column.asc_nulls_first() if way == 1 else column.desc_nulls_last())
    return keys + ([F.col(id_col).asc()] if id_col in df.columns and id_col not in spec else [])


def reversed_key(column: Column, kind) -> list[Column]:
    """Columns that, ascending, order rows as `column` does descending, missing values last."""
    missing = column.isNull()
    if isinstance(kind, T.IntegralType):
        return [missing, F.bitwise_not(column)]  # unlike -x, never too large
    if floating(kind):
        return [missing, ~F.isnan(column), -column]
    if isinstance(kind, T.DecimalType):
        return [missing, -column]
    if isinstance(kind, T.BooleanType):
        return [missing, ~column]
    if isinstance(kind, T.TimestampType):
        return [missing, -F.unix_micros(column)]
    if isinstance(kind, T.TimestampNTZType):
        return [missing, -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)]
    if isinstance(kind, T.DateType):
        return [missing, -F.unix_date(column)]
    if isinstance(kind, T.StringType | T.BinaryType):  # each byte's complement; the end of a text comes after any byte
        return [missing, F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    raise FilterError(f"an ordered accumulator can't follow a descending $sort on {kind.simpleString()}")


def _order(df: DataFrame, sort: dict | None, id_col: str) -> Column:
    """One value for each row that orders rows as the preceding $sort does, for accumulators that ask for an order."""
    parts = []
    for path, way in (sort or {}).items():
        column, kind = resolve(df.schema, path)
        if column is not None:
            parts += [column] if way == 1 else reversed_key(column, kind)
    if id_col in df.columns:
        parts.append(F.col(id_col))
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]) if parts else F.lit(0)


def total(column: Column, kind) -> Column:
    """The sum of numbers, 0 of none. Sums of 64-bit integers are exact, as decimals of 38 digits; no sum of such numbers overflows these."""
    if isinstance(kind, T.LongType):
        return F.coalesce(F.sum(column.cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    if isinstance(kind, T.DecimalType):
        wide = T.DecimalType(38, kind.scale)  # Spark adds ten digits before the point
        return F.coalesce(F.sum(column).cast(wide), F.lit(0).cast(wide))
    return F.coalesce(F.sum(column), F.lit(0.0) if floating(kind) else F.lit(0).cast("long"))


def accumulator(df: DataFrame, spec: dict, sort: dict | None, id_col: str) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise FilterError(f"an accumulator has one operator: {spec!r}")
    ((op, arg),) = spec.items()
    if op == "$count" and arg == {} or op == "$sum" and arg == 1 and not isinstance(arg, bool):
        return F.count(F.lit(1))
    if not isinstance(arg, str) or not arg.startswith("$"):
        raise FilterError(f"{op} needs a field: {arg!r}")
    column, kind = resolve(df.schema, arg[1:])
    if column is None:
        column, kind = F.lit(None), T.NullType()
    number = isinstance(kind, T.NumericType)
    if op == "$sum":
        if not number:
            return F.lit(0).cast("long") + F.count(F.when(F.lit(False), 1))
        return total(column, kind)
    if op == "$avg":
        return F.avg(column.cast("double")) if number else F.max(F.lit(None).cast("double"))
    if op == "$min":
        return F.min(column)
    if op == "$max":
        return F.max(column)
    order = _order(df, sort, id_col)
    if op == "$push":
        pairs = F.collect_list(F.when(column.isNotNull(), F.struct(order.alias("o"), column.alias("v"))))
        return F.transform(F.sort_array(pairs), lambda p: p["v"])
    if op == "$addToSet":
        return F.sort_array(F.collect_set(column))
    if op == "$first":
        return F.min_by(column, F.when(column.isNotNull(), order))
    if op == "$last":
        return F.max_by(column, order)
    raise FilterError(f"unknown accumulator {op}")


def grouped(df: DataFrame, spec: dict, sort: dict | None, id_col: str) -> DataFrame:
    """Partial sums before the shuffle; the missing key is a group; no rows make no group."""
    if "_id" not in spec:
        raise FilterError("$group needs _id")
    key = spec["_id"]
    if key is not None and not isinstance(key, str):
        raise FilterError("$group: _id must be a field or null")
    column = None if key is None else resolve(df.schema, key.removeprefix("$"))[0]
    column = F.lit(None).cast("string") if column is None else column
    made = [accumulator(df, a, sort, id_col).alias(name) for name, a in spec.items() if name != "_id"]
    by = df.withColumn("_key", column).groupBy("_key")
    out = by.agg(*made) if made else by.agg(F.count("*").alias("_n")).drop("_n")
    return out.withColumnRenamed("_key", "_id")


def projected(df: DataFrame, spec: dict) -> DataFrame:
    if not isinstance(spec, dict) or not spec:
        raise FilterError("$project needs fields")
    if any("." in f for f in spec):
        raise FilterError("$project takes top-level fields")
    wanted = {f: bool(v) for f, v in spec.items() if f != "_id"}
    if len(set(wanted.values())) > 1:
        raise FilterError("$project can't include and exclude")
    keep_id = bool(spec.get("_id", True))
    if wanted and all(wanted.values()) or not wanted and keep_id:
        names = [c for c in df.columns if c in wanted or c == "_id" and keep_id]
    else:
        names = [c for c in df.columns if c not in wanted and (c != "_id" or keep_id)]
    return df.select([F.col(f"`{c}`") for c in names])


def in_id_order(df: DataFrame, id_col: str) -> DataFrame:
    """What a page counts along where nothing is sorted: the id, for groups its text. With a limit, a top-k."""
    column, kind = resolve(df.schema, id_col)
    return df if column is None else df.orderBy(column if isinstance(kind, T.NumericType) else column.cast("string"))


def aggregate(df: DataFrame, stages: list[dict], id_col: str = "_id") -> DataFrame:
    """Each stage's plan on the one before. A $sort is planned where rows are cut or returned; a $group takes only its order along."""
    sort, planned = None, False  # the order that rows are in, and whether the plan sorts by it

    def sorted_(df):
        return df.orderBy(*sort_columns(sort, df, id_col)) if sort is not None and not planned else df

    for stage in stages:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise FilterError(f"a stage has one operator: {stage!r}")
        ((op, arg),) = stage.items()
        if op == "$match":
            df = df.where(compile_filter(arg, df.schema))
        elif op == "$group":
            df, sort, planned = grouped(df, arg, sort, id_col), None, False
        elif op == "$sort":
            sort_columns(arg, df, id_col)  # tells errors at once
            sort, planned = arg, False
        elif op in ("$skip", "$limit"):
            if not isinstance(arg, int) or isinstance(arg, bool) or arg < 0:
                raise FilterError(f"{op} needs a count")
            df = in_id_order(df, id_col) if sort is None and not planned else sorted_(df)
            df, planned = df.offset(arg) if op == "$skip" else df.limit(arg), True
        elif op == "$project":
            df, planned = projected(sorted_(df), arg), planned or sort is not None
        else:
            raise FilterError(f"unknown stage {op}")
    return sorted_(df)
