"""Documents whose fields merge one by one: each has a clock (time, node), kept in _clocks: map<string, struct<t, n>>."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLOCKS, CLOCK = "_clocks", "struct<t:bigint,n:string>"
#: Changes in one import, at most.
MOST = 10_000


def named(df: DataFrame, id_col: str) -> list[str]:
    """Fields that have clocks: not the id, none of the engine's own."""
    return [c for c in df.columns if not c.startswith("_") and c != id_col]


def _clock(ts: Column, node: str) -> Column:
    return F.struct(ts.cast("long").alias("t"), F.lit(node).alias("n"))


def _map(entries: list[Column]) -> Column:
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else F.create_map().cast(f"map<string,{CLOCK}>")


def stamped(df: DataFrame, node: str, ts: Column, id_col: str = "_id") -> DataFrame:
    """Rows for an insert: every field that is there gets the clock (ts, node), the row `_changed_at`."""
    entries = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("key"), _clock(ts, node).alias("value"))) for c in named(df, id_col)]
    return df.drop(CLOCKS, "_changed_at").withColumn(CLOCKS, _map(entries)).withColumn("_changed_at", ts.cast("long"))


def updated(df: DataFrame, where: Column, changes: dict[str, Column], node: str, ts: Column) -> DataFrame:
    """Rows that match take the new values and clocks of these fields; _changed_at is their latest clock. Fields of the engine stay."""
    own = {f: v for f, v in changes.items() if not f.startswith("_")}
    if not own:
        return df
    fresh = F.create_map(*[x for f in own for x in (F.lit(f), _clock(ts, node))])
    hit = F.coalesce(where, F.lit(False))
    out = df.withColumn("_hit", hit)
    for f, v in own.items():
        out = out.withColumn(f, F.when(F.col("_hit"), v).otherwise(F.col(f"`{f}`") if f in df.columns else F.lit(None)))
    old = F.map_filter(F.coalesce(F.col(CLOCKS), F.create_map().cast(f"map<string,{CLOCK}>")), lambda k, _: ~k.isin(*own))
    out = out.withColumn(CLOCKS, F.when(F.col("_hit"), F.map_concat(old, fresh)).otherwise(F.col(CLOCKS)))
    latest = F.array_max(F.transform(F.map_values(CLOCKS), lambda c: c["t"]))
    return out.withColumn("_changed_at", F.when(F.col("_hit"), latest).otherwise(F.col("_changed_at"))).drop("_hit")


def exported(df: DataFrame, dead: DataFrame, collection: str, since: int = 0, id_col: str = "_id") -> DataFrame:
    """(collection, _id, field, value, ts, node): fields with a clock later than `since`, values as JSON; deletions have no field and are later, too."""
    values = F.create_map(*[x for c in named(df, id_col) for x in (F.lit(c), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))))])
    rows = df.select(F.col(id_col).cast("string").alias("_id"), values.alias("values"), F.explode(CLOCKS).alias("field", "clock")).where(F.col("clock.t") > since)
    live = rows.select(F.lit(collection).alias("collection"), "_id", "field", F.element_at("values", F.col("field")).alias("value"), F.col("clock.t").alias("ts"), F.col("clock.n").alias("node"))
    none = F.lit(None).cast("string")
    gone = dead.where((F.col("collection") == collection) & (F.col("deleted_at") > since))
    return live.unionByName(gone.select("collection", F.col("_id").cast("string").alias("_id"), none.alias("field"), none.alias("value"), F.col("deleted_at").cast("long").alias("ts"), F.lit("").alias("node")))


def imported(df: DataFrame, dead: DataFrame, changes: DataFrame, collection: str, g_sets=(), allowed=None, most: int | None = MOST, id_col: str = "_id") -> tuple[DataFrame, DataFrame]:
    """(rows, tombstones) after a merge of changes as exported() gives them.

    A field takes the value of the greater (ts, node); a field without a clock has (0, ""). Fields of `g_sets` take in elements that they
    lack, whatever the clocks. A document goes if its deletion beats (_changed_at, ""); a deleted one comes back only by a field
    newer than its tombstone, which then ends. Changes of collections that `allowed` leaves out are passed over, and so are fields that the
    table has no column for. More than `most` changes are refused. The changes are grouped by document first: one shuffle of these, one join.
    """
    if most is not None and changes.limit(most + 1).count() > most:
        raise ValueError(f"a change-set of more than {most} entries")
    if allowed is not None and collection not in allowed:
        return df, dead
    mine = changes.where(F.col("collection") == collection)
    names = named(df, id_col)
    kinds = {c: df.schema[c].dataType for c in names}
    by = mine.groupBy("_id").agg(
        F.max(F.when(F.col("field").isNull(), F.struct("ts", "node"))).alias("deleted"),
        F.max(F.when(F.col("field").isin(*names), F.col("ts"))).alias("newest"),
        *[F.max(F.when(F.col("field") == c, F.struct("ts", "node", "value"))).alias(f"r_{i}") for i, c in enumerate(names)],
        *[F.flatten(F.collect_list(F.when(F.col("field") == c, F.from_json("value", T.StructType().add("v", kinds[c]))["v"]))).alias(f"g_{i}") for i, c in enumerate(names) if c in g_sets],
    )
    tombs = dead.where(F.col("collection") == collection).groupBy(F.col("_id").cast("string").alias("_id")).agg(F.max("deleted_at").alias("tomb"))
    local = df.select(F.col(id_col).cast("string").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("old"))
    both = local.join(by, "_id", "full_outer").join(tombs, "_id", "left")

    none, empty = F.col("old").isNull(), F.create_map().cast(f"map<string,{CLOCK}>")
    zero = F.struct(F.lit(0).cast("long").alias("t"), F.lit("").alias("n"))
    at = F.coalesce(F.col(f"old._changed_at").cast("long"), F.lit(0).cast("long"))
    beaten = F.col("deleted").isNotNull() & ~none & (F.struct("deleted.ts", "deleted.node") > F.struct(at, F.lit("")))
    # A document that isn't there appears by a field newer than its tombstones, local or just told.
    wall = F.greatest(F.coalesce("tomb", F.lit(-1)), F.coalesce(F.col("deleted.ts"), F.lit(-1)))
    appears = F.col("newest").isNotNull() & (F.col("newest") > F.when(none, wall).when(beaten, F.col("deleted.ts")).otherwise(F.lit(-1)))
    old_clocks = F.coalesce(F.col(f"old.{CLOCKS}"), empty)
    out = both.withColumn("_fresh", none | beaten).withColumn("_c", F.when(none | beaten, empty).otherwise(old_clocks)).withColumn("_takes", appears).withColumn("_gone", beaten)
    clocks, columns, changed = [], [], F.lit(False)
    for i, c in enumerate(names):
        have = F.when(~F.col("_fresh"), F.col(f"old.`{c}`"))
        r, clock = F.col(f"r_{i}"), F.try_element_at("_c", F.lit(c))
        wins = F.col("_takes") & r.isNotNull() & (F.struct(r["ts"], r["node"]) > F.coalesce(clock, zero))
        value = F.from_json(r["value"], T.StructType().add("v", kinds[c]))["v"]
        if c in g_sets:
            more = F.array_except(F.coalesce(F.col(f"g_{i}"), F.array().cast(kinds[c])), F.coalesce(have, F.array().cast(kinds[c])))
            grows = F.col("_takes") & (F.size(more) > 0)
            columns.append(F.when(grows, F.concat(F.coalesce(have, F.array().cast(kinds[c])), more)).otherwise(have).alias(c))
            changed = changed | F.coalesce(grows, F.lit(False))
        else:
            columns.append(F.when(wins, value).otherwise(have).alias(c))
            changed = changed | F.coalesce(wins, F.lit(False))
        kept = F.when(F.coalesce(wins, F.lit(False)), F.struct(r["ts"].alias("t"), r["node"].alias("n"))).otherwise(clock)
        clocks.append(F.when(kept.isNotNull(), F.struct(F.lit(c).alias("key"), kept.alias("value"))))
    merged = out.withColumn("_changed", changed).withColumn("_new", _map(clocks)).where(F.col("_changed") | ~F.col("_fresh"))
    latest = F.array_max(F.transform(F.map_values("_new"), lambda c: c["t"]))
    extra = {CLOCKS: F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(f"old.{CLOCKS}")), "_changed_at": F.when(F.col("_changed"), latest).otherwise(F.col("old._changed_at")), id_col: F.col("_id").cast(df.schema[id_col].dataType)}
    fields = {c: x for c, x in zip(names, columns)} | extra
    rows = merged.select(*[fields.get(c, F.col(f"old.`{c}`")).alias(c) for c in df.columns])
    told = mine.where("field is null").groupBy("collection", "_id").agg(F.max("ts").alias("deleted_at"))
    tombstones = dead.select("collection", F.col("_id").cast("string").alias("_id"), F.col("deleted_at").cast("long").alias("deleted_at")).unionByName(told).groupBy("collection", "_id").agg(F.max("deleted_at").alias("deleted_at"))
    back = out.where(F.col("_takes") & (F.col("tomb").isNotNull() | F.col("deleted").isNotNull())).select(F.lit(collection).alias("collection"), "_id")
    return rows, tombstones.join(back, ["collection", "_id"], "left_anti")
