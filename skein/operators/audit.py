"""The audit log: who changed which document when, written with the change and read by collection, operation and place."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import ids

OPERATIONS = ("insert", "update", "delete")


def entries(changes: DataFrame, collection: str, caller: str, ts: Column, made_id: Column | None = None, id_col: str = "_id") -> DataFrame:
    """(_id, collection, op, doc_id, ts, caller) for each change (id, op) of updates.changes_between()."""
    id_ = made_id if made_id is not None else ids.new_ids()
    return changes.select(id_.alias("_id"), F.lit(collection).alias("collection"), "op", F.col(id_col).cast("string").alias("doc_id"), ts.cast("long").alias("ts"), F.lit(caller).alias("caller"))


def read(log: DataFrame, collection: str | None = None, op: str | None = None, since: str | None = None) -> DataFrame:
    """Entries in the order of their ids, which is that of their times; `since` is the last id seen. All three reach the scan."""
    if op is not None and op not in OPERATIONS:
        raise ValueError(f"no such operation: {op}")
    out = log.where(F.col("op").isin(*OPERATIONS))
    for name, wanted in (("collection", collection), ("op", op)):
        out = out if wanted is None else out.where(F.col(name) == wanted)
    return (out if since is None else out.where(F.col("_id") > since)).orderBy("_id")
