"""Replication: a walk over an origin's pages that can be resumed, refreshes by deltas, and rounds of pulls and pushes between replicas."""

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import ids
from skein.operators import changes, updates
from skein.sources.rest import MOST_PAGES, OriginError, RestSource

CHANGES = "collection string, _id string, op string, changed_at long, doc string"


class CheckpointFile:
    """Coverage of each replica, in a small JSON file that is replaced as a whole. On a cluster give it a shared path; the driver alone uses it."""

    def __init__(self, path: str):
        self.path = Path(path)

    def read(self, key: str) -> dict:
        return (json.loads(self.path.read_text()) if self.path.exists() else {}).get(key, {"status": "empty"})

    def write(self, key: str, state: dict) -> None:
        every = json.loads(self.path.read_text()) if self.path.exists() else {}
        before = every.get(key, {"status": "empty"})["status"]
        if before != state["status"]:
            changes.advance(before, state["status"])
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(every | {key: state}))
        new.replace(self.path)


class Replica:
    """A collection kept equal to an origin: `apply` takes rows (with _id and _remote_rev) or ids to delete, and commits them."""

    def __init__(self, spark: SparkSession, source: RestSource, schema: str, store: CheckpointFile, apply: Callable[[DataFrame], None], delete: Callable[[DataFrame], None], page_size: int = 500):
        self.spark, self.source, self.schema, self.store, self.apply, self.delete, self.page_size = spark, source, schema, store, apply, delete, page_size
        self.key = f"{source.endpoint}:{source.collection}"

    def ids(self, keys: list[str]) -> DataFrame:
        frame = self.spark.createDataFrame([(k,) for k in keys], "_key string")
        return frame.select(ids.derive(self.key, F.col("_key")).alias("_id"))

    def rows(self, page: list[dict]) -> DataFrame:
        """A page as rows of the schema; repeated keys count once, by their greatest revision."""
        best: dict = {}
        for key, revision, row in map(self.source.keyed, page):
            if key not in best or revision > best[key][0]:
                best[key] = (revision, row)
        made = [(k, r, json.dumps(row)) for k, (r, row) in best.items()]
        frame = self.spark.createDataFrame(made, "_key string, _remote_rev long, doc string")
        return frame.select(ids.derive(self.key, F.col("_key")).alias("_id"), F.from_json("doc", self.schema).alias("d"), "_remote_rev").select("_id", "d.*", "_remote_rev")

    def hydrate(self) -> dict:
        """Walk all pages from where the last walk stopped. Each page is committed before its place is noted; a snapshot token that changes on the way is an error."""
        state = self.store.read(self.key)
        if state["status"] == "complete":
            return state
        page, snapshot, done, cursor = (state.get(k) for k in ("page", "snapshot", "rows", "cursor")) if state["status"] in ("hydrating", "error") else (None, None, 0, None)
        done, pinned, walked = done or 0, True, 0
        self.store.write(self.key, {"status": "hydrating", "page": page, "snapshot": snapshot, "rows": done, "cursor": cursor})
        try:
            while True:
                got = self.source.page(page, snapshot, self.page_size)
                if snapshot is not None and got["snapshot"] not in (None, snapshot):
                    raise OriginError("the origin changed its snapshot during the walk")
                if got["snapshot"] is None and page is None:
                    pinned = False
                snapshot, cursor = snapshot or got["snapshot"], cursor or got["cursor"]
                if got["rows"]:
                    self.apply(self.rows(got["rows"]))
                done, page, walked = done + len(got["rows"]), got["next"], walked + 1
                if page is None:
                    break
                if walked >= MOST_PAGES:
                    raise OriginError(f"more than {MOST_PAGES} pages: the origin doesn't move on")
                self.store.write(self.key, {"status": "hydrating", "page": page, "snapshot": snapshot, "rows": done, "cursor": cursor})
            if pinned and self.source.has_delta and cursor is None:
                raise OriginError("the origin has deltas but gave no cursor for them")
        except Exception as e:
            self.store.write(self.key, {"status": "error", "page": page, "snapshot": snapshot, "rows": done, "cursor": cursor, "error": str(e)})
            raise
        state = {"status": "complete" if pinned else "best-effort", "cursor": cursor or "", "rows": done}
        self.store.write(self.key, state)
        return state

    def refresh(self) -> dict:
        """Apply deltas and deletions since the cursor; only a complete replica is refreshed."""
        state = self.store.read(self.key)
        while state["status"] == "complete" and self.source.has_delta:
            got = self.source.delta(state["cursor"])
            if got["rows"]:
                self.apply(self.rows(got["rows"]))
            if got["deleted"]:
                self.delete(self.ids([str(k) for k in got["deleted"]]))
            state = state | {"cursor": got["cursor"], "rows": state["rows"] + len(got["rows"])}
            self.store.write(self.key, state)
            if not got["more"]:
                break
        return state

    def bridge(self, rows: list[dict]) -> DataFrame:
        """Apply rows that a query fetched by itself; coverage doesn't move. Returns their ids."""
        frame = self.rows(rows)
        self.apply(frame)
        return frame.select("_id")


def batches(rows: DataFrame, most: int = 1000):
    """Rows as dicts, `most` at a time; the driver holds one of Spark's partitions."""
    batch: list = []
    for r in rows.toLocalIterator():
        batch.append(r.asDict())
        if len(batch) == most:
            yield batch
            batch = []
    if batch:
        yield batch


def run_sync(spark: SparkSession, tables: dict[str, tuple[DataFrame, DataFrame]], adapter, direction: str = "both", include=None, exclude=()) -> tuple[dict, dict]:
    """({name: merged changes of it}, {"pushed", "pulled"}): local changes are noted, remote ones pulled and merged, then the noted ones pushed.

    tables: name -> (rows, tombstones). The adapter has pull(since) -> list of changes and push(list).
    """
    if direction not in ("push", "pull", "both"):
        raise ValueError(f"no such direction: {direction}")
    names = changes.selected(list(tables), include, exclude)
    local = {n: changes.exported(*tables[n], n) for n in names}
    out, pulled = dict(local), 0
    if direction != "push":
        got = [c for c in adapter.pull(0) if c["collection"] in names]
        pulled = len(got)
        remote = spark.createDataFrame([(c["collection"], c["_id"], c["op"], c["changed_at"], c.get("doc")) for c in got], CHANGES)
        out = {n: changes.merged(local[n], remote.where(F.col("collection") == n)) for n in names}
    pushed = 0
    if direction != "pull":
        for n in names:
            for batch in batches(local[n]):
                adapter.push(batch)
                pushed += len(batch)
    return out, {"pushed": pushed, "pulled": pulled}


def applied(df: DataFrame, merged: DataFrame, schema: str, id_col: str = "_id") -> DataFrame:
    """Rows of a collection after a merge: documents of the winning upserts, of the schema given."""
    live = merged.where("op = 'upsert'").select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), F.from_json("doc", schema).alias("d"), F.col("changed_at").alias("_changed_at"))
    return updates.removed(df, merged.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col)), id_col).unionByName(live.select(id_col, "d.*", "_changed_at"), allowMissingColumns=True)
