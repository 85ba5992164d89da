"""Remote origins over HTTP: a source read in pages, and a sink that is told of every change."""

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a response keeps its rows, and what it may call other things.
ROWS = ("data", "items", "rows")
NEXT, CURSOR, TOTAL, DELETED = ("nextPage", "next_page", "next"), ("deltaCursor", "delta_cursor", "cursor"), ("total", "totalCount", "count"), ("deleted", "removed")
#: Pages of one walk, at most; waits between tries, in seconds.
MOST_PAGES, WAITS = 10_000, (0.2, 0.4, 0.8)


class OriginError(RuntimeError):
    """An origin that answers wrongly."""


def fetched(url: str, params: dict, headers: dict | None = None, timeout: float = 30) -> object:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers or {})
    with urllib.request.urlopen(request, timeout=timeout) as response:  # noqa: S310
        return json.loads(response.read())


def rows_of(body: object) -> list:
    if isinstance(body, list):
        return body
    for name in ROWS if isinstance(body, dict) else ():
        if isinstance(body.get(name), list):
            return body[name]
    raise OriginError("no list of rows in the response")


def first_of(body: object, names: tuple) -> object:
    for name in names:
        for part in (body, body.get("meta")) if isinstance(body, dict) else ():
            if isinstance(part, dict) and name in part:
                return part[name]
    return None


class RestSource:
    """Pages of an endpoint. `get` takes a path and parameters; by default it asks over HTTP."""

    def __init__(self, endpoint: str, collection: str, key: str = "id", revision: str = "rev", get: Callable | None = None, delta: bool = False, by_offset: bool = False, headers: dict | None = None):
        self.endpoint, self.collection, self.key, self.revision, self.has_delta, self.by_offset = endpoint, collection, key, revision, delta, by_offset
        self.get = get or (lambda path, params: fetched(path, params, headers))

    def page(self, page, snapshot: str | None, limit: int) -> dict:
        params = {"limit": limit} | ({} if page is None else {"page": page}) | ({} if snapshot is None else {"snapshot": snapshot})
        body = self.get(self.endpoint, params)
        rows = rows_of(body)
        told = isinstance(body, dict) and any(n in part for n in NEXT for part in (body, body.get("meta")) if isinstance(part, dict))
        after = int(page or 0) + limit if self.by_offset else int(page or 1) + 1 if isinstance(page, int | None) else None
        follows = first_of(body, NEXT) if told else None if len(rows) < limit else after
        return {"rows": rows, "next": follows, "snapshot": first_of(body, ("snapshot",)), "cursor": first_of(body, CURSOR), "total": first_of(body, TOTAL)}

    def delta(self, cursor: str) -> dict:
        body = self.get(self.endpoint, {"since": cursor})
        more = first_of(body, ("hasMore", "has_more"))
        return {"rows": rows_of(body), "deleted": first_of(body, DELETED) or [], "cursor": first_of(body, CURSOR) or cursor, "more": bool(more)}

    def keyed(self, row: dict) -> tuple[str, int, dict]:
        """(key, revision, the row without an id of its own)."""
        if row.get(self.key) is None:
            raise OriginError(f"a row without its key {self.key}")
        revision = row.get(self.revision)
        if not isinstance(revision, int | float | str) or isinstance(revision, bool) or int(revision) != float(revision):
            raise OriginError(f"a row without a whole number as its revision {self.revision}")
        return str(row[self.key]), int(revision), {k: v for k, v in row.items() if k != "_id"}


def payloads(changes: DataFrame, collection: str, exclude=(), id_col: str = "_id") -> DataFrame:
    """(id, payload): JSON of each change of updates.changes_between() joined with the row after it, without the excluded fields."""
    names = [c for c in changes.columns if c not in (id_col, "op", "changed", *exclude)]
    hidden = F.array(*[F.lit(x) for x in exclude]) if exclude else F.array().cast("array<string>")
    shown = F.array_except(F.coalesce("changed", F.array().cast("array<string>")), hidden)
    kept = F.struct(*[F.when((F.col("op") == "insert") | F.array_contains(shown, c), F.col(f"`{c}`")).alias(c) for c in names])
    gone = F.filter(shown, lambda x: F.array_contains(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in names]), x))
    body = F.struct(
        F.lit(collection).alias("collection"), F.col(id_col).cast("string").alias("id"), F.col("op").alias("event"),
        F.when(F.col("op") == "insert", kept).alias("document"), F.when(F.col("op") == "update", kept).alias("changes"), F.when(F.col("op") == "update", gone).alias("removed_fields"),
    )
    return changes.select(F.col(id_col).cast("string").alias("id"), F.to_json(body).alias("payload"))


def posted(url: str, body: str, headers: dict | None = None, waits=WAITS, send: Callable | None = None) -> bool:
    """Whether the origin took it. Network errors and answers from 500 on are tried again after each wait; others aren't."""

    def over_http() -> int:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
        with urllib.request.urlopen(request, timeout=30) as response:  # noqa: S310
            return response.status

    for wait in (*waits, None):
        try:
            status = send(url, body) if send else over_http()
        except urllib.error.HTTPError as e:
            status = e.code
        except OSError:
            status = 599
        if status < 500:
            return status < 400
        if wait is not None:
            time.sleep(wait)
    return False


def push(told: DataFrame, url: str, headers: dict | None = None, send: Callable | None = None, dry: bool = False) -> DataFrame:
    """(id, sent) after a POST of each payload; those of one id are sent by one task, in the order of their payloads. `dry` sends none."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sent = [False if dry else posted(url, p, headers, send=send) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent, pa.bool_())], ["id", "sent"])

    return told.select("id", "payload").repartition("id").sortWithinPartitions("id", "payload").mapInArrow(run, "id string, sent boolean")


class HttpAdapter:
    """Change-sets over HTTP: POST <base>/push, GET <base>/pull?since=."""

    def __init__(self, base: str, headers: dict | None = None):
        self.base, self.headers = base.rstrip("/"), headers

    def push(self, changes: list[dict]) -> None:
        if not posted(f"{self.base}/push", json.dumps(changes), self.headers):
            raise OriginError("the origin did not take the changes")

    def pull(self, since: int) -> list[dict]:
        return rows_of(fetched(f"{self.base}/pull", {"since": since}, self.headers))
