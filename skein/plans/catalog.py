"""The engine's own queries by name, over whole tables, and their SQL."""

import tempfile
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import crypto, ids, text, vectors
from skein.operators import audit, changes, crdt, sync, updates, vector_index
from skein.operators.collection import Collection, migrate_saved
from skein.operators.schema import Schema
from skein.sources import files, rest
from skein.streaming import live

FLAGSHIP = "aggregate_purchases"
#: The fixed query vector of the vector searches.
QUERY = [round(((k * 37) % 64 - 31.5) / 32, 5) for k in range(64)]
_Q = f"[{', '.join(f'{x}::DOUBLE' for x in QUERY)}]"


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumnRenamed(key, "_id") if key else df


def _find(name: str, key: str, where: dict, fields: list[str]):
    return lambda s, d: Collection(table(s, d, name, key)).find(where).select("_id", *fields)


def _aggregate(name: str, key: str, stages: list):
    return lambda s, d: Collection(table(s, d, name, key)).aggregate(stages)


def _nearest(metric: str, where: dict | None = None, k: int = 10):
    def run(s, d):
        c = Collection(table(s, d, "embeddings", "vec_id"))
        c.create_vector_index("embedding", 64, metric)
        return c.find_nearest("embedding", QUERY, k, where).select("_id", F.round("_score", 6).alias("score"))

    return run


def _events_with_props(s, d):
    return table(s, d, "events", "event_id").withColumn("props", F.from_json("props", "k bigint"))


def _changes(s, d, lag: int):
    o = table(s, d, "orders", "o_orderkey")
    stamp = (F.col("_id") % 1000 + lag * (F.col("_id") % 3)).cast("long")
    op = F.when(F.col("_id") % 7 == lag, "delete").otherwise("upsert")
    doc = F.when(op == "upsert", F.concat(F.lit(f"{lag}:"), F.col("o_orderstatus")))
    return o.select(F.lit("orders").alias("collection"), F.col("_id").cast("string").alias("_id"), op.alias("op"), stamp.alias("changed_at"), doc.alias("doc"))


def _sql_changes(lag: int) -> str:
    return f"SELECT 'orders' AS collection, CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 7 = {lag} THEN 'delete' ELSE 'upsert' END AS op, CAST(o_orderkey % 1000 + {lag} * (o_orderkey % 3) AS BIGINT) AS changed_at, CASE WHEN o_orderkey % 7 <> {lag} THEN '{lag}:' || o_orderstatus END AS doc FROM orders"


def _validated(s, d):
    c = table(s, d, "customer", "c_custkey").withColumn("_v", (F.col("_id") % 3).cast("int")).withColumn("nick", F.when(F.col("_id") % 5 != 0, F.col("c_name")))
    out = changes.validated(c, 1, required=["name"], types={"c_acctbal": "float"}, defaults={"tier": "basic"}, renames={"nick": "name"})
    return out.select("_id", "_v", "name", "tier", "decision", "reason")


def _upsert(s, d):
    old = table(s, d, "supplier", "s_suppkey").withColumn("_remote_rev", F.col("_id") % 4)
    new = old.where("_id % 2 = 0").withColumn("s_acctbal", F.lit(0.0)).withColumn("_remote_rev", F.col("_id") % 5)
    return updates.upserted(old, new.unionByName(new.withColumn("_id", F.col("_id") + 1_000_000)), revision="_remote_rev")


def _orders_after(s, d):
    """Orders after an update of some, the deletion of others and as many insertions."""
    o = updates.updated(table(s, d, "orders", "o_orderkey"), {"o_orderstatus": "F"}, {"$set": {"o_totalprice": 0.0}})
    return updates.deleted(o, {"o_orderstatus": "P"}).unionByName(o.where("o_orderstatus = 'P'").withColumn("_id", F.col("_id") + 100_000_000))


def _tombs(s, d):
    return table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.lit("orders").alias("collection"), F.col("o_orderkey").alias("_id"), (F.col("o_orderkey") % 100).cast("long").alias("deleted_at"))


def _few(s, d):
    return table(s, d, "orders", "o_orderkey").select("_id", "o_orderstatus", "o_totalprice")


def _import_fields(s, d):
    local = crdt.stamped(_few(s, d), "a", F.col("_id") % 9)
    theirs = crdt.stamped(_few(s, d).select("_id", F.lit("X").alias("o_orderstatus")), "b", (F.col("_id") + 4) % 9)
    dead = table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.lit("orders").alias("collection"), F.col("o_orderkey").alias("_id"), F.lit(99).cast("long").alias("deleted_at"))
    rows, _ = crdt.imported(local, dead.where("false"), crdt.exported(theirs, dead, "orders", -1), "orders", most=None)
    return rows.select("_id", "o_orderstatus", "o_totalprice", "_changed_at")


def _encrypted(s, d):
    old, new = b"0123456789abcdef", b"fedcba9876543210fedcba9876543210"
    plain = table(s, d, "customer", "c_custkey").select("_id", "c_name", "c_acctbal")
    stored = crypto.rekeyed(crypto.encrypted(plain, ["c_name", "c_acctbal"], old), ["c_name", "c_acctbal"], old, new)
    moved = F.try_aes_decrypt("c_name", F.lit(new), F.lit("GCM"), F.lit("DEFAULT"), crypto.place("c_acctbal", "_id"))
    told = stored.withColumn("hidden", ~F.col("c_name").cast("string").contains("Customer")).withColumn("bound", moved.isNull())
    return crypto.decrypted(told, {"c_name": "string", "c_acctbal": "double"}, new).select("_id", "c_name", "c_acctbal", "hidden", "bound")


def _own_folder(s) -> str:
    return f"{files.shared_folder(s)}/catalog-{uuid.uuid4().hex}"


def _snapshot(s, d):
    path = _own_folder(s)
    files.snapshot({"nation": table(s, d, "nation", "n_nationkey"), "region": table(s, d, "region", "r_regionkey")}, path)
    return files.restore(s, path)["nation"]


def _round_trip(s, d):
    path = _own_folder(s)
    files.write(table(s, d, "customer", "c_custkey").select("_id", "c_name", "c_acctbal"), path, "ndjson")
    return files.read(s, path, "ndjson").select("c_name", "c_acctbal")


def _live(s, d):
    path, told = _own_folder(s), []
    files.write(table(s, d, "events", "event_id"), path)
    kinds = s.read.parquet(path).schema
    query = lambda: Collection(s.read.schema(kinds).parquet(path)).aggregate([{"$group": {"_id": "$event_type", "n": {"$sum": 1}}}])
    live.watch(s.readStream.schema(kinds).parquet(path), query, lambda df: told.append(df.collect()), f"{path}-at", once=True).awaitTermination()
    return s.createDataFrame(told[-1], "_id string, n long")


def _replicate(s, d):
    """A walk over pages of nations, then a delta that deletes one; each page is committed as files, one replica's state kept."""
    rows = [{"id": r.n_nationkey, "rev": 1, "n_name": r.n_name, "n_regionkey": r.n_regionkey} for r in table(s, d, "nation").orderBy("n_nationkey").toLocalIterator()]

    def get(path, params):
        if "since" in params:
            return {"data": [], "deleted": [3], "cursor": "c2"}
        at = int(params.get("page", 0))
        follows = at + int(params["limit"]) if at + int(params["limit"]) < len(rows) else None
        return {"data": rows[at : at + int(params["limit"])], "nextPage": follows, "snapshot": "s", "deltaCursor": "c1"}

    kind = "_id string, n_name string, n_regionkey long, _remote_rev long"
    held = [s.createDataFrame([], kind)]

    def commit(df):
        path = _own_folder(s)
        df.write.parquet(path)
        held[0] = s.read.parquet(path)

    with tempfile.TemporaryDirectory() as folder:  # the driver's own notes
        copy = sync.Replica(s, rest.RestSource("nations", "nation", get=get, delta=True), "n_name string, n_regionkey long", sync.CheckpointFile(f"{folder}/state"), lambda page: commit(updates.upserted(held[0], page, revision="_remote_rev")), lambda gone: commit(updates.removed(held[0], gone)), 10)
        copy.hydrate()
        copy.refresh()
    return held[0].select("n_name", "n_regionkey")


def _browsed(s, d):
    told = Collection(table(s, d, "customer", "c_custkey")).page(3, 40)
    return told["documents"].select("_id", "c_name", *[F.lit(told[x]).cast("long").alias(x) for x in ("total", "pages")])


def _migrated(s, d):
    steps = {1: lambda df: df.withColumnRenamed("s_name", "name"), 3: lambda df: df.withColumn("name", F.upper("name"))}
    path, old = _own_folder(s), table(s, d, "supplier", "s_suppkey")
    migrate_saved(old, {1: steps[1]}, path)
    version, new = migrate_saved(old, steps, path)  # goes on after version 1
    return new.select("_id", "name", F.lit(version).alias("version"))


def _index_of(s, d):
    path = _own_folder(s)
    vector_index.build(table(s, d, "embeddings", "vec_id"), "embedding", 64, path)
    return path


def _indexed(s, d):
    """All cells probed: the index then answers exactly."""
    return vector_index.search(s, _index_of(s, d), QUERY, 10, probes=1 << 20).select("_id", F.round("_score", 6).alias("score"))


def _recall(s, d):
    """Whether searches of the default cells find 9 of 10 of the nearest ten, for stored vectors as queries."""
    path, vectors_ = _index_of(s, d), table(s, d, "embeddings", "vec_id")
    c = Collection(vectors_)
    c.create_vector_index("embedding", 64)
    found = wanted = 0
    for r in vectors_.where("_id % 100 = 0").orderBy("_id").limit(10).collect():
        exact = {x["_id"] for x in c.find_nearest("embedding", r["embedding"], 10).select("_id").collect()}
        found += len(exact & {x["_id"] for x in vector_index.search(s, path, r["embedding"], 10).select("_id").collect()})
        wanted += len(exact)
    return s.createDataFrame([(found >= 0.9 * wanted,)], "good boolean")


#: Ids of orders: FNV-1a byte by byte in two halves of 64 bits, then 26 digits of five bits.
_SQL_IDS = f"""
WITH k AS (SELECT o_orderkey, list_transform(string_split('orders' || chr(1) || CAST(o_orderkey AS VARCHAR), ''), lambda c: CASE WHEN c = chr(1) THEN 0 ELSE ord(c) END) AS b FROM orders),
h AS (SELECT o_orderkey, list_reduce(list_transform(b, lambda x: {{'hi': 0::UHUGEINT, 'lo': x::UHUGEINT}}), lambda a, x: {{
  'hi': (a.hi * 315 + ((xor(a.lo::UBIGINT, x.lo::UBIGINT)::UHUGEINT * 315) // 18446744073709551616) + (xor(a.lo::UBIGINT, x.lo::UBIGINT)::UHUGEINT % 1099511627776) * 16777216) % 18446744073709551616,
  'lo': (xor(a.lo::UBIGINT, x.lo::UBIGINT)::UHUGEINT * 315) % 18446744073709551616}}, {{'hi': {ids.BASIS >> 64}::UHUGEINT, 'lo': {ids.BASIS & (1 << 64) - 1}::UHUGEINT}}) AS h FROM k)
SELECT o_orderkey, list_aggregate(list_transform(range(25, -1, -1), lambda i: substr('{ids.DIGITS}', 1 + CAST(
  CASE WHEN i < 12 THEN (h.lo // (1::UHUGEINT << (5 * i)::UHUGEINT)) % 32
       WHEN i = 12 THEN (h.lo // 1152921504606846976 + h.hi * 16) % 32
       ELSE (h.hi // (1::UHUGEINT << (5 * i - 64)::UHUGEINT)) % 32 END AS INT), 1)), 'string_agg', '') AS _id FROM h
"""

_Q_MATCH = {"event_type": "purchase", "value": {"$gte": 10}}
_SPEC = {
    # name: (query, SQL)
    "aggregate_purchases": (
        _aggregate("events", "event_id", [{"$match": _Q_MATCH}, {"$group": {"_id": "$user_id", "total": {"$sum": "$value"}, "n": {"$sum": 1}}}, {"$sort": {"n": -1}}, {"$limit": 10}, {"$project": {"_id": 1, "n": 1}}]),
        "SELECT user_id AS _id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value >= 10 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    ),
    "browse_page": (_browsed, "SELECT c_custkey AS _id, c_name, (SELECT count(*) FROM customer) AS total, (SELECT (count(*) + 39) // 40 FROM customer) AS pages FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 80"),
    "migrate_saved": (_migrated, "SELECT s_suppkey AS _id, upper(s_name) AS name, 3 AS version FROM supplier"),
    "find_full_scan": (_find("region", "r_regionkey", {}, ["r_name"]), "SELECT r_regionkey AS _id, r_name FROM region"),
    "find_by_id": (_find("orders", "o_orderkey", {"_id": {"$in": [1, 5, 7, 99]}}, ["o_totalprice"]), "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 7, 99)"),
    "find_eq": (_find("orders", "o_orderkey", {"o_orderstatus": "F"}, ["o_orderstatus"]), "SELECT o_orderkey AS _id, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "find_strict_type": (_find("orders", "o_orderkey", {"$or": [{"o_custkey": "42"}, {"o_orderstatus": 1}, {"o_custkey": 43}, {"o_totalprice": {"$gt": "0"}}]}, []), "SELECT o_orderkey AS _id FROM orders WHERE o_custkey = 43"),
    "find_ne_missing": (lambda s, d: Collection(table(s, d, "documents", "doc_id").join(table(s, d, "labels", "doc_id"), "_id", "left")).find({"toxic": {"$ne": 1}}).select("_id"), "SELECT d.doc_id AS _id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.toxic <> 1"),
    "find_not_gt_missing": (lambda s, d: Collection(table(s, d, "documents", "doc_id").join(table(s, d, "labels", "doc_id"), "_id", "left")).find({"$not": {"quality": {"$gt": 0}}}).select("_id"), "SELECT d.doc_id AS _id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality <= 0"),
    "find_range_two_sided": (_find("events", "event_id", {"value": {"$gte": 10, "$lt": 20}}, ["value"]), "SELECT event_id AS _id, value FROM events WHERE value >= 10 AND value < 20"),
    "find_in": (_find("part", "p_partkey", {"p_size": {"$in": [1, 5, 9]}}, ["p_size"]), "SELECT p_partkey AS _id, p_size FROM part WHERE p_size IN (1, 5, 9)"),
    "find_nin": (_find("part", "p_partkey", {"p_size": {"$nin": [1, 5, 9]}}, ["p_size"]), "SELECT p_partkey AS _id, p_size FROM part WHERE p_size NOT IN (1, 5, 9)"),
    "find_or": (_find("customer", "c_custkey", {"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, ["c_acctbal"]), "SELECT c_custkey AS _id, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0"),
    "find_compound_eq": (_find("lineitem", "l_orderkey", {"l_returnflag": "R", "l_linestatus": "F", "l_linenumber": 1}, ["l_quantity"]), "SELECT l_orderkey AS _id, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1"),
    "find_exists": (lambda s, d: Collection(table(s, d, "documents", "doc_id").join(table(s, d, "labels", "doc_id"), "_id", "left")).find({"toxic": {"$exists": True}}).select("_id"), "SELECT doc_id AS _id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)"),
    "find_regex": (_find("pages", "page_id", {"url": {"$regex": "[0-9]+5$|a/"}}, ["url"]), "SELECT page_id AS _id, url FROM pages WHERE regexp_matches(url, '[0-9]+5$|a/')"),
    "find_nested": (lambda s, d: Collection(_events_with_props(s, d)).find({"props.k": {"$gte": 50}}).select("_id", F.col("props.k").alias("k")), "SELECT event_id AS _id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50"),
    "find_contains": (_find("documents", "doc_id", {"text": {"$contains": "The with"}}, ["lang"]), "SELECT doc_id AS _id, lang FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the($|[^\\p{L}\\p{N}])') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])with($|[^\\p{L}\\p{N}])')"),
    "fts_postings": (lambda s, d: text.search_postings(text.postings(table(s, d, "documents", "doc_id"), "text"), "the with"), "SELECT doc_id AS _id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the($|[^\\p{L}\\p{N}])') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])with($|[^\\p{L}\\p{N}])')"),
    "find_options": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey")).find({"o_orderstatus": "O"}, sort={"o_orderpriority": -1}, skip=5, limit=20, fields=["o_orderpriority"]), "SELECT o_orderkey AS _id, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "find_one": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey")).find_one({"o_orderstatus": "F"}).select("_id"), "SELECT min(o_orderkey) AS _id FROM orders WHERE o_orderstatus = 'F'"),
    "count": (_aggregate("events", "event_id", [{"$match": {"event_type": "view"}}, {"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": {"_id": 0, "n": 1}}]), "SELECT count(*) AS n FROM events WHERE event_type = 'view'"),
    "group_all_accumulators": (
        _aggregate("lineitem", "l_orderkey", [{"$group": {"_id": "$l_returnflag", "n": {"$count": {}}, "lines": {"$sum": "$l_linenumber"}, "quantity": {"$sum": "$l_quantity"}, "low": {"$min": "$l_discount"}, "high": {"$max": "$l_tax"}, "set": {"$addToSet": "$l_linenumber"}}}]),
        "SELECT l_returnflag AS _id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, sum(l_quantity) AS quantity, min(l_discount) AS low, max(l_tax) AS high, list_sort(list(DISTINCT l_linenumber)) AS set FROM lineitem GROUP BY 1",
    ),
    "group_average": (lambda s, d: Collection(table(s, d, "lineitem", "l_orderkey")).aggregate([{"$group": {"_id": "$l_linestatus", "a": {"$avg": "$l_extendedprice"}}}]).select("_id", F.round("a", 4).alias("a")), "SELECT l_linestatus AS _id, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY 1"),
    "group_ordered": (
        _aggregate("conversations", "turn", [{"$sort": {"conv_id": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "first": {"$first": "$role"}, "last": {"$last": "$role"}}}]),
        "SELECT conv_id AS _id, list(role ORDER BY turn) AS roles, first(role ORDER BY turn) AS first, last(role ORDER BY turn) AS last FROM conversations GROUP BY 1",
    ),
    "group_having": (_aggregate("orders", "o_orderkey", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 12}}}]), "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12"),
    "group_missing_key": (lambda s, d: Collection(table(s, d, "documents", "doc_id").join(table(s, d, "labels", "doc_id"), "_id", "left")).aggregate([{"$group": {"_id": "$quality", "n": {"$sum": 1}}}]), "SELECT l.quality AS _id, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "group_empty": (_aggregate("orders", "o_orderkey", [{"$match": {"o_orderstatus": "none"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"n": 1, "_id": 0}}]), "SELECT count(*) AS n FROM orders WHERE 1 = 0 GROUP BY o_orderkey"),
    "project_exclude": (_aggregate("nation", "n_nationkey", [{"$project": {"n_regionkey": 0}}]), "SELECT n_nationkey AS _id, n_name FROM nation"),
    "sort_skip_limit": (_aggregate("part", "p_partkey", [{"$sort": {"p_size": -1, "p_brand": 1}}, {"$skip": 10}, {"$limit": 25}, {"$project": {"p_size": 1, "p_brand": 1}}]), "SELECT p_partkey AS _id, p_size, p_brand FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 25 OFFSET 10"),
    "nearest_cosine": (_nearest("cosine"), f"SELECT vec_id AS _id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) DESC, vec_id LIMIT 10"),
    "nearest_dot": (_nearest("dot"), f"SELECT vec_id AS _id, round(list_inner_product(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), {_Q}) DESC, vec_id LIMIT 10"),
    "nearest_euclidean": (_nearest("euclidean"), f"SELECT vec_id AS _id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q}), vec_id LIMIT 10"),
    "nearest_hybrid": (_nearest("cosine", {"label": {"$lt": 3}}), f"SELECT vec_id AS _id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings WHERE label < 3 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) DESC, vec_id LIMIT 10"),
    "update_many": (
        lambda s, d: updates.updated(table(s, d, "part", "p_partkey"), {"p_size": {"$gt": 40}}, {"$set": {"p_brand": "big"}, "$inc": {"p_size": 1}, "$unset": {"p_type": 1}}).select("_id", "p_brand", F.col("p_size").cast("int").alias("p_size"), "p_type"),
        "SELECT p_partkey AS _id, CASE WHEN p_size > 40 THEN 'big' ELSE p_brand END AS p_brand, CAST(CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS INT) AS p_size, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS p_type FROM part",
    ),
    "update_lists": (
        lambda s, d: updates.updated(table(s, d, "part", "p_partkey").select("_id", F.split("p_name", " ").alias("tags")), {"_id": {"$lte": 500}}, {"$push": {"tags": "new"}, "$pull": {"tags": "blue"}}),
        "SELECT p_partkey AS _id, CASE WHEN p_partkey <= 500 THEN list_filter(list_append(string_split(p_name, ' '), 'new'), lambda x: x <> 'blue') ELSE string_split(p_name, ' ') END AS tags FROM part",
    ),
    "delete_many": (lambda s, d: updates.deleted(table(s, d, "orders", "o_orderkey"), {"o_orderstatus": "F"}).select("_id"), "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'"),
    "tombstones": (lambda s, d: updates.compacted(updates.tombstones(table(s, d, "orders", "o_orderkey"), {"o_orderstatus": "F"}, "orders", F.col("_id") % 100), 50), "SELECT 'orders' AS collection, o_orderkey AS _id, o_orderkey % 100 AS deleted_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 100 >= 50"),
    "replace_many_with_ids": (
        _upsert,
        "WITH o AS (SELECT s_suppkey AS _id, s_name, s_nationkey, s_acctbal, s_suppkey % 4 AS _remote_rev FROM supplier), n AS (SELECT s_suppkey AS _id, s_name, s_nationkey, 0.0 AS s_acctbal, s_suppkey % 5 AS _remote_rev FROM supplier WHERE s_suppkey % 2 = 0), "
        "a AS (SELECT * FROM n UNION ALL SELECT _id + 1000000, s_name, s_nationkey, s_acctbal, _remote_rev FROM n) SELECT coalesce(o._id, a._id) AS _id, coalesce(o.s_name, a.s_name) AS s_name, coalesce(o.s_nationkey, a.s_nationkey) AS s_nationkey, "
        "CASE WHEN o._id IS NULL OR a._remote_rev > o._remote_rev THEN a.s_acctbal ELSE o.s_acctbal END AS s_acctbal, CASE WHEN o._id IS NULL OR a._remote_rev > o._remote_rev THEN a._remote_rev ELSE o._remote_rev END AS _remote_rev FROM o FULL JOIN a ON o._id = a._id",
    ),
    "change_feed": (
        lambda s, d: updates.changes_between(table(s, d, "orders", "o_orderkey"), _orders_after(s, d)),
        "SELECT o_orderkey AS _id, 'delete' AS op, CAST(NULL AS VARCHAR[]) AS changed FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'update', ['o_totalprice'] FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <> 0 UNION ALL SELECT o_orderkey + 100000000, 'insert', NULL FROM orders WHERE o_orderstatus = 'P'",
    ),
    "merge_lww": (
        lambda s, d: changes.merged(_changes(s, d, 1), _changes(s, d, 2)),
        f"SELECT collection, _id, op, changed_at, doc FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY changed_at DESC, op = 'delete' DESC, coalesce(doc, '') DESC) AS r FROM ({_sql_changes(1)} UNION ALL {_sql_changes(2)})) WHERE r = 1",
    ),
    "merge_fields": (
        lambda s, d: changes.merged_fields(*[table(s, d, "events", "event_id").where(f"_id % 2 = {k}").select(F.lit("e").alias("collection"), F.col("user_id").cast("string").alias("_id"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), F.col("_id").alias("ts"), F.lit(f"n{k}").alias("node")) for k in (0, 1)]),
        "SELECT 'e' AS collection, CAST(user_id AS VARCHAR) AS _id, event_type AS field, CAST(arg_max(value, event_id) AS VARCHAR) AS value, max(event_id) AS ts, 'n' || (max(event_id) % 2) AS node FROM events GROUP BY user_id, event_type",
    ),
    "validate_import": (
        _validated,
        "WITH c AS (SELECT c_custkey AS _id, CAST(c_custkey % 3 AS INT) AS v, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS nick FROM customer), x AS (SELECT _id, v, CASE WHEN v < 1 THEN nick END AS name FROM c) SELECT _id, CASE WHEN v < 1 THEN 1 ELSE v END AS _v, name, CASE WHEN v < 1 THEN 'basic' END AS tier, "
        "CASE WHEN v <= 1 AND name IS NULL THEN 'quarantine' WHEN v < 1 THEN 'coerce' ELSE 'accept' END AS decision, CASE WHEN v <= 1 AND name IS NULL THEN 'name: required' END AS reason FROM x",
    ),
    "newest_cohort": (lambda s, d: changes.newest_cohort(_changes(s, d, 1).withColumn("scope", F.col("changed_at") % 5), ["scope"]).select("scope", "_id", "changed_at"), f"SELECT changed_at % 5 AS scope, _id, changed_at FROM (SELECT *, rank() OVER (PARTITION BY changed_at % 5 ORDER BY changed_at DESC) AS r FROM ({_sql_changes(1)})) WHERE r = 1"),
    "derive_ids": (lambda s, d: table(s, d, "orders").select("o_orderkey", ids.derive("orders", F.col("o_orderkey")).alias("_id")), _SQL_IDS),
    "encrypt_fields": (
        _encrypted,
        "SELECT c_custkey AS _id, c_name, c_acctbal, true AS hidden, true AS bound FROM customer",
    ),
    "find_time_range": (_find("events", "event_id", {"ts": {"$gte": datetime(2024, 1, 5), "$lt": "2024-01-20T12:30:00"}}, ["ts"]), "SELECT event_id AS _id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:30:00'"),
    "find_date": (_find("orders", "o_orderkey", {"$not": {"o_orderdate": {"$lt": "1996-01-01"}}}, ["o_orderdate"]), "SELECT o_orderkey AS _id, o_orderdate FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1996-01-01'"),
    "find_date_eq": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey").withColumn("day", F.col("o_orderdate").cast("date"))).find({"day": {"$in": [date(1996, 1, 2), "1996-01-03"]}}).select("_id"), "SELECT o_orderkey AS _id FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1996-01-02', DATE '1996-01-03')"),
    "find_regex_classes": (_find("documents", "doc_id", {"text": {"$regex": r"(?i)\bthe\s+\p{Lu}\p{L}+"}}, []), r"SELECT doc_id AS _id FROM documents WHERE regexp_matches(text, '(?i)\bthe[ \t\n\r\f\x0B]+\p{Lu}\p{L}+')"),
    "find_by_one_id": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey")).find_by_id(7).select("_id", "o_totalprice"), "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey = 7"),
    "lookup_by_ids": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey")).find_by_ids(table(s, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 2).alias("_id"))).select("_id", "o_custkey"), "SELECT o_orderkey AS _id, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey * 2 FROM lineitem WHERE l_returnflag = 'R')"),
    "page_without_sort": (lambda s, d: Collection(table(s, d, "orders", "o_orderkey").orderBy(F.xxhash64("_id"))).find({"o_orderstatus": "O"}, skip=50, limit=100).select("_id"), "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 100 OFFSET 50"),
    "sum_of_large_integers": (
        lambda s, d: Collection(table(s, d, "orders", "o_orderkey").withColumn("big", F.col("_id").cast("long") + F.lit(2**62))).aggregate([{"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$big"}}}]).select("_id", F.col("total").cast("string").alias("total")),
        "SELECT o_orderstatus AS _id, CAST(sum(CAST(o_orderkey AS HUGEINT) + 4611686018427387904) AS VARCHAR) AS total FROM orders GROUP BY 1",
    ),
    "sum_of_decimals": (
        lambda s, d: Collection(table(s, d, "orders", "o_orderkey").withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))).aggregate([{"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$price"}}}]).select("_id", F.col("total").cast("string").alias("total")),
        "SELECT o_orderstatus AS _id, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS VARCHAR) AS total FROM orders GROUP BY 1",
    ),
    "group_latest_first": (
        _aggregate("events", "event_id", [{"$sort": {"ts": -1}}, {"$group": {"_id": "$user_id", "kinds": {"$push": "$event_type"}, "oldest": {"$last": "$event_type"}}}, {"$project": {"kinds": 1, "oldest": 1}}]),
        "SELECT user_id AS _id, list(event_type ORDER BY ts DESC, event_id) AS kinds, last(event_type ORDER BY ts DESC, event_id) AS oldest FROM events GROUP BY 1",
    ),
    "group_by_text_descending": (
        _aggregate("part", "p_partkey", [{"$sort": {"p_name": -1}}, {"$group": {"_id": "$p_brand", "first": {"$first": "$p_name"}, "last": {"$last": "$p_name"}}}]),
        "SELECT p_brand AS _id, max(p_name) AS first, min(p_name) AS last FROM part GROUP BY 1",
    ),
    "insert_many": (
        lambda s, d: Collection(table(s, d, "supplier", "s_suppkey").withColumn("_id", F.col("_id").cast("string"))).insert_many(table(s, d, "supplier").withColumn("_remote", F.lit(True)), F.concat(F.lit("n"), F.col("s_suppkey")), F.lit(7)).df.select("_id", "s_name", "_changed_at"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name, CAST(NULL AS INT) AS _changed_at FROM supplier UNION ALL SELECT 'n' || s_suppkey, s_name, 7 FROM supplier",
    ),
    "new_ids": (
        lambda s, d: table(s, d, "lineitem").select(ids.new_ids(1_700_000_000_000, 5).alias("i")).agg(F.count("*").alias("rows"), F.count_distinct("i").alias("ids"), F.min(F.substring("i", 1, 10)).alias("low"), F.max(F.substring("i", 1, 10)).alias("high"), F.bool_and(F.col("i").rlike("^[0-9A-HJKMNP-TV-Z]{26}$")).alias("good")),
        f"SELECT count(*) AS rows, count(*) AS ids, '{ids.in_digits(1_700_000_000_000, 10)}' AS low, '{ids.in_digits(1_700_000_000_000, 10)}' AS high, true AS good FROM lineitem",
    ),
    "replace_clears_tombstones": (
        lambda s, d: updates.replaced(table(s, d, "orders", "o_orderkey"), _tombs(s, d), table(s, d, "orders", "o_orderkey").where("o_orderstatus = 'F'"), "orders")[1].select("_id", "deleted_at"),
        "SELECT o_orderkey AS _id, CAST(o_orderkey % 100 AS BIGINT) AS deleted_at FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'",
    ),
    "set_object": (
        lambda s, d: updates.updated(table(s, d, "customer", "c_custkey").select("_id", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("who")), {"who.balance": {"$lt": 0}}, {"$set": {"who": {"name": "x", "balance": 0.5}, "n": 3}}).select("_id", "who.name", "who.balance", "n"),
        "SELECT c_custkey AS _id, CASE WHEN c_acctbal < 0 THEN 'x' ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN 0.5 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN 3 END AS n FROM customer",
    ),
    "schema_on_write": (
        lambda s, d: Schema(["c_name"], {"c_acctbal": "float"}, {"in debt": F.col("c_acctbal") >= 0}, version=2).split(table(s, d, "customer", "c_custkey"))[1].select("_id", "reason"),
        "SELECT c_custkey AS _id, 'in debt' AS reason FROM customer WHERE c_acctbal < 0",
    ),
    "schema_on_read": (
        lambda s, d: Collection(table(s, d, "customer", "c_custkey").withColumn("_v", F.when(F.col("_id") % 2 == 0, 2)), schema=Schema(version=2, migrate=lambda df, v: {"c_name": F.upper("c_name")})).find({"_v": 2}).select("_id", "_v", "c_name"),
        "SELECT c_custkey AS _id, 2 AS _v, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer",
    ),
    "audit_log": (
        lambda s, d: audit.read(audit.entries(updates.changes_between(table(s, d, "orders", "o_orderkey"), _orders_after(s, d)), "orders", "me", F.lit(5), F.col("_id").cast("string")), "orders", "update", "3").select("_id", "op", "doc_id", "ts", "caller"),
        "SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'update' AS op, CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(5 AS BIGINT) AS ts, 'me' AS caller FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <> 0 AND CAST(o_orderkey AS VARCHAR) > '3'",
    ),
    "export_changes": (
        lambda s, d: changes.exported(table(s, d, "orders", "o_orderkey").withColumn("_changed_at", F.col("_id") % 50).withColumn("_remote", F.col("_id") % 5 == 0), _tombs(s, d), "orders", 20).select("collection", "_id", "op", "changed_at"),
        "SELECT 'orders' AS collection, CAST(o_orderkey AS VARCHAR) AS _id, 'upsert' AS op, CAST(o_orderkey % 50 AS BIGINT) AS changed_at FROM orders WHERE o_orderkey % 50 > 20 AND o_orderkey % 5 <> 0 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'delete', CAST(o_orderkey % 100 AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 100 > 20",
    ),
    "export_fields": (
        lambda s, d: crdt.exported(crdt.stamped(_few(s, d), "a", F.col("_id") % 9), _tombs(s, d), "orders", 4).select("_id", "field", "ts", "node"),
        "SELECT CAST(o_orderkey AS VARCHAR) AS _id, f AS field, CAST(o_orderkey % 9 AS BIGINT) AS ts, 'a' AS node FROM orders, (VALUES ('o_orderstatus'), ('o_totalprice')) t(f) WHERE o_orderkey % 9 > 4 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, CAST(o_orderkey % 100 AS BIGINT), '' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 100 > 4",
    ),
    "import_fields": (
        _import_fields,
        "SELECT o_orderkey AS _id, CASE WHEN (o_orderkey + 4) % 9 > o_orderkey % 9 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CAST(greatest(o_orderkey % 9, (o_orderkey + 4) % 9) AS BIGINT) AS _changed_at FROM orders WHERE o_orderkey % 7 <> 0",
    ),
    "grow_sets": (
        lambda s, d: table(s, d, "part", "p_partkey").select("_id", changes.grown(F.split("p_name", " "), F.array(F.lit("blue"), F.lit("new"))).alias("tags")),
        "SELECT p_partkey AS _id, list_concat(string_split(p_name, ' '), list_filter(['blue', 'new'], lambda x: NOT list_contains(string_split(p_name, ' '), x))) AS tags FROM part",
    ),
    "surviving_fields": (
        lambda s, d: changes.surviving(table(s, d, "events", "event_id").select(F.lit("e").alias("collection"), F.col("user_id").cast("string").alias("_id"), F.col("event_type").alias("field"), F.col("_id").alias("ts")), table(s, d, "events").groupBy(F.lit("e").alias("collection"), F.col("user_id").cast("string").alias("_id")).agg((F.max("event_id") - F.max("user_id") % 2).alias("deleted_at"))),
        "SELECT 'e' AS collection, CAST(user_id AS VARCHAR) AS _id, event_type AS field, event_id AS ts FROM events WHERE user_id % 2 = 1",
    ),
    "snapshot_restore": (_snapshot, "SELECT n_nationkey AS _id, n_name, n_regionkey FROM nation"),
    "export_import_json": (_round_trip, "SELECT c_name, c_acctbal FROM customer"),
    "live_count": (_live, "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1"),
    "replicate_pages": (_replicate, "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey <> 3"),
    "push_events": (
        lambda s, d: rest.push(rest.payloads(updates.changes_between(table(s, d, "orders", "o_orderkey"), _orders_after(s, d)).join(_orders_after(s, d), "_id", "left"), "orders", ["o_comment"]), "", dry=True).groupBy("sent").agg(F.count("*").alias("n")),
        "SELECT false AS sent, sum(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN CASE WHEN o_totalprice <> 0 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS n FROM orders",
    ),
    "vector_index": (
        _indexed,
        f"SELECT vec_id AS _id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) DESC, vec_id LIMIT 10",
    ),
    "vector_index_recall": (_recall, "SELECT true AS good"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _SPEC.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _SPEC.items() if sql}
