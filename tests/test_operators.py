"""Types, writes, schemas, audit, encryption, field clocks, origins, the vector index and the command line."""

import io
import json
import random
import time
from datetime import UTC, date, datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.functions import crypto, ids, text, vectors
from skein.functions.filters import FilterError, compile_filter
from skein.operators import audit, changes, collection, crdt, pipeline, sync, updates, vector_index
from skein.operators.collection import Collection, QueryTimeout
from skein.operators.schema import Schema, SchemaError
from skein.sources import files, rest
from skein.streaming import live


def found(df, spec):
    return [r[0] for r in df.where(compile_filter(spec, df.schema)).orderBy("_id").collect()]


def test_times_and_decimals_in_filters(spark):
    day = datetime(2020, 1, 1)
    rows = [(k, datetime(2020, 1, k), datetime(2020, 1, k, tzinfo=UTC), date(2020, 1, k), Decimal(k) / 2) for k in (1, 2, 3)] + [(4, None, None, None, None)]
    df = spark.createDataFrame(rows, "_id long, n timestamp_ntz, t timestamp, d date, x decimal(10,2)")
    for field in "ntd":
        for value in (datetime(2020, 1, 2), "2020-01-02", "2020-01-02T00:00:00", date(2020, 1, 2), datetime(2020, 1, 2, tzinfo=UTC)):
            assert found(df, {field: {"$gt": value}}) == [3] and found(df, {field: {"$lte": value}}) == [1, 2], (field, value)
            assert found(df, {field: value}) == [2] and found(df, {field: {"$ne": value}}) == [1, 3, 4] and found(df, {field: {"$in": [value, None]}}) == [2, 4]
            assert found(df, {"$not": {field: {"$lt": value}}}) == [2, 3, 4]
        assert found(df, {field: {"$gt": "no time"}}) == [] == found(df, {field: 5}) and found(df, {field: {"$nin": ["no time"]}}) == [1, 2, 3, 4]
    assert found(df, {"d": {"$gt": datetime(2020, 1, 1, 12)}}) == [2, 3] and found(df, {"d": datetime(2020, 1, 1, 12)}) == []
    assert found(df, {"x": {"$gte": Decimal("1.0")}}) == [2, 3] and found(df, {"x": Decimal("0.5")}) == [1] and found(df, {"x": 1}) == [2]
    plan = df.where(compile_filter({"n": {"$gt": day}}, df.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(n" not in plan.lower()


def test_tokens_and_patterns(spark):
    texts = ["हिन्दी भाषा", "Ünï cödé", "foo-bar baz2", "foobar", None, "x y", "日本語 テキスト", "a.b (c) [d] \\E"]
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, s string")
    have = {r[0]: r[1] for r in df.select("_id", text.tokens(F.col("s"))).collect()}
    for i, t in enumerate(texts):
        assert have[i] == (None if t is None else text.tokenize(t)), t
    for query in ("हिन्दी", "भाषा", "CÖDÉ", "foo", "bar baz2", "foobar", "テキスト 日本語", "oo", "x", ""):
        want = [i for i, t in enumerate(texts) if not text.tokenize(query) or t and set(text.tokenize(query)) <= set(text.tokenize(t))]
        assert found(df, {"s": {"$contains": query}}) == want, query
    assert found(df, {"s": {"$regex": r"^\p{L}+$"}}) == [3] and found(df, {"s": {"$regex": "(?P<a>foo)-"}}) == [2]
    for bad in ("(", 5, "[", "(?<1>a)"):
        with pytest.raises(FilterError):
            compile_filter({"s": {"$regex": bad}}, df.schema)


@pytest.mark.parametrize("kind", ["long", "double", "string", "binary", "date", "timestamp", "timestamp_ntz", "boolean", "decimal(8,2)"])
def test_accumulators_follow_any_sort(spark, kind):
    values = {"long": [5, -(2**63), 2**63 - 1], "double": [1.5, -0.5, float("inf")], "string": ["ab", "abc", "é", ""], "binary": [b"\x00", b"\xff", b""], "date": [date(1960, 1, 1), date(2020, 1, 1)], "timestamp": [datetime(1960, 1, 1), datetime(2020, 1, 1, 1)], "timestamp_ntz": [datetime(1960, 1, 1), datetime(2020, 1, 1, 1)], "boolean": [True, False], "decimal(8,2)": [Decimal("1.50"), Decimal("-2.25")]}[kind]
    rows = [(k, v) for k, v in enumerate([*values, None, *values])]
    df = spark.createDataFrame(rows, f"_id long, v {kind}").repartition(3)
    for way in (1, -1):
        stages = [{"$sort": {"v": way}}, {"$group": {"_id": None, "ids": {"$push": "$_id"}, "first": {"$first": "$_id"}, "last": {"$last": "$_id"}}}]
        got = pipeline.aggregate(df, stages).first()
        there = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1], reverse=way == -1)
        there = [r[0] for r in there]
        lone = [len(values)]
        assert got["ids"] == (lone + there if way == 1 else there + lone)
        assert got["ids"] == [r["_id"] for r in pipeline.aggregate(df, stages[:1]).collect()]
        assert (got["first"], got["last"]) == (got["ids"][0], got["ids"][-1])
        plan = pipeline.aggregate(df, stages)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan


def test_sums_are_exact(spark):
    df = spark.createDataFrame([(1, 2**62, Decimal("1.50"), 7, 0.5), (2, 2**62, Decimal("1.50"), 2**31 - 1, 0.25), (3, None, None, None, None)], "_id long, big long, price decimal(10,2), small int, x double")
    spec = {"_id": None, "big": {"$sum": "$big"}, "price": {"$sum": "$price"}, "small": {"$sum": "$small"}, "x": {"$sum": "$x"}, "none": {"$sum": "$nothing"}}
    got = pipeline.aggregate(df, [{"$group": spec}]).first()
    assert (got["big"], got["price"], got["small"], got["x"], got["none"]) == (2**63, Decimal("3.00"), 2**31 + 6, 0.75, 0)
    got = pipeline.aggregate(df.where("_id = 3"), [{"$group": spec}]).first()
    assert (got["big"], got["price"], got["small"], got["x"]) == (0, 0, 0, 0.0)


def test_pages_without_a_sort_go_along_ids(spark):
    df = spark.createDataFrame([(k,) for k in (5, 3, 9, 1, 7)], "_id long").repartition(4)
    assert [r[0] for r in Collection(df).find(limit=2, skip=1).collect()] == [3, 5]
    assert [r[0] for r in pipeline.aggregate(df, [{"$skip": 3}, {"$limit": 5}]).collect()] == [7, 9]
    groups = pipeline.aggregate(df, [{"$group": {"_id": "$_id", "n": {"$sum": 1}}}, {"$limit": 2}]).collect()
    assert [r[0] for r in groups] == [1, 3]


def test_set_takes_only_what_fits(spark):
    df = spark.createDataFrame([(1, 2, "a", {"b": 1}, [1])], "_id long, n int, s string, o struct<b: int>, l array<int>")
    out = updates.updated(df, {}, {"$set": {"n": 5, "s": None, "o": {"b": 2}, "l": [3, 4], "new": {"x": 1}}, "$pull": {"l": "no number"}}).first()
    assert (out["n"], out["s"], out["o"]["b"], out["l"], out["new"]["x"]) == (5, None, 2, [3, 4], 1)
    for bad in ({"n": "five"}, {"n": 2**40}, {"n": 1.5}, {"s": 1}, {"o": 3}, {"o": {"c": 1}}, {"l": 1}, {"n": {"a": 1}}):
        with pytest.raises(FilterError):
            updates.updated(df, {}, {"$set": bad})
    with pytest.raises(FilterError):
        updates.updated(df, {}, {"$push": {"l": "x"}})


def test_upserts_and_inserts(spark):
    kind = "_id long, v string, rev long"
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 1)], kind)
    new = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "z", 2), (4, "w", None)], kind)
    got = {r["_id"]: r["v"] for r in updates.upserted(old, new, revision="rev").collect()}
    assert got == {1: "a", 2: "y", 3: "z", 4: "w"}
    assert {r["_id"]: r["v"] for r in updates.upserted(old, new).collect()} == {1: "x", 2: "y", 3: "z", 4: "w"}
    dead = spark.createDataFrame([("docs", 4, 9), ("docs", 8, 9), ("other", 4, 9)], "collection string, _id long, deleted_at long")
    assert sorted(updates.replaced(old, dead, new, "docs")[1].select("collection", "_id").collect()) == [("docs", 8), ("other", 4)]
    c = Collection(spark.createDataFrame([], "_id string, v string"), caller="me")
    c = c.insert_many(spark.createDataFrame([("a", 1, True), ("b", 2, False)], "v string, _changed_at long, _remote boolean"))
    rows = c.df.collect()
    assert len({r["_id"] for r in rows}) == 2 and all(len(r["_id"]) == 26 and r["_changed_at"] > 10**12 for r in rows) and "_remote" not in c.df.columns
    c = Collection(spark.createDataFrame([("1", "a"), ("2", "b")], "_id string, v string"), caller="me").update_many({"v": "a"}, {"$set": {"v": "c"}}).delete_one({"v": "b"})
    log = c.log.collect()
    assert sorted((r["op"], r["doc_id"], r["caller"]) for r in log) == [("delete", "2", "me"), ("update", "1", "me")]
    assert [r["op"] for r in audit.read(c.log, "docs", "delete").collect()] == ["delete"] and audit.read(c.log, "none").count() == 0
    assert audit.read(c.log, since=max(r["_id"] for r in log)).count() == 0
    with pytest.raises(ValueError):
        audit.read(c.log, op="rename")
    assert Collection(old).find_by_ids(spark.createDataFrame([(1,), (1,), (9,)], "_id long")).count() == 1


def test_derived_ids_are_fnv(spark):
    rnd = random.Random(4)
    keys = ["", None, "a", "ñ💡", "x" * 300, *("".join(rnd.choice("ab1-é") for _ in range(rnd.randrange(40))) for _ in range(200))]

    def plain(key):
        h = ids.BASIS
        for byte in b"c\0" + key.encode():
            h = (h ^ byte) * ids.PRIME % (1 << 128)
        return ids.in_digits(h)

    assert ids.derived_ids("c", pa.array(keys)).to_pylist() == [None if k is None else plain(k) for k in keys]
    assert ids.derived_ids("c", pa.array([], pa.string())).to_pylist() == []
    made = spark.range(2000, numPartitions=4).select(ids.new_ids(5, 6).alias("i")).collect()
    assert len({r["i"] for r in made}) == 2000 and all(r["i"].startswith(ids.in_digits(5, 10)) for r in made)


def test_field_encryption(spark):
    key, other = b"k" * 16, b"o" * 32
    df = spark.createDataFrame([(1, "secret", 4.5, [1, 2]), (2, None, None, None)], "_id long, s string, x double, l array<int>")
    stored = crypto.encrypted(df, ["s", "x", "l"], key).cache()
    assert dict(stored.dtypes)["s"] == "binary" and b"secret" not in bytes(stored.first()["s"])
    kinds = {"s": "string", "x": "double", "l": "array<int>"}
    assert crypto.decrypted(stored, kinds, key).collect() == df.collect()
    half = stored.where("_id = 1")
    again = crypto.rekeyed(crypto.rekeyed(half, list(kinds), key, other), list(kinds), key, other)  # a second run changes nothing
    assert crypto.decrypted(again, kinds, other).collect() == df.where("_id = 1").collect()
    for wrong in (crypto.decrypted(stored, kinds, other), crypto.decrypted(half.withColumn("_id", F.lit(3)), kinds, key), crypto.rekeyed(half, ["s"], b"z" * 16, other)):
        with pytest.raises(Exception, match="AES|neither key"):
            wrong.collect()
    with pytest.raises(crypto.KeyLengthError):
        crypto.encrypted(df, ["s"], b"short")
    c = Collection(crypto.encrypted(df.limit(0), list(kinds), key), secret=(kinds, key)).insert_with_ids(df)
    assert c.find({"s": "secret"}).count() == 1 and c.aggregate([{"$match": {"s": "secret"}}]).count() == 0


def test_schemas(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (2, None, 2, 3), (3, "c", -1, 2)], "_id long, name string, n int, _v int")
    s = Schema(["name"], {"n": "int"}, {"n: negative": F.col("n") >= 0}, version=2, migrate=lambda d, v: {"name": F.concat(F.col("name"), F.lit("!"))})
    good, bad = s.split(df)
    assert [(r["_id"], r["_v"]) for r in good.collect()] == [(1, 2)]
    assert {r["_id"]: r["reason"] for r in bad.collect()} == {2: "name: required", 3: "n: negative"}
    with pytest.raises(Exception, match="insert: name: required"):
        s.written(df).collect()
    assert {r["_id"]: (r["name"], r["_v"]) for r in s.read(df).collect()} == {1: ("a!", 2), 2: (None, 3), 3: ("c", 2)}
    assert [r["_id"] for r in s.upgraded(df).collect()] == [1]
    assert Schema(types={"name": "int"}).split(df)[1].count() == 2 and Schema(["gone"]).split(df)[0].count() == 0
    for wrong in (lambda: Schema(migrate=lambda d, v: {}), lambda: Schema(types={"a": "float64"})):
        with pytest.raises(SchemaError):
            wrong()


def merged_by_hand(local, dead, remote, g_sets):
    """Documents {id: {field: (value, (t, n))}}, tombstones {id: ts}, and changes (id, field, value, ts, node) merged one by one."""
    docs, tombs = {k: dict(v) for k, v in local.items()}, dict(dead)
    for k in sorted({c[0] for c in remote}):
        gone = max((c[3:] for c in remote if c[0] == k and c[1] is None), default=None)
        fields = [c for c in remote if c[0] == k and c[1] is not None]
        if gone:
            tombs[k] = max(tombs.get(k, 0), gone[0])
            if k in docs and gone > (max(c[0] for _, c in docs[k].values()), ""):
                del docs[k]
        if not fields or k not in docs and max(f[3] for f in fields) <= tombs.get(k, -1):
            continue
        tombs.pop(k, None) if k not in docs or k in dead or gone else None
        doc = docs.setdefault(k, {})
        for _, f, v, ts, node in sorted(fields, key=lambda c: c[3:]):
            have, clock = doc.get(f, (None, (0, "")))
            if f in g_sets:
                doc[f] = ((have or []) + [x for x in v if x not in (have or [])], max(clock, (ts, node)))
            elif (ts, node) > clock:
                doc[f] = (v, (ts, node))
    return docs, tombs


def test_field_clocks(spark):
    rnd = random.Random(9)
    kind = "_id string, a string, tags array<string>"
    for turn in range(3):
        replicas = []
        for node in "xy":
            docs = {str(k): {"a": (rnd.choice("pqr"), (rnd.randrange(1, 9), node)), "tags": ([rnd.choice("stu")], (rnd.randrange(1, 9), node))} for k in range(12) if rnd.random() < 0.7}
            dead = {str(k): rnd.randrange(1, 12) for k in range(12) if str(k) not in docs and rnd.random() < 0.6}
            rows = [(k, d["a"][0], d["tags"][0], {f: {"t": c[0], "n": c[1]} for f, (_, c) in d.items()}, max(c[0] for _, c in d.values())) for k, d in docs.items()]
            frame = spark.createDataFrame(rows, f"{kind}, _clocks map<string,struct<t:bigint,n:string>>, _changed_at long")
            replicas.append((docs, dead, frame, spark.createDataFrame([("c", k, t) for k, t in dead.items()], "collection string, _id string, deleted_at long")))
        (mine, my_dead, df, tombs), (theirs, their_dead, other, other_dead) = replicas
        told = crdt.exported(other, other_dead, "c")
        remote = [(k, f, v, *c) for k, d in theirs.items() for f, (v, c) in d.items()] + [(k, None, None, t, "") for k, t in their_dead.items()]
        got = {r["_id"]: (r["a"], r["tags"], {f: (c["t"], c["n"]) for f, c in r["_clocks"].items()}) for r in crdt.imported(df, tombs, told, "c", ["tags"])[0].collect()}
        want, _ = merged_by_hand(mine, my_dead, remote, ["tags"])
        assert got == {k: (d["a"][0], d["tags"][0], {f: c for f, (_, c) in d.items()}) for k, d in want.items()}, turn
    rows = spark.createDataFrame([("1", "v", None)], kind)
    stamped = crdt.stamped(rows, "n", F.lit(5))
    assert stamped.first()["_clocks"].keys() == {"a"} and stamped.first()["_changed_at"] == 5
    later = crdt.updated(stamped, F.col("_id") == "1", {"tags": F.array(F.lit("s")), "_own": F.lit(1)}, "m", F.lit(3)).first()
    assert later["_clocks"]["tags"]["n"] == "m" and later["_changed_at"] == 5 and later["a"] == "v"
    with pytest.raises(ValueError, match="more than 1"):
        crdt.imported(stamped, tombs, told, "c", most=1)
    assert crdt.imported(stamped, tombs, told, "c", allowed=["d"])[0] is stamped


class Origin:
    def __init__(self, rows, fails=()):
        self.rows, self.fails, self.asked = rows, set(fails), []

    def __call__(self, path, params):
        self.asked.append(params)
        if "since" in params:
            return {"items": [{"id": 1, "rev": 9, "v": "new"}], "removed": [2], "meta": {"cursor": f"{params['since']}+"}, "hasMore": params["since"] == "c"}
        at = int(params.get("page") or 0)
        if at in self.fails:
            self.fails.discard(at)
            raise OSError("gone")
        n = int(params["limit"])
        return {"data": self.rows[at : at + n], "nextPage": at + n if at + n < len(self.rows) else None, "snapshot": "s", "deltaCursor": "c"}


def test_replicas_resume_and_refresh(spark, tmp_path):
    origin = Origin([{"id": k, "rev": 1, "v": f"v{k}"} for k in range(7)], fails=[4])
    kind = "_id string, v string, _remote_rev long"
    held = [spark.createDataFrame([], kind)]

    def commit(df):
        held[0] = spark.createDataFrame(df.collect(), kind)

    store = sync.CheckpointFile(str(tmp_path / "at"))
    copy = sync.Replica(spark, rest.RestSource("o", "c", get=origin, delta=True), "v string", store, lambda p: commit(updates.upserted(held[0], p, revision="_remote_rev")), lambda g: commit(updates.removed(held[0], g)), 2)
    with pytest.raises(OSError):
        copy.hydrate()
    assert store.read(copy.key)["status"] == "error" and held[0].count() == 4
    assert copy.hydrate()["status"] == "complete" and held[0].count() == 7 and sum(a.get("page") in (None, 0) for a in origin.asked) == 1
    assert copy.refresh()["cursor"] == "c++"
    assert sorted(r["v"] for r in held[0].collect()) == sorted(["v0", "new", *(f"v{k}" for k in range(3, 7))])
    assert copy.bridge([{"id": 50, "rev": 1, "v": "b"}]).count() == 1 and held[0].count() == 7
    for bad in ({"rev": 1}, {"id": 1}, {"id": 1, "rev": "x"}, {"id": 1, "rev": 1.5}):
        with pytest.raises((rest.OriginError, ValueError)):
            copy.source.keyed(bad)
    with pytest.raises(rest.OriginError):
        rest.rows_of({"x": 1})
    bare = rest.RestSource("o", "c", get=lambda p, q: [{"id": 1}] * int(q["limit"]) if q.get("page") != 3 else [])
    assert [bare.page(p, None, 2)["next"] for p in (None, 2, 3)] == [2, 3, None]


def test_changes_are_pushed(spark):
    before = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "_id long, v string, secret string")
    after = spark.createDataFrame([(1, None, "t"), (3, "c", "s")], "_id long, v string, secret string")
    told = rest.payloads(updates.changes_between(before, after).join(after, "_id", "left"), "c", ["secret"]).collect()
    got = {r["id"]: json.loads(r["payload"]) for r in told}
    assert got["1"]["event"] == "update" and got["1"]["removed_fields"] == ["v"] and "secret" not in json.dumps(got) and got["3"]["document"] == {"v": "c"} and got["2"]["event"] == "delete"
    answers = iter([503, OSError(), 200])

    def send(url, body):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert rest.posted("u", "{}", waits=(0, 0), send=send)
    assert not rest.posted("u", "{}", waits=(0,), send=lambda u, b: 500) and not rest.posted("u", "{}", waits=(9,), send=lambda u, b: 404)
    assert rest.push(spark.createDataFrame(told), "u", send=lambda u, b: 200).where("sent").count() == 3


def test_sync_rounds(spark):
    class Adapter:
        def __init__(self):
            self.sent = []

        def pull(self, since):
            return [{"collection": "c", "_id": "1", "op": "upsert", "changed_at": 9, "doc": '{"v":"far"}'}, {"collection": "hidden", "_id": "1", "op": "delete", "changed_at": 9}]

        def push(self, batch):
            self.sent += batch

    df = spark.createDataFrame([("1", "near", 5), ("2", "own", 6)], "_id string, v string, _changed_at long")
    dead = spark.createDataFrame([("c", "4", 3)], "collection string, _id string, deleted_at long")
    adapter = Adapter()
    out, told = sync.run_sync(spark, {"c": (df, dead), "hidden": (df, dead)}, adapter, exclude=["hidden"])
    assert told == {"pushed": 3, "pulled": 1} and {c["op"] for c in adapter.sent} == {"upsert", "delete"}
    assert {r["_id"]: r["v"] for r in sync.applied(df, out["c"], "v string").collect()} == {"1": "far", "2": "own"}
    with pytest.raises(ValueError):
        sync.run_sync(spark, {}, adapter, "sideways")


def test_migrations_go_on_where_they_stopped(spark, tmp_path):
    done, path = [], f"file://{tmp_path}/tables"

    def step(v, fails=False):
        def work(df):
            done.append(v)
            return df.withColumn(f"v{v}", F.raise_error(F.lit("stopped")).cast("int") if fails else F.lit(v))

        return work

    df = spark.createDataFrame([(1,), (2,)], "_id long")
    with pytest.raises(Exception, match="stopped"):
        collection.migrate_saved(df, {5: step(5, True), 2: step(2)}, path)
    version, out = collection.migrate_saved(df, {5: step(5), 2: step(2)}, path)
    assert version == 5 and done == [2, 5, 5] and sorted(map(tuple, out.collect())) == [(1, 2, 5), (2, 2, 5)]
    assert collection.migrate_saved(df, {2: step(2), 5: step(5)}, path)[0] == 5 and len(done) == 3
    assert collection.migrate_saved(df, {}, path)[1].count() == 2
    for wrong in ({0: step(0)}, {1.5: step(1)}, {True: step(1)}):
        with pytest.raises(ValueError):
            collection.migrate_saved(df, wrong, path)


def test_pages(spark):
    c = Collection(spark.range(0, 1203).withColumnRenamed("id", "_id"))
    told = c.page(3, 500)
    assert (told["total"], told["page"], told["per_page"], told["pages"]) == (1203, 3, 500, 3)
    assert [r._id for r in told["documents"].collect()] == list(range(1000, 1203))
    told = c.page(-4, 9999)
    assert (told["page"], told["per_page"], told["documents"].count()) == (1, 500, 500)
    none = Collection(spark.createDataFrame([], "_id long")).page()
    assert none["pages"] == 1 and none["documents"].count() == 0


def test_vector_scores_of_odd_rows(spark):
    x = [0.1 * k - 1 for k in range(37)]
    odd = [(1, x), (2, None), (3, []), (4, x[:-1]), (5, [*x[:-1], None]), (6, [0.0] * 37), (7, [*x[:-1], float("nan")])]
    df = spark.createDataFrame([*odd, *[(k, x) for k in range(100, 2000)]], "_id long, e array<double>").repartition(3)
    own = sum(v * v for v in x)
    for metric, best, of_zeros in (("dot", own, 0.0), ("cosine", 1.0, 0.0), ("euclidean", 1.0, 1 / (1 + own**0.5))):
        got = {r._id: r.s for r in df.select("_id", vectors.METRICS[metric](F.col("e"), x).alias("s")).collect()}
        assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4 and got[7] != got[7]
        assert abs(got[1] - best) < 1e-9 and abs(got[6] - of_zeros) < 1e-9
        assert len({got[k] for k in range(100, 2000)}) == 1  # equal vectors tie, wherever they stand
        assert [r._id for r in vectors.nearest(df.where("_id <> 7"), "e", x, 3, metric).collect()] == [1, 100, 101]
    assert vectors.nearest(df.where("false"), "e", x, 3).collect() == []


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 3
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [1.0]), (3002, [float("nan")] * 32), (3003, [0.0] * 32)]
    df = spark.createDataFrame(rows, "_id long, e array<double>").cache()
    for metric in ("cosine", "euclidean"):
        path = str(tmp_path / metric)
        told = vector_index.build(df, "e", 32, path, metric)
        assert (told["indexed"], told["left_out"]) == (3001, 3)
        hits = 0
        for q in x[::300]:
            exact = {r["_id"] for r in vectors.nearest(df.where("_id < 3000"), "e", q.tolist(), 10, metric).collect()}
            hits += len(exact & {r["_id"] for r in vector_index.search(spark, path, q.tolist(), 10).collect()})
        assert hits >= 90, (metric, hits)
        whole = [r["_id"] for r in vector_index.search(spark, path, x[5].tolist(), 10, probes=9999, where=F.col("_id") % 2 == 1).collect()]
        assert whole == [r["_id"] for r in vectors.nearest(df.where("_id % 2 = 1 and _id < 3000"), "e", x[5].tolist(), 10, metric).collect()]
    with pytest.raises(ValueError):
        vector_index.search(spark, path, [1.0], 3)
    with pytest.raises(ValueError):
        vector_index.build(df, "e", 32, path, "dot")
    assert vector_index.build(df.where("false"), "e", 32, str(tmp_path / "none"))["indexed"] == 0
    c = Collection(df)
    c.create_vector_index("e", 32)
    assert tuple(c.vector_coverage("e").first()) == (3002, 2)


def test_command_line_and_files(spark, tmp_path):
    folder = str(tmp_path / "db")
    (tmp_path / "in.json").write_text('[{"_id": "x", "a": 1}, {"a": 2}]')
    (tmp_path / "in.ndjson").write_text('{"a": 3}\n{"a": 4}\n')

    def run(*args):
        out = io.StringIO()
        assert cli.main([*map(str, args)], spark, out) == 0
        return out.getvalue().split("\n")[:-1]

    run("import", folder, "c", tmp_path / "in.json")
    run("import", folder, "c", tmp_path / "in.ndjson")
    assert run("collections", folder) == ["c"] and run("count", folder, "c") == ["4"] and run("count", folder, "c", "--filter", '{"a": {"$gt": 2}}') == ["2"]
    assert json.loads(run("inspect", folder)[0])["documents"] == 4
    told = json.loads(run("page", folder, "c", "--page", "2", "--per-page", "3")[0])
    assert told["pages"] == 2 and told["total"] == 4 and len(told["documents"]) == 1 and "_id" in told["documents"][0]
    run("export", folder, "c", tmp_path / "out.csv")
    assert sorted(r["a"] for r in files.read(spark, str(tmp_path / "out.csv"), "csv").collect()) == [1, 2, 3, 4]
    run("compact", folder, "c")
    assert run("count", folder, "c") == ["4"] and len(list((tmp_path / "db" / "c").glob("part-*"))) == 1 and run("collections", folder) == ["c"]
    run("drop", folder, "c")
    assert run("collections", folder) == []
    (tmp_path / "s.json").write_text('{"a": 1}')
    assert files.config(str(tmp_path / "s.json")) == {"a": 1}
    with pytest.raises(ValueError):
        files.config("x.toml")


def test_timeouts_and_live_queries(spark, tmp_path):
    slow = spark.range(4).select(F.col("id").alias("_id"))

    @F.udf("long")
    def wait(x):
        time.sleep(5)
        return x

    with pytest.raises(QueryTimeout):
        Collection(slow.select(wait("_id").alias("_id"))).find({}, timeout=0.5)
    assert Collection(slow).find({}, timeout=60).count() == 4
    path, seen = str(tmp_path / "t"), []
    odd = spark.createDataFrame([(1, {"k": 2})], "`a.b` long, m map<string,int>")
    odd.write.parquet(path)
    stream = spark.readStream.schema(odd.schema).parquet(path)
    query = lambda: spark.read.schema(odd.schema).parquet(path)
    live.watch(stream, query, lambda d: seen.append(d.count()), str(tmp_path / "c"), once=True, first=True).awaitTermination(60)
    assert seen == [1]  # told at once, and not again since nothing changed
    assert changes.selected(["a", "_b", "c"], exclude=["c"]) == ["a"]
