"""The document engine: filters against a two-valued evaluator, pipelines, updates, ids, merges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import ids, text, vectors
from skein.functions.filters import FilterError, compile_filter
from skein.operators import changes, pipeline, updates
from skein.operators.collection import Collection, Database, check_name, migrate
from skein.sources import files
from skein.streaming import live


def evaluated(spec, row):
    def one(k, v):
        if k == "$and":
            return all(evaluated(x, row) for x in v)
        if k == "$or":
            return any(evaluated(x, row) for x in v)
        if k == "$not":
            return not evaluated(v, row)
        x = row.get(k)
        for op, y in (v if isinstance(v, dict) else {"$eq": v}).items():
            same = x is not None and type(x) is type(y) and x == y
            ok = {"$eq": lambda: same, "$ne": lambda: not same, "$in": lambda: x is not None and x in y, "$nin": lambda: x is None or x not in y, "$exists": lambda: (x is not None) == y}
            cmp = {"$gt": lambda: x > y, "$gte": lambda: x >= y, "$lt": lambda: x < y, "$lte": lambda: x <= y}
            good = ok[op]() if op in ok else x is not None and not isinstance(x, str) and not math.isnan(x) and cmp[op]()
            if not good:
                return False
        return True

    return all(one(k, v) for k, v in spec.items())


def random_filter(rnd, depth=0):
    roll = rnd.random()
    if depth < 3 and roll < 0.4:
        return {rnd.choice(["$and", "$or"]): [random_filter(rnd, depth + 1) for _ in range(rnd.randrange(3))]}
    if depth < 3 and roll < 0.55:
        return {"$not": random_filter(rnd, depth + 1)}
    op = rnd.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists"])
    value = [rnd.randrange(4) for _ in range(rnd.randrange(3))] if op in ("$in", "$nin") else rnd.random() < 0.5 if op == "$exists" else rnd.randrange(4)
    return {rnd.choice("ab"): {op: value}}


def test_random_filters(spark):
    rows = [{"_id": 5 * i + j, "a": a, "b": b} for i, a in enumerate([None, 0, 1, 2, 3]) for j, b in enumerate([None, 0, 1, 2, 3])]
    df = spark.createDataFrame([(r["_id"], r["a"], r["b"]) for r in rows], "_id long, a long, b long").cache()
    rnd = random.Random(3)
    specs = [random_filter(rnd) for _ in range(60)]
    flags = df.select("_id", *[F.coalesce(compile_filter(s, df.schema), F.lit(False)).alias(f"f{i}") for i, s in enumerate(specs)]).collect()
    for r in flags:
        row = next(x for x in rows if x["_id"] == r["_id"])
        for i, s in enumerate(specs):
            assert r[f"f{i}"] == evaluated(s, row), (s, row)


def test_types_nan_and_errors(spark):
    df = spark.createDataFrame([(1, 1.5, "42", {"city": "x"}), (2, float("nan"), None, None)], "_id long, v double, s string, address struct<city: string>")
    found = lambda spec: [r[0] for r in df.where(compile_filter(spec, df.schema)).orderBy("_id").collect()]
    assert found({"s": 42}) == [] and found({"s": {"$ne": 42}}) == [1, 2]
    assert found({"v": {"$gt": 0}}) == [1] and found({"$not": {"v": {"$gt": 0}}}) == [2]
    assert found({"address.city": "x"}) == [1] and found({"none": None}) == [1, 2] and found({"s": None}) == [2]
    assert found({"s": {"$regex": "^4"}}) == [1] and found({"$not": {"s": {"$contains": "42"}}}) == [2] and found({"none": {"$contains": "."}}) == [1, 2]
    for bad in ({"$xor": []}, {"a": {}}, {"a": {"b": 1}}, {"s": {"$regex": "("}}, {"$or": {}}, {"a": {"$in": 3}}):
        with pytest.raises(FilterError):
            compile_filter(bad, df.schema)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS _id", "id % 7 AS a").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = Collection(df).find({"$not": {"a": {"$gt": 3}}})._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(a),LessThanOrEqual(a,3))" in plan


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 20), (3, "x", None), (4, None, 2**62), (5, None, 2**62)], "_id long, k string, v long")
    got = {r["_id"]: r for r in pipeline.aggregate(df, [{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "p": {"$push": "$v"}, "f": {"$first": "$v"}, "l": {"$last": "$v"}, "s": {"$sum": "$v"}, "n": {"$sum": 1}}}]).collect()}
    assert got["x"]["p"] == [10] and got["x"]["f"] == 10 and got["x"]["l"] == 10 and got["x"]["n"] == 2
    assert got[None]["s"] is not None
    assert pipeline.aggregate(df.where("false"), [{"$group": {"_id": None, "n": {"$count": {}}}}]).collect() == []
    whole = [r["_id"] for r in pipeline.aggregate(df, [{"$sort": {"v": -1}}]).collect()]
    assert whole == [4, 5, 2, 1, 3]
    pages = [r["_id"] for s in (0, 2, 4) for r in pipeline.aggregate(df, [{"$sort": {"v": -1}}, {"$skip": s}, {"$limit": 2}]).collect()]
    assert pages == whole
    assert pipeline.aggregate(df, [{"$project": {"_id": 0, "k": 1}}]).columns == ["k"]
    for bad in ([{"$x": 1}], [{"$limit": -1}], [{"$project": {}}], [{"$project": {"a": 1, "b": 0}}], [{"$group": {"_id": {"a": 1}}}], [{"$group": {"_id": None, "s": {"$sum": 2}}}]):
        with pytest.raises(FilterError):
            pipeline.aggregate(df, bad)


def test_writes(spark):
    df = spark.createDataFrame([(1, 5, ["a"]), (2, None, None)], "_id long, n long, t array<string>")
    out = {r["_id"]: r for r in updates.updated(df, {}, {"$inc": {"n": 2}, "$push": {"t": "b"}, "$set": {"new": "x"}}, F.lit(7)).collect()}
    assert out[1]["n"] == 7 and out[2]["n"] == 2 and out[1]["t"] == ["a", "b"] and out[2]["t"] == ["b"] and out[2]["new"] == "x" and out[1]["_changed_at"] == 7
    assert [r["_id"] for r in updates.deleted(df, {"n": 5}).collect()] == [2]
    with pytest.raises(FilterError):
        updates.updated(df, {}, {"$mul": {"n": 2}})
    with pytest.raises(TypeError):
        updates.updated(df, {}, {"$inc": {"t": 2}})
    c = Collection(df).update_one({"n": None}, {"$set": {"n": 1}}).delete_one({"n": 5})
    assert [(r["_id"], r["n"]) for r in c.df.collect()] == [(2, 1)]


def test_ids_and_tokens(spark):
    for collection, key, want in (("products", "sku-123", "56GC678DQYWW1Z98HPYJ90WVKH"), ("products", "1", "7Z6Y6H8NG96ZGN4PJVDP18CSY2"), ("orders", "1", "5VYD63GDV5KCDXV2A0SYRWSKVZ"), ("", "", "6J535PJ40THJQQH49BE174M53Z"), ("products", "sku-ñ-💡", "5NZ0PGNM2CF0BTHN0AAX8CWPAA")):
        assert ids.derived_id(collection, key) == want
    assert spark.createDataFrame([("1",)], "k string").select(ids.derive("orders", F.col("k"))).first()[0] == "5VYD63GDV5KCDXV2A0SYRWSKVZ"
    assert len(ids.new_id()) == 26 and text.tokenize("A é x-Yz 12") == ["é", "yz", "12"]
    assert spark.createDataFrame([("A é x-Yz 12",)], "t string").select(text.tokens(F.col("t"))).first()[0] == ["é", "yz", "12"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "_id long, e array<double>")
    assert [r["_id"] for r in vectors.nearest(df, "e", [1.0, 0.0], 9).collect()] == [1, 3, 2]
    assert vectors.nearest(df, "e", [0.0, 0.0], 1, "euclidean").first()["_score"] == 1.0
    with pytest.raises(ValueError):
        vectors.nearest(df, "e", [1.0], 3, dimensions=2)
    with pytest.raises(FilterError):
        Collection(df).find_nearest("e", [1.0, 0.0], 1)


def test_merges_agree_in_any_order(spark):
    rnd = random.Random(5)
    rows = [("c", str(rnd.randrange(5)), rnd.choice(["upsert", "delete"]), rnd.randrange(4), rnd.choice("xyz")) for _ in range(60)]
    kind = "collection string, _id string, op string, changed_at long, doc string"
    a, b, c = (spark.createDataFrame(rows[k::3], kind) for k in range(3))
    one = changes.merged(changes.merged(a, b), c).collect()
    assert sorted(one) == sorted(changes.merged(a, changes.merged(c, b)).collect())
    assert changes.advance("hydrating", "complete") == "complete"
    with pytest.raises(ValueError):
        changes.advance("empty", "complete")
    got = spark.range(1).select(changes.grown(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()[0]
    assert got == [1, 1, 2]


def test_collections_files_and_live_queries(spark, tmp_path):
    for bad in ("", "_x", "a::b", "é" * 65):
        with pytest.raises(FilterError):
            check_name(bad)
    df = spark.createDataFrame([("1", 5), ("2", 6)], "_id string, n long")
    db = Database(spark)
    db.collection("b", df), db.collection("a", df)
    assert db.list_collection_names() == ["a", "b"] and migrate(1, {2: lambda d: d.withColumn("m", F.lit(1))}, df)[0] == 2
    files.snapshot({"a": df}, str(tmp_path / "s"))
    assert files.restore(spark, str(tmp_path / "s"))["a"].count() == 2
    files.write(df, str(tmp_path / "j"), "json")
    assert files.read(spark, str(tmp_path / "j"), "json").columns == ["n"]
    (tmp_path / "in").mkdir()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.watch(stream, lambda: Collection(spark.read.schema(df.schema).parquet(str(tmp_path / "in"))).find({"n": {"$gt": 5}}), lambda d: seen.append(d.count()), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert seen == [1]
