"""Command line over a folder of collections, each a Parquet table: inspect, collections, count, export, import, drop, page, compact."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from skein.functions.filters import compile_filter
from skein.operators import updates
from skein.operators.collection import Collection, check_name
from skein.sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("skein").getOrCreate()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Collections of the folder, sorted; those of the engine's own are hidden."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()] if system.exists(path) else []
    return sorted(n for n in found if not n.startswith(("_", ".")))


def drop(spark: SparkSession, folder: str, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{check_name(name)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    parser = argparse.ArgumentParser(prog="skein", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in {"inspect": [], "collections": [], "count": ["collection"], "export": ["collection", "path"], "import": ["collection", "path"], "drop": ["collection"], "page": ["collection"], "compact": ["collection"]}.items():
        p = commands.add_parser(name)
        p.add_argument("folder")
        for m in more:
            p.add_argument(m)
        if name in ("export", "import"):
            p.add_argument("--format", choices=["json", "ndjson", "csv", "parquet"])
        if name == "count":
            p.add_argument("--filter", default="{}")
        if name == "page":
            p.add_argument("--page", type=int, default=1)
            p.add_argument("--per-page", type=int, default=50)
    a = parser.parse_args(args)
    spark = spark or session()
    table = f"{a.folder}/{check_name(a.collection)}" if "collection" in a else None
    if a.command == "collections":
        for n in names(spark, a.folder):
            print(n, file=out)
    elif a.command == "inspect":
        for n in names(spark, a.folder):
            df = spark.read.parquet(f"{a.folder}/{n}")
            print(json.dumps({"collection": n, "documents": df.count(), "fields": df.dtypes}), file=out)
    elif a.command == "count":
        df = spark.read.parquet(table)
        print(df.where(compile_filter(json.loads(a.filter), df.schema)).count(), file=out)
    elif a.command == "page":
        told = Collection(spark.read.parquet(table), a.collection).page(a.page, a.per_page)
        documents = [json.loads(x) for x in told["documents"].toJSON().collect()]  # 500 at most
        print(json.dumps(told | {"documents": documents}), file=out)
    elif a.command == "export":
        files.write(spark.read.parquet(table), a.path, a.format or a.path.rpartition(".")[2])
    elif a.command == "import":
        rows = files.read(spark, a.path, a.format)
        updates.fresh(rows).write.mode("append").parquet(table)
    elif a.command == "drop":
        drop(spark, a.folder, a.collection)
    else:
        files.compact(spark, table)
    return 0


if __name__ == "__main__":
    sys.exit(main())
