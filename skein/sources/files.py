"""Reading and writing collections: JSON, NDJSON, CSV, Parquet and snapshots."""

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A table by its kind or file name; a JSON file that begins with [ is one array."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind in ("json", "ndjson", "jsonl"):
        head = spark.read.text(path).first()
        out = spark.read.json(path, multiLine=bool(head) and head[0].lstrip().startswith("["))
        return out.drop("_id")
    return spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.parquet(path)


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format("json" if kind in ("json", "ndjson") else kind).save(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, and a manifest written last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(sorted(tables)),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest.txt")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = json.loads(spark.read.text(f"{path}/_manifest.txt").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def compact(spark: SparkSession, path: str, file_mb: int = 256) -> int:
    """Rewrite a table in files of about `file_mb`, beside it, then put the new one in its place; returns the number of files.

    The old table is moved away before the new one comes, and removed last: a run that breaks off leaves one of the two whole.
    """
    jvm = spark._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}__new", f"{path}__old"))
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = max(1, -(-system.getContentSummary(at).getLength() // (file_mb << 20)))
    df = spark.read.parquet(path)
    (df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df.repartition(parts)).write.mode("overwrite").parquet(f"{path}__new")
    system.delete(old, True)
    if not system.rename(at, old) or not system.rename(new, at):
        raise OSError(f"{path} could not be replaced; its rows are in {path}__old or {path}__new")
    system.delete(old, True)
    spark.catalog.refreshByPath(path)
    return parts


def config(path: str) -> dict:
    """Settings of a .json, .yml or .yaml file; YAML needs the yaml package."""
    kind = path.rpartition(".")[2]
    if kind not in ("json", "yml", "yaml"):
        raise ValueError(f"not a file of settings: {path}")
    with open(path) as f:
        if kind == "json":
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}
