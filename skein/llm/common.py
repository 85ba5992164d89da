"""What the operators share: scratch tables, slices of text columns, connected components."""

import atexit
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where that is unset on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator's run, in the shared folder. Operators drop those that their result doesn't read; the rest goes with the driver, or at spent()."""

    open: list = []

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.root = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
        Scratch.open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, *names: str) -> None:
        """Drop all tables but these, which a result still reads."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)

    def drop(self, name: str = "") -> None:
        self.names = [n for n in self.names if name and n != name]
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: there is no file system to ask
            return

    @staticmethod
    def spent(which: list | None = None) -> None:
        """Drop what is still there of these runs, or of all: for a caller who has saved the results that read it."""
        for scratch in list(Scratch.open if which is None else which):
            scratch.drop()
            if scratch in Scratch.open:
                Scratch.open.remove(scratch)


atexit.register(Scratch.spent)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's bounds in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes) of each word of the texts, and where each text's words begin among them (one bound more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    heads = at[:-1][np.diff(at) > 0]  # a text ends a word
    first[heads] = inside[1:-1][heads]
    last[heads[1:] - 1] = inside[1:-1][heads[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, at)


def text_slices(batches, column: str = "text", most: int = 1 << 20):
    """Parts of the batches of about `most` bytes of text each, or of one row if that is longer."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(utf8(texts)[1]) if len(texts) else []
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def split_of(doc_id, parts: int) -> np.ndarray:
    """crc32 of the id as text, modulo `parts` (a null id: of the empty text)."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % parts for x in doc_id], np.int64)


def crc_mod(column: str, parts: int):
    """The same as split_of, as a column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of all items of the runs that begin at `starts` and hold `lens` items."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of the edges (u, v): comp is the smallest node that it reaches.

    Large-star and small-star rounds until nothing changes; each is written to the shared folder. Every round needs a minimum
    for each node (combined before the shuffle) and a join, in which Spark splits hot nodes. Nodes may be structs: with a document's
    id in front, comp tells the smallest id at once, and no join by component, which may hold a third of all rows, is needed.
    """
    pairs = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    comp = pairs.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return scratch.save(comp.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), name)


def node(low: str, name: str):
    """A class as a node: ordered by its smallest id, null last, and told apart by its digest."""
    return F.struct(F.col(low).isNull().alias("none"), F.col(low).alias("low"), F.col(name).alias("name"))
