"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, Scratch

#: 2 ** 64 over the golden ratio: multiples of it, modulo 2 ** 64, are the golden-ratio points.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words in a block, slots dealt in one piece, least parts in which each source is shuffled and summed, and rows of the table for one more.
BLOCK, PIECE, PARTS, ROWS = 128, 1 << 15, 1024, 1 << 16
#: Sources that are sent to all tasks; more are joined by a shuffle.
SENT = 10_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight; none above `most` times its size: the excess is shared again by weight among the others."""
    out, left, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while left:
        per = rest / sum(weights[i] for i in left)
        full = [i for i in left if weights[i] * per >= most * sizes[i]]
        if not full:
            for i in left:
                out[i] = weights[i] * per
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
            left.discard(i)
    return out


def in_order(source):
    """Code points ascending, null last."""
    return (source is None, source or "")


def schedule(spark, shares: list[float], slots: int) -> DataFrame:
    """(src, rank, slot): slot n of the mix takes block `rank` of source `src`.

    The golden-ratio point of n falls into one source's part of the cumulative shares, so each run of slots holds every
    source nearly in proportion. Ranks are counted within pieces of slots and carried over from piece to piece.
    """
    # A point's place among the bounds; the last share ends at 2 ** 64.
    bounds = np.array([int(x * 2**63) * 2 for x in np.cumsum(shares)[:-1] / sum(shares)], np.uint64)

    def dealt(piece: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(piece * PIECE, min(slots, (piece + 1) * PIECE), dtype=np.uint64)
        return n, np.searchsorted(bounds, n * GOLDEN, side="right")

    def counted(batches):
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                src, n = np.unique(dealt(piece)[1], return_counts=True)  # of the sources, those that the piece has
                yield pa.RecordBatch.from_arrays([pa.array([piece] * len(n), pa.int64()), pa.array(src.astype(np.int64)), pa.array(n)], ["piece", "src", "n"])

    def placed(batches):
        for batch in batches:
            for piece, befores in zip(*(c.to_pylist() for c in batch.columns)):
                n, src = dealt(piece)
                base = np.zeros(len(shares), np.int64)
                for b in befores:
                    base[b["src"]] = b["before"]
                order = np.argsort(src, kind="stable")
                count = np.bincount(src, minlength=len(shares))
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(rank + base[src]), pa.array(n.astype(np.int64))], ["src", "rank", "slot"])

    pieces = spark.range(-(-slots // PIECE)).select(F.col("id").alias("piece"))
    counts = pieces.mapInArrow(counted, "piece long, src long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.withColumn("before", before).groupBy("piece").agg(F.collect_list(F.struct("src", "before")).alias("befores"))
    return carried.mapInArrow(placed, "src long, rank long, slot long")


def line(docs: DataFrame, parts: int, seed: int) -> DataFrame:
    """Each row of docs(doc_id, src, size) with start: its place on its source's shuffled line of words.

    Rows are dealt to parts of their source by a hash, as many as the table's rows ask for, so no task holds a large source; parts are put one after another by their sums.
    """
    d = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(parts)))
    sums = d.groupBy("src", "part").agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("src", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("within", within).join(sums.select("src", "part", offset.alias("offset")), ["src", "part"]).withColumn("start", F.col("offset") + F.col("within")).drop("within", "offset", "h", "part")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row: how many of its words the mix takes.

    size counts the words of the whole text. Sources in code-point order, null last, weigh `weights` in turn, and together get `share` of all
    words; see targets(). Each source's rows, shuffled, stand on a line that is cut into blocks of BLOCK words; a source that
    must repeat has its line again and again. The schedule says which blocks the mix takes, and `taken` counts a row's words in
    them: never more than `most` times its size, and for a source its target within some blocks. Reruns give the same.

    The driver holds one size for each distinct source. Defined cases: a null or blank text has no words and none taken; a null
    source is a source; repeated rows share a place in the order and are taken each on its own; a table without rows or words
    takes nothing; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    by, parts = {r["source"]: r["words"] for r in found}, max(PARTS, sum(r["n"] for r in found) // ROWS)
    names = sorted(by, key=in_order)
    sizes = [by[s] for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    slots = -(-int(sum(goal)) // BLOCK)
    if not slots:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    known = spark.createDataFrame([(names[i], i, sizes[i], float(goal[i])) for i in range(len(names))], "_name string, src long, source_size long, target double")
    known = F.broadcast(known) if len(names) <= SENT else known
    rows = line(sized.join(known, F.col("source").eqNullSafe(F.col("_name"))).drop("_name"), parts, seed)
    rows = scratch.save(rows, "line")  # the row's id on its line: src and start, which differ unless the size is 0
    # Words [start, start + size) come again every source_size words, as far as `most` times the line; blocks cut them.
    turns = rows.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))))
    first = F.col("start") + F.col("turn") * F.col("source_size")
    last = F.least(first + F.col("size"), F.floor(F.col("source_size") * most))
    turns = turns.withColumn("a", first).withColumn("b", last).where("a < b")
    pieces = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))))
    words = F.least("b", (F.col("rank") + 1) * BLOCK) - F.greatest("a", F.col("rank") * BLOCK)
    pieces = pieces.select("src", "rank", "start", words.alias("words"))
    # Spark takes the schedule for as small as its list of pieces and would broadcast it; it grows with the words.
    slot = schedule(spark, goal, slots).select("src", "rank").hint("merge")
    taken = pieces.join(slot, ["src", "rank"]).groupBy("src", "start").agg(F.sum("words").cast("long").alias("taken"))
    # Rows without words have no place of their own.
    full = rows.where("size > 0").join(taken, ["src", "start"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return full.select(columns).unionByName(none.select(columns))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix has them: each as many times as its whole text is taken (a part counts as whole from a half on).

    Columns of docs are kept. Rows that share a doc_id are each repeated as often as that of them which is taken most.
    """
    took = mix(docs, **how).groupBy("doc_id").agg(F.max(F.round(F.try_divide("taken", "size"))).cast("int").alias("_copies"))
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"))
    met = inner.join(took.where("_copies > 0"), F.col("_id").eqNullSafe(F.col("doc_id")))
    return met.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
