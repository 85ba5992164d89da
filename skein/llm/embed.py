"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Scratch, components, node, utf8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: nearly a random rotation, in d log d."""
    rng = np.random.default_rng(seed)
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def buckets(x: np.ndarray, table: int, depth: int, probes: int) -> np.ndarray:
    """The `probes` likeliest buckets of each unit vector in one table (int64; best first).

    A hash is the nearest of the 2 d signed axes; `depth` rotations are joined. The probes are the joined hashes of the
    least total loss, each hash taking one of its few nearest axes.
    """
    near = min(max(4, probes if depth == 1 else 4), 2 * x.shape[1])
    axes, losses = [], []
    for k in range(depth):
        r = rotated(x, 7919 * table + k)
        both = np.concatenate([r, -r], 1)
        top = np.argpartition(-both, near - 1, 1)[:, :near]
        value = np.take_along_axis(both, top, 1)
        order = np.argsort(-value, 1, kind="stable")
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        axes.append(top)
        losses.append((value[:, :1] - value) ** 2)
    code, loss = axes[0].astype(np.int64), losses[0]
    for top, more in zip(axes[1:], losses[1:]):
        code = (code[:, :, None] * both.shape[1] + top[:, None]).reshape(len(x), -1)
        loss = (loss[:, :, None] + more[:, None]).reshape(len(x), -1)
    order = np.argsort(loss, 1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their size."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def hit_rate(width: int, cosine: float, depth: int, probes: int, pairs: int = 1000) -> float:
    """How often two random vectors at just this cosine meet in one table, tried out."""
    rng = np.random.default_rng(width)
    x = unit(rng.normal(size=(pairs, width)))
    z = rng.normal(size=(pairs, width))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
    met = (buckets(x, 0, depth, probes)[:, :, None] == buckets(y, 0, depth, probes)[:, None, :]).any((1, 2))
    return float(np.clip(met.mean(), 0.01, 0.999))


def planned(rows: int, width: int, cosine: float, miss: float, full: int) -> tuple[int, int, int]:
    """(tables, depth, probes) for so many vectors: a mean bucket holds `full` at most, and a pair at the threshold is missed with probability `miss`.

    Of the numbers of probes that do, that with the fewest posts for each vector.
    """
    if width == 1:
        return 1, 1, 1
    depth = 1
    while 3 * rows / (2 * width) ** depth > full:
        depth += 1
    best = None
    for probes in (2, 3, 4) if depth == 1 else (4, 6, 8, 12):
        probes = min(probes, (2 * width) ** depth)
        tables = int(np.ceil(np.log(miss) / np.log(1 - hit_rate(width, cosine, depth, probes))))
        if best is None or tables * probes < best[0] * best[2]:
            best = (tables, depth, probes)
    return best


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, vector, dims) per row: the vector's bytes, -0.0 as 0.0; null if it can't link."""

    def run(batches):
        for batch in batches:
            out, dims = [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, kind) + np.array(0, kind)
                good = x is not None and x.size and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["id", "vector", "dims"])

    name = "float" if kind == "f4" else "double"
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{name}>").alias("v")).mapInArrow(run, "id long, vector binary, dims int")


def matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    data, _ = utf8(column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, dims)


def width_of(dims: int) -> int:
    return 1 << max(0, int(dims - 1).bit_length())


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows of equal keys begin, and the end."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def posted(classes: DataFrame, plans: dict[int, tuple], kind: str, lean: bool = False) -> DataFrame:
    """(dims, bucket, ...) for each class of vectors, in its buckets of each table; unless `lean`, with the vector and its codes in this and earlier tables."""
    most = max((t for t, _, _ in plans.values()), default=1)

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                tables, depth, probes = plans[width_of(int(n))]
                x = unit(matrix(part.column(1), int(n), kind))
                codes = np.stack([buckets(x, t, depth, probes) for t in range(tables)], 1)
                for t in range(tables):
                    seen = None if lean else pa.array([c.tobytes() for c in codes[:, : t + 1]], pa.binary())
                    for p in range(codes.shape[2]):
                        names = [pa.array(np.full(len(x), n, np.int32)), pa.array(codes[:, t, p] * most + t)]
                        rest = [] if lean else [*part.columns[1:], seen]
                        yield pa.RecordBatch.from_arrays([*names, *rest], ["dims", "bucket", *([] if lean else ["vector", "low", "cls", "copies", "codes"])])

    told = "dims int, bucket long" + ("" if lean else ", vector binary, low long, cls binary, copies long, codes binary")
    return classes.select("dims", "vector", "low", "cls", "copies").mapInArrow(run, told)


class Group:
    """Links within one task: all rows with each other, or those of side 0 with those of side 1; see verified()."""

    ROWS = 256

    def __init__(self, x: np.ndarray, side: np.ndarray, copies: np.ndarray, codes, bucket: int, plan: tuple, most: int, cosine: float):
        self.links, self.label = np.zeros(len(x), np.int64), np.arange(len(x))
        tables, _, probes = plan
        table, code = bucket % most, bucket // most
        whole = side[0] == 2
        one, two = (np.arange(len(x)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        met, of = [], None
        for k in range(0, len(one), self.ROWS):  # so many rows of products at a time
            mine = one[k : k + self.ROWS]
            product = x[mine] @ x[two].T
            i, j = np.nonzero(product >= cosine - 1e-9)
            i, j = mine[i], two[j]
            good = i > j if whole else np.ones(len(i), bool)
            i, j = i[good], j[good]
            if not len(i):
                continue
            edge = np.flatnonzero(np.abs(product[i - mine[0] if whole else np.searchsorted(mine, i), j if whole else np.searchsorted(two, j)] - cosine) < 1e-9)
            if len(edge):  # at the threshold the sum's order may matter
                good = np.ones(len(i), bool)
                good[edge] = np.einsum("ij,ij->i", x[i[edge]], x[j[edge]]) >= cosine
                i, j = i[good], j[good]
            if of is None:
                of = np.frombuffer(codes().tobytes(), np.int64).reshape(len(x), table + 1, probes)
            for a in range(0, len(i), 1 << 16):
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                first = np.ones(len(p), bool)
                for t in range(table):
                    first &= ~(of[p, t][:, :, None] == of[q, t][:, None, :]).any((1, 2))
                shared = (of[p, table][:, :, None] == of[q, table][:, None, :]).any(2)
                first &= np.where(shared, of[p, table], np.iinfo(np.int64).max).min(1) == code
                if first.any():
                    met.append((p[first], q[first]))
                    self.links += np.bincount(p[first], copies[q[first]], len(x)).astype(np.int64) + np.bincount(q[first], copies[p[first]], len(x)).astype(np.int64)
        changed = bool(met)
        while changed:  # the smallest row that each reaches
            before = self.label.copy()
            for p, q in met:
                least = np.minimum(self.label[p], self.label[q])
                np.minimum.at(self.label, p, least)
                np.minimum.at(self.label, q, least)
            self.label = self.label[self.label]
            changed = (before != self.label).any()


def verified(tasks: DataFrame, cosine: float, plans: dict[int, tuple], kind: str) -> DataFrame:
    """Links among the classes of each task (dims, bucket, a, b), whose rows come together, from their cosines in double precision.

    A pair that shares several buckets counts in the first that it shares only, which the classes' codes tell. Returns, for each class
    of a task, `links` (vectors of other classes that it links to), and edges (u, v) to the least class that it is joined to.
    """
    most = max((t for t, _, _ in plans.values()), default=1)
    names = ["cls", "low", "links", "other", "other_low"]

    def solved(batch: pa.RecordBatch):
        """Whole tasks, one after another."""
        dims, bucket, a, b, side, copies, low = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dims", "bucket", "a", "b", "side", "copies", "n_low"))
        cls = batch.column(batch.schema.get_field_index("cls"))
        vectors, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("vector", "codes"))
        of_dims = runs(dims)
        for s, e in zip(of_dims[:-1], of_dims[1:]):
            plan = plans[width_of(int(dims[s]))]
            x = unit(matrix(vectors.slice(s, e - s), int(dims[s]), kind))
            ends = runs(bucket[s:e], a[s:e], b[s:e]) + s
            mine, other, links = [], [], []
            for p, q in zip(ends[:-1], ends[1:]):
                if q - p < 2 or side[p] != 2 and (side[p:q] == side[p]).all():
                    continue
                group = Group(x[p - s : q - s], side[p:q], copies[p:q], lambda p=p, q=q: utf8(codes.slice(p, q - p))[0], int(bucket[p]), plan, most, cosine)
                at = np.flatnonzero(group.links)
                mine.append(at + p)
                links.append(group.links[at])
                other.append(group.label[at] + p)
            if mine:
                i, j = pa.array(np.concatenate(mine)), pa.array(np.concatenate(other))
                lows = pa.array(low, pa.int64(), mask=batch.column(batch.schema.get_field_index("low")).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([cls.take(i), lows.take(i), pa.array(np.concatenate(links)), cls.take(j), lows.take(j)], names)

    def together(held: list):
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches):
        held: list = []  # rows of one task that may go on
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dims", "bucket", "a", "b")]
            last, now = int(runs(*keys)[-2]), [k[0] for k in keys]
            if last:
                yield from solved(together([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif held and now == of_held:
                held.append(batch)
            else:
                if held:
                    yield from solved(together(held))
                held = [batch]
            of_held = [k[-1] for k in keys]
        if held:
            yield from solved(together(held))

    return tasks.mapInArrow(run, "cls binary, low long, links long, other binary, other_low long")


#: Buckets of more classes than this are few enough to be sent to all tasks, up to so many of them; beyond that they are joined by a shuffle.
SENT = 100_000


def near_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-5, full: int = 2048, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: vectors whose cosine, in double precision, is at least `cosine` link.

    Equal vectors are one class from the start. Classes meet in buckets of cross-polytope tables; each is posted in its likeliest
    buckets of each, so a pair meets if any of them agree, and every pair met is verified. How many tables, joined rotations and probes there are
    follows from the number of vectors and their length, see planned(): a pair at the threshold is missed with probability `miss`. Buckets of over `block` classes
    are dealt to tasks of two blocks each, so no task holds more than two blocks however large the bucket. Pairs are counted where they are found and
    never sent out: a task returns counts, and a spanning forest for the components.

    Defined cases: null, zero or empty vectors and those with null or non-finite components link with nothing; vectors of other lengths
    don't meet; repeated rows are vectors of their own and link with each other; a null vec_id is never a component's smallest unless
    there is no other; an empty table gives no rows; other columns are not looked at.
    """
    scratch, spark = Scratch(vectors.sparkSession), vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "f4" if isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "f8"
    rows = scratch.save(classes_of(vectors, id_col, vector_col, kind).withColumn("cls", F.unhex(F.md5("vector"))), "rows")
    classes = scratch.save(rows.where("vector is not null").groupBy("cls").agg(F.first("vector").alias("vector"), F.first("dims").alias("dims"), F.min("id").alias("low"), F.count("*").alias("copies")), "classes")
    widths = classes.groupBy(F.ceil(F.log2("dims")).alias("bits")).agg(F.count("*").alias("n")).collect()  # 32 rows at most
    plans = {1 << r["bits"]: planned(r["n"], 1 << r["bits"], cosine, miss, full) for r in widths}
    large = posted(classes, plans, kind, lean=True).groupBy("dims", "bucket").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = scratch.save(large.select("dims", "bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "large")
    dealt = posted(classes, plans, kind).join(F.broadcast(large) if large.count() <= SENT else large, ["dims", "bucket"], "left")
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    tasks = met.select("dims", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "cls", "vector", "low", F.coalesce("low", F.lit(0)).cast("long").alias("n_low"), "copies", "codes")
    keys = ["dims", "bucket", "a", "b"]
    found = scratch.save(verified(tasks.repartition(parts, *keys).sortWithinPartitions(*keys), cosine, plans, kind), "found")
    edges = found.select(node("low", "cls").alias("u"), node("other_low", "other").alias("v"))
    comp = components(edges, scratch, "comp").select(F.col("node.name").alias("cls"), F.col("comp.low").alias("component_id"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(comp, "cls", "left").join(links, "cls", "left")
    known = scratch.save(known.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")), "known")
    scratch.only("rows", "known")
    linked = rows.where("vector is not null").select("id", "cls").join(known, "cls").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = rows.where("vector is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
