"""Near-duplicates by MinHash: an inverted join over signature coordinates, with exact confirmation."""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Scratch, components, node, text_slices, utf8, word_places

_random = np.random.default_rng(20260101)
_u64 = lambda n: _random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE, STEP, PLACE, SEED, TIMES = _u64(256), _u64(1)[0], _u64(64), _u64(256), _u64(256)
#: A-Z count as a-z.
BYTE[0x41:0x5B] = BYTE[0x61:0x7B]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed_words(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of word_places()."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()))
    at -= np.repeat(firsts, lens)
    power = np.cumprod(np.full(int(lens.max()), STEP))[at]
    at += np.repeat(starts, lens)
    power *= BYTE[data[at]]
    return mixed(np.add.reduceat(power, firsts) + lens.astype(np.uint64) * PLACE[-1])


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin among them (one bound more than texts)."""
    starts, lens, bounds = word_places(data, at)
    return hashed_words(data, starts, lens), bounds


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int):
    """The sorted distinct shingle hashes of each text; with fewer words than `width`, the whole sequence is one."""
    words, bounds = word_hashes(data, at)
    if len(words) >= width:
        runs = sum((words[k : len(words) - width + 1 + k] * PLACE[k] for k in range(width)), np.zeros(len(words) - width + 1, np.uint64))
        runs = mixed(runs)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mixed((words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates; each is a key that holds its number and the least value of its hash function."""
    least = np.full(size, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[k : k + 2048, None] ^ SEED[:size]) * TIMES[:size]).min(0))
    return (np.arange(size, dtype=np.int64) << 32) | (least >> np.uint64(32)).astype(np.int64)


def signed(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys) of each row of docs(doc_id, text), and _row if docs has it; rows of equal sets have equal digests. Empty sets: no digest, no keys."""
    names = ["doc_id", "n_shingles", "digest", "keys"]
    extra = ["_row"] if "_row" in docs.columns else []

    def run(batches):
        for part in text_slices(batches):
            n, digests, keys = [], [], []
            for found in shingle_sets(*utf8(part.column(1)), width):
                n.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(signature(found, size) if len(found) else None)
            more = [part.column(part.schema.get_field_index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *more], [*names, *extra])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([*fields, *[rows.schema[c] for c in extra]])
    return rows.mapInArrow(run, schema)


#: Links of two classes, each with its smallest id.
EDGES = "u binary, low_u long, v binary, low_v long"


def confirmed(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (u, low_u, v, low_v, text_u, text_v), those whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            u, low_u, v, low_v, texts_u, texts_v = (batch.column(k) for k in range(6))
            good = []
            for i in range(len(batch)):
                if u[i] != last:  # rows come sorted by u: a hub's set is made once
                    last, kept = u[i], next(shingle_sets(*utf8(texts_u.slice(i, 1)), width))
                other = next(shingle_sets(*utf8(texts_v.slice(i, 1)), width))
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([u, low_u, v, low_v], ["u", "low_u", "v", "low_v"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "low_u", "v", "low_v", "text_u", "text_v").mapInArrow(run, EDGES)


def candidates(classes: DataFrame, size: int, least: int) -> DataFrame:
    """Posts (key, digest) that every pair with `least` equal coordinates shares at least one of.

    A coordinate value that no other class has can't be shared and is skipped. Of the others, each class posts
    only its rarest: two signatures that agree in `least` of `size` places must agree in one of the
    size - least + 1 places that come first in the order of rarity. So values of a passage that thousands
    share are posted only by classes that have little else, and classes that share too little post nothing.
    """
    posts = classes.select("digest", F.explode("keys").alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(often, "key").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    first = F.size("shared") + F.lit(1 - least)  # size - least + 1, without the size - size(shared) that are its own
    posted = shared.where(first > 0).select("digest", F.size("shared").alias("common"), F.explode(F.slice("shared", F.lit(1), first)).alias("post"))
    return posted.select("post.key", "digest", "common")


def open_pairs(rows: list[dict], percent: int, least: int) -> np.ndarray:
    """Places (i, j) of the pairs of a task that may link: side 0 meets side 1, in a task of one side (2) all meet.

    Pairs of one component, or too unlike in size or signature, are passed over.
    """
    side = np.array([r["side"] for r in rows])
    whole = side.min() == 2
    one, two = (np.arange(len(rows)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(one) or not len(two):
        return np.zeros((0, 2), np.int64)
    keys = np.array([r["keys"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows])
    comp = np.unique([r["comp"] for r in rows], return_inverse=True)[1].ravel()
    low, high = np.minimum(n[one][:, None], n[two]), np.maximum(n[one][:, None], n[two])
    open_ = (comp[one][:, None] != comp[two]) & (100 * low >= percent * high)
    if whole:
        open_ &= np.tri(len(one), k=-1, dtype=bool)
    for k in range(len(one)):
        if open_[k].any():
            open_[k] &= (keys[one[k]] == keys[two]).sum(1) >= least
    at = np.argwhere(open_)
    return np.stack([one[at[:, 0]], two[at[:, 1]]], 1)


def by_task(batches):
    """The rows of each task, which come together."""
    task, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["task"] != task and rows:
                yield rows
                rows = []
            task = r["task"]
            rows.append(r)
    if rows:
        yield rows


def in_question(members: DataFrame, percent: int, least: int) -> DataFrame:
    """(task, digest) of the members that may link with another of their task, from signatures alone; the others' texts needn't be fetched."""

    def run(batches):
        for rows in by_task(batches):
            used = [rows[i] for i in np.unique(open_pairs(rows, percent, least))]
            yield pa.RecordBatch.from_arrays([pa.array([r["task"] for r in used], pa.string()), pa.array([r["digest"] for r in used], pa.binary())], ["task", "digest"])

    return members.mapInArrow(run, "task string, digest binary")


#: Numbers in a product of incidence matrices, at most (64 MB); larger tasks count each pair for itself, with the same result.
PRODUCT = 1 << 24


def compared(members: DataFrame, width: int, percent: int, least: int) -> DataFrame:
    """Links (u, low_u, v, low_v) among the rows of tasks: members(task, side, digest, low, comp, n, keys, text), sorted by task.

    Intersections of open pairs are counted on full sets, for all pairs of a task at once
    by a product of incidence matrices where that is small. Pairs that the task has connected already are not told again.
    """

    def links(rows):
        at = open_pairs(rows, percent, least)
        if not len(at):
            return []
        used = np.unique(at)
        data = [(rows[i]["text"] or "").encode() for i in used]
        sets = dict(zip(used.tolist(), shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), width)))
        flat = np.concatenate([sets[i] for i in used.tolist()])
        counts = None
        if len(at) > 64 and len(flat) * len(used) <= PRODUCT:
            column = np.unique(flat, return_inverse=True)[1].ravel()
            has = np.zeros((len(used), int(column.max()) + 1), np.float32)
            has[np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()]), column] = 1
            counts = has @ has.T
            where = {i: k for k, i in enumerate(used.tolist())}
        top = list(range(len(rows)))

        def root(i):
            while top[i] != i:
                i = top[i]
            return i

        found = []
        for i, j in at.tolist():
            x, y = root(i), root(j)
            if x == y:
                continue
            both = int(counts[where[i], where[j]]) if counts is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[x] = y
                found.append((rows[i], rows[j]))
        return found

    def run(batches):
        for rows in by_task(batches):
            found = links(rows)
            told = [pa.array([pair[k][c] for pair in found], kind) for k in (0, 1) for c, kind in (("digest", pa.binary()), ("low", pa.int64()))]
            yield pa.RecordBatch.from_arrays(told, ["u", "low_u", "v", "low_v"])

    return members.mapInArrow(run, EDGES)


def edges_of(links: DataFrame) -> DataFrame:
    return links.select(node("low_u", "u").alias("u"), node("low_v", "v").alias("v"))


#: Shingles in a block, at most, unless one document has more: what bounds the bytes of a task.
HELD = 1 << 20


def grouped(docs: DataFrame, scratch: Scratch, width: int, percent: int, size: int, least: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows as signed() has them, (digest, low, first) of each class): `first` is the node, see common.node(), of the class that stands for its component."""
    rows = scratch.save(signed(docs, width, size), "rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = rows.select("doc_id", "n_shingles", "digest", "keys").where("digest is not null")
    classes = scratch.save(told.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    posts = scratch.save(candidates(classes, size, least).join(classes.select("digest", "n", "low"), "digest").select("key", "digest", "low", "n", "common"), "posts")
    some = posts.select("digest").distinct().join(classes.select("digest", "low", "keys"), "digest")
    # A class's text is that of a row with its smallest id; the digest, made again, tells rows of one id apart.
    again = texts.join(some.select(F.col("low").alias("at")).distinct(), F.col("doc_id").eqNullSafe(F.col("at")), "left_semi")
    texts = scratch.save(texts_of(again, width).dropDuplicates(["digest"]).join(some.select("digest", "keys"), "digest"), "texts")

    alike = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    hubs = posts.groupBy("key").agg(F.min_by(F.struct("digest", "n", "low"), F.struct(-F.col("common"), F.xxhash64("digest"), "digest")).alias("hub"))
    pairs = posts.join(hubs, "key").where(F.col("digest") != F.col("hub.digest")).where(alike)
    pairs = pairs.select(F.col("hub.digest").alias("u"), F.col("hub.low").alias("low_u"), F.col("digest").alias("v"), F.col("low").alias("low_v")).distinct()
    one, two = (texts.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}"), F.col("keys").alias(f"keys_{x}")) for x in "uv")
    both = pairs.join(two, "v").join(one, "u").where(F.size(F.array_intersect("keys_u", "keys_v")) >= least)
    edges = scratch.save(confirmed(both, width, percent), "edges")
    comp = components(edges_of(edges), scratch, "first").select(F.col("node.name").alias("digest"), F.col("comp.name").alias("comp"))

    owned = posts.join(hubs.select("key", F.col("hub.digest").alias("hub")), "key").join(comp, "digest", "left").select("key", "hub", "digest", "low", "n", F.coalesce("comp", "digest").alias("comp"))
    unlike = owned.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m")).where("a <> b and m > 2")  # of two, one is the hub
    left = scratch.save(owned.join(unlike.select("key"), "key", "left_semi").groupBy("hub", "digest").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("comp").alias("comp")), "left")
    blocks = left.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / HELD)).cast("int").alias("blocks"))
    dealt = left.join(blocks, "hub").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("digest"), "blocks")).otherwise(F.lit(0)).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = met.select(
        F.concat_ws("/", F.hex("hub"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("task"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "digest", "low", "comp", "n",
    )
    tasks = scratch.save(tasks, "tasks")  # read twice; without texts
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = tasks.join(classes.select("digest", "keys"), "digest")
    used = scratch.save(in_question(known.repartition(parts, "task").sortWithinPartitions("task"), percent, least), "used")
    held = tasks.join(used, ["task", "digest"], "left_semi").join(texts, "digest").select("task", "side", "digest", "low", "comp", "n", "keys", "text")
    more = scratch.save(compared(held.repartition(parts, "task").sortWithinPartitions("task"), width, percent, least), "more")
    comp = components(edges_of(edges.unionByName(more)), scratch, "all").select(F.col("node.name").alias("digest"), F.col("comp").alias("joined"))
    ids = scratch.save(classes.join(comp, "digest", "left").select("digest", "low", F.coalesce("joined", node("low", "digest")).alias("first")), "ids")
    scratch.only("rows", "ids")
    return rows, ids


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, size: int = 32, least: int = 14, block: int = 128) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Words are runs of non-space characters of the whole text, A-Z lower-cased; a row's set holds its distinct
    shingles of `width` words, or its whole sequence if it has fewer. Rows link at 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach; kept marks rows whose doc_id is that.

    Rows of equal sets are one class from the start, so exact copies cost one row each. Each list of classes that share
    a post (see candidates) has a hub, its class with the most shared coordinates. First all members are compared with their
    hubs; lists that are then of one component end. Of the others, the members of each hub's lists are compared in
    blocks of `block` by `block` (fewer, where texts are long), pairs of one component left out: first by signatures, which tell whose texts are needed, then on
    full sets. A task returns links, never pairs, and however many members a
    hub has, no task holds more than two blocks. A pair counts if its signatures agree in `least` of `size`
    coordinates (a pair at 80 % fails that with a probability of some 1e-6) and its full sets agree.

    Defined cases: a null or blank text has the empty set, links with nothing and is its own component; a null
    doc_id is never the smallest unless its whole component has none; repeated rows are all returned, with the same result, and
    kept if their doc_id is the component's; an empty table gives no rows; other columns are not looked at.
    """
    rows, ids = grouped(docs.select("doc_id", "text"), Scratch(docs.sparkSession), width, percent, size, least, block)
    own = rows.select("doc_id", "n_shingles", "digest")
    linked = own.where("digest is not null").join(ids.select("digest", F.col("first.low").alias("component_id")), "digest").select("doc_id", "n_shingles", "component_id")
    alone = own.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def texts_of(docs: DataFrame, width: int) -> DataFrame:
    """(digest, text) of each row with words."""

    def run(batches):
        for part in text_slices(batches):
            digests = [blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None for found in shingle_sets(*utf8(part.column(0)), width)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column(0)], ["digest", "text"])

    return docs.select("text").mapInArrow(run, "digest binary, text string").where("digest is not null")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, size: int = 32, least: int = 14, block: int = 128) -> DataFrame:
    """One row of docs for each component of near_duplicates(), with the columns of docs, whatever their names.

    That is a row of its smallest doc_id, and of the text that stands for the component; of repeated rows one stays. Texts that share a doc_id, or have
    none, are told apart. Each row without words links with nothing and stays. An empty table stays empty.
    """
    inner = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    rows, ids = grouped(inner, Scratch(docs.sparkSession), width, percent, size, least, block)
    firsts = ids.where(F.col("digest") == F.col("first.name")).select("digest", F.col("low").alias("_low"))
    own = rows.where("digest is not null").select("_row", "digest", "doc_id")
    kept = own.join(firsts.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi")
    return kept.dropDuplicates(["digest", "doc_id"]).select("_row").unionByName(rows.where("digest is null").select("_row")).select("_row.*")
