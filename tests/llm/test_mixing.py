"""The mix against a walk over its schedule, word by word."""

from collections import Counter

import numpy as np
import xxhash

from skein.llm import mixing

KIND = "doc_id long, text string, source string, src long, size string, start int"


def hashed(doc_id, seed):
    """What shuffles a source's line: 64-bit xxHash of the id, then of the seed; a null leaves the hash as it is."""
    h = 42 if doc_id is None else xxhash.xxh64(int(doc_id).to_bytes(8, "little", signed=True), seed=42).intdigest()
    h = xxhash.xxh64(seed.to_bytes(4, "little"), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def walked(rows, weights=(5, 2, 1), seed=17):
    size = [len((r[1] or "").split()) for r in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    goal = mixing.targets(sums, [weights[k % 3] for k in range(len(names))], 1.5 * sum(sums))
    bounds, dealt = np.cumsum(goal) / sum(goal), Counter()
    for n in range(-(-int(sum(goal)) // mixing.BLOCK)):
        point = n * int(mixing.GOLDEN) % (1 << 64) / (1 << 64)
        dealt[sum(point >= b for b in bounds[:-1].tolist())] += 1
    taken = Counter()
    for k, s in enumerate(names):
        def place(i):
            h = hashed(rows[i][0], seed)
            return h % mixing.PARTS, h, rows[i][0] is not None, rows[i][0] or 0, size[i]

        line = [i for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=place) for _ in range(size[i])]
        taken.update((line * 2)[: dealt[k] * mixing.BLOCK])
    by = dict(zip(names, zip(sums, goal)))
    return Counter((r[0], r[2], size[i], by[r[2]][0], round(by[r[2]][1], 6), taken[i]) for i, r in enumerate(rows))


def told(docs):
    return Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(docs).collect())


def test_the_mix_is_a_walk_over_the_schedule(spark):
    rng = np.random.default_rng(8)
    sources = ["hot"] * 6 + ["b", "zz", "", None]
    rows = [(i, "w " * int(rng.integers(0, 200)), sources[int(rng.integers(len(sources)))], None, "x", 3) for i in range(400)]
    rows += [(None, "no id " * 40, "b", None, None, None), (900, None, None, 1, None, 1), (901, " \n\t ", "blank", 1, None, 1), (902, "long " * 30_000, "hot", 1, None, 1)]
    rows += [rows[3]] * 5
    want = walked(rows)
    assert told(spark.createDataFrame(rows, KIND).repartition(7)) == want
    assert told(spark.createDataFrame(rows[::-1], KIND).coalesce(1)) == want


def test_a_mix_of_nothing(spark):
    assert told(spark.createDataFrame([], KIND)) == Counter()
    rows = [(1, None, "a", None, None, None), (2, "", None, None, None, None)]
    assert told(spark.createDataFrame(rows, KIND)) == Counter({(1, "a", 0, 0, 0.0, 0): 1, (2, None, 0, 0, 0.0, 0): 1})
