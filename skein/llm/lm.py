"""Masked pseudo-likelihood: a bidirectional window network, trained and run in numpy, predicts every token from both sides."""

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, ragged, text_slices, utf8, word_places
from skein.llm.minhash import hashed_words

#: Tokens on each side and hidden units. A vocabulary has side * side ids, one digit for each of the two steps of a prediction.
SPAN, HIDDEN = 2, 24
#: The least and the greatest side: at most 65,536 ids and 6.4 million parameters (26 MB), which bounds what is sent to the tasks and to the driver.
SIDE, MOST = 64, 256
#: Token 0 stands outside a text, token 1 for a word whose ending has no id either.
OUTSIDE, UNKNOWN, FIRST = 0, 1, 2
WHOLE = 0.85  # of the vocabulary's ids, how many are words; endings of two bytes follow
END = 256  # stands before and after a word's bytes
#: Averaging rounds, each on its share of the texts; windows of a shard, for each parameter and at least.
ROUNDS, PER_NUMBER, SHARD = 4, 32, 1 << 21
#: Numbers of a model that travel together while shards are summed; models that one task adds up.
CHUNK, FAN = 1 << 14, 32
RATE, BATCH = 0.2, 1024
#: Bytes of text taken at a time.
SLICE = 1 << 22
OFFSETS = np.array([*range(-SPAN, 0), *range(1, SPAN + 1)])


def side_of(words: float) -> int:
    """The vocabulary grows with the square root of the words, from SIDE to MOST."""
    return min(MOST, max(SIDE, round(0.75 * words**0.25)))


def kind_of(size: int) -> str:
    """The array's code of ids below `size`: two bytes each, or four."""
    return "h" if size <= 1 << 15 else "i"


class Words:
    """The words of some texts, in lower case: their hashes, their endings, and each text's bounds among them."""

    def __init__(self, texts: pa.Array):
        self.data, at = utf8(pc.utf8_lower(texts))
        self.starts, self.lens, self.bounds = word_places(self.data, at)
        self.hashes = hashed_words(self.data, self.starts, self.lens).view(np.int64)
        self.last = self.data[self.starts + self.lens - 1].astype(np.int64)
        self.before = np.where(self.lens > 1, self.data[self.starts + np.maximum(self.lens - 2, 0)], END).astype(np.int64)

    def endings(self) -> np.ndarray:
        """A code of the last two bytes."""
        return self.before * 256 + self.last

    def steps(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen words, (byte or END, the byte left of it, where each word's steps begin, first byte of each); the step from it to END is left out."""
        starts, lens = self.starts[which], self.lens[which]
        at = ragged(starts, lens)
        ends = np.cumsum(lens)
        right = self.data[np.minimum(at + 1, len(self.data) - 1)].astype(np.int64)
        right[ends - 1] = END
        return right, self.data[at].astype(np.int64), ends - lens, self.data[starts].astype(np.int64)


class Vocabulary:
    """Words to token ids: a known word has its own, another that of its ending.

    `words` holds hashes and `endings` codes, in the order of their ids. `spelling` has log p(byte to the left | byte), END at both ends.
    Words are told apart by 64-bit hashes.
    """

    def __init__(self, words: np.ndarray, endings: np.ndarray, spelling: np.ndarray, kind: str):
        self.order = np.argsort(words)
        self.words, self.spelling, self.kind = words[self.order], spelling, np.dtype(kind)
        self.of_ending = np.full((END + 1) * 256, UNKNOWN, np.int64)
        self.of_ending[endings] = FIRST + len(words) + np.arange(len(endings))

    def of_words(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(id, log p of a word's bytes given its id: 0 for a known one) of each word."""
        ids = self.of_ending[found.endings()]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, found.hashes), len(self.words) - 1)
            known = self.words[at] == found.hashes
            ids[known] = FIRST + self.order[at[known]]
        else:
            known = np.zeros(len(ids), bool)
        costs, which = np.zeros(len(ids)), np.flatnonzero(~known)
        if len(which):
            right, left, begins, first = found.steps(which)
            cost = np.add.reduceat(self.spelling[right, left], begins) + self.spelling[first, END]
            told = self.spelling[END, found.last[which]] + self.spelling[found.last[which], found.before[which]]
            costs[which] = cost - np.where(ids[which] == UNKNOWN, 0.0, told)  # an ending's id tells two steps
        return ids, costs

    def of_texts(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """(ids as bytes, log p of the bytes of its words) of each text."""
        found = Words(texts)
        ids, costs = self.of_words(found)
        ids, total = ids.astype(self.kind), np.concatenate([[0.0], np.cumsum(costs)])[found.bounds]
        return [ids[a:b].tobytes() for a, b in zip(found.bounds[:-1], found.bounds[1:])], np.diff(total)


def counted(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(word, ending, n) over all texts: how often each word's hash comes; rows without a word count steps from byte to byte, 257 * a + b, under `ending`.

    Words are counted in Python, up to some `most` distinct ones at a time, then by a sum that is combined before the shuffle.
    """

    def told(words, endings, n):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(endings, pa.int64()), pa.array(n, pa.int64())], ["word", "ending", "n"])

    def merged(parts):
        words, endings, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(words)
        first = np.flatnonzero(np.diff(words[order], prepend=~words[order[:1]]))
        return words[order[first]], endings[order[first]], np.add.reduceat(n[order], first)

    def run(batches):
        steps, parts = np.zeros((END + 1) ** 2, np.int64), []
        for part in text_slices(batches, most=SLICE):
            found = Words(part.column(0))
            if not len(found.hashes):
                continue
            parts.append(merged([(found.hashes, found.endings(), np.ones(len(found.hashes), np.int64))]))
            right, left, _, first = found.steps(np.arange(len(found.hashes)))
            steps += np.bincount(right * (END + 1) + left, minlength=len(steps))
            steps += np.bincount(first * (END + 1) + END, minlength=len(steps))
            if sum(len(p[0]) for p in parts) > most:
                parts = [merged(parts)]
                if len(parts[0][0]) > most // 2:
                    yield told(*parts[0])
                    parts = []
        if parts:
            yield told(*merged(parts))
        at = np.flatnonzero(steps)
        yield told([None] * len(at), at, steps[at])

    return docs.select("text").where("text is not null").mapInArrow(run, "word long, ending long, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, endings, spelling, how often each token comes): the commonest words of all texts, and the commonest endings of all other words.

    Spelling has log p(byte to the left | byte) in all words; each step counts once more than it comes.
    """
    counts = scratch.save(counted(docs), "words")
    words = counts.where("word is not null")
    side = side_of(words.agg(F.sum("n").alias("n")).first()["n"] or 0)
    whole = int(WHOLE * side * side)
    top = words.orderBy(F.desc("n"), "word").limit(whole).collect()
    known = F.broadcast(docs.sparkSession.createDataFrame([(r["word"],) for r in top], "word long"))  # `whole` rows at most
    endings = words.join(known, "word", "left_anti").groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").collect()  # 257 * 256 rows at most
    chosen = endings[: side * side - FIRST - whole]
    n = np.zeros(side * side)
    n[UNKNOWN] = sum(r["n"] for r in endings[len(chosen) :])
    n[FIRST : FIRST + len(top)] = [r["n"] for r in top]
    n[FIRST + len(top) : FIRST + len(top) + len(chosen)] = [r["n"] for r in chosen]
    steps = np.ones((END + 1) ** 2)
    for r in counts.where("word is null").collect():  # 257 * 257 rows at most
        steps[r["ending"]] += r["n"]
    steps = steps.reshape(END + 1, END + 1)
    return np.array([r["word"] for r in top], np.int64), np.array([r["ending"] for r in chosen], np.int64), np.log(steps / steps.sum(1, keepdims=True)), n


def tokenized(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, spelled): the tokens of each text, and the log-probability of its words' bytes given their ids."""

    def run(batches):
        for part in text_slices(batches, most=SLICE):
            ids, spelled = vocabulary.of_texts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(spelled, pa.float64())], ["doc_id", "ids", "spelled"])

    return docs.mapInArrow(run, "doc_id long, ids binary, spelled double")


def laid_out(ids: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of the texts with SPAN tokens OUTSIDE around each, places of the tokens in them, tokens of each text)."""
    data, at = utf8(ids)
    sizes = np.diff(at) // array(kind).itemsize
    starts = np.cumsum(sizes + 2 * SPAN) - sizes - SPAN
    padded = np.full(int(sizes.sum()) + 2 * SPAN * len(sizes), OUTSIDE, np.int64)
    places = ragged(starts, sizes)
    padded[places] = np.frombuffer(data.tobytes(), kind)
    return padded, places, sizes


def shapes(side: int) -> dict:
    """A model's arrays, in order; each has its sums of squares behind it (one for a row of `near`)."""
    return {"near": (2 * SPAN * side * side, HIDDEN), "bias": (HIDDEN,), "high": (HIDDEN, side), "low": (HIDDEN, side), "high0": (side,)}


def numbers(side: int) -> int:
    return sum(math.prod(s) for s in shapes(side).values())


class Net:
    """Embeddings for each place around a token, a ramp, then p(high digit of its id) * p(low digit | high digit).

    Logits of the low digits start from the tokens' shares of the corpus, which stay fixed; the rest is learnt by Adagrad.
    """

    def __init__(self, counts: np.ndarray, flat: np.ndarray | None = None, seed: int = 7):
        self.side, self.size = math.isqrt(len(counts)), len(counts)
        share = np.log((counts + 1.0) / (counts + 1.0).sum()).reshape(self.side, self.side)
        high = np.log(np.exp(share).sum(1))
        self.low0 = (share - high[:, None]).astype(np.float32)
        rng, at = np.random.default_rng(seed), 0
        start = {"bias": np.full(HIDDEN, 0.1), "high0": high}
        self.sums = {}
        for name, shape in shapes(self.side).items():
            of_sums = (shape[0], 1) if name == "near" else shape
            if flat is None:
                setattr(self, name, (start[name] if name in start else rng.normal(0, 0.1, shape)).astype(np.float32))
                self.sums[name] = np.full(of_sums, 1e-3, np.float32)
                continue
            n, m = math.prod(shape), math.prod(of_sums)
            setattr(self, name, flat[at : at + n].reshape(shape).copy())
            self.sums[name] = flat[at + n : at + n + m].reshape(of_sums).copy()
            at += n + m

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for name in shapes(self.side) for x in (getattr(self, name), self.sums[name])])

    def forward(self, padded: np.ndarray, at: np.ndarray):
        """(rows of `near` around each place, hidden, logits of all high and of all low digits, high and low digits of the tokens there)."""
        target = padded[at]
        high = target // self.side
        around = padded[at + OFFSETS[:, None]] + self.size * np.arange(2 * SPAN)[:, None]
        h = self.near.take(around[0], 0)
        for one in around[1:]:
            h += self.near.take(one, 0)
        h += self.bias
        np.maximum(h, 0, out=h)
        y, z = h @ self.high, h @ self.low
        y += self.high0
        z += self.low0.take(high, 0)
        return around, h, y.clip(-30, 30, out=y), z.clip(-30, 30, out=z), high, target - high * self.side  # bounds spare a maximum for each row

    def log_probs(self, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log p(padded[place] | both sides) for each place."""
        out, ones = np.empty(len(places), np.float64), np.ones((self.side, 1), np.float32)
        for k in range(0, len(places), 2048):
            _, _, y, z, high, low = self.forward(padded, places[k : k + 2048])
            rows = np.arange(len(high))
            picked = y[rows, high] + z[rows, low]
            out[k : k + 2048] = picked - np.log((np.exp(y, out=y) @ ones) * (np.exp(z, out=z) @ ones))[:, 0]
        return out

    def gradients(self, padded: np.ndarray, at: np.ndarray, weight: np.ndarray):
        """Of the sum of weight * -log p over the places: (rows of `near` around them, the gradient of each of these rows, gradients of the other arrays)."""
        around, h, p, q, high, low = self.forward(padded, at)
        rows, ones = np.arange(len(at)), np.ones((self.side, 1), np.float32)
        for half, digit in ((p, high), (q, low)):
            np.exp(half, out=half)
            half *= weight / (half @ ones)
            half[rows, digit] -= weight[:, 0]
        back = p @ self.high.T
        back += q @ self.low.T
        back *= h > 0
        return around, back, {"bias": back.sum(0), "high": h.T @ p, "low": h.T @ q, "high0": p.sum(0)}

    def learn(self, padded: np.ndarray, places: np.ndarray, weight: np.ndarray, rate: float = RATE, batch: int = BATCH) -> None:
        """One pass of Adagrad over the windows around `places`; of those in `batch`, each counts as its weight."""
        for k in range(0, len(places), batch):
            at = places[k : k + batch]
            around, back, others = self.gradients(padded, at, weight[k : k + batch, None] / np.float32(len(at)))
            for name, g in others.items():
                total = self.sums[name]
                total += g * g
                g *= rate
                g /= np.sqrt(total)
                getattr(self, name).__isub__(g)
            ids, g = summed(around.ravel(), back)
            total = self.sums["near"][ids] + np.einsum("ij,ij->i", g, g)[:, None] / HIDDEN
            self.sums["near"][ids] = total
            g *= rate / np.sqrt(total)
            self.near[ids] -= g


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, for each the sum of its rows); with more ids than rows, rows are gone through again and again."""
    order = np.argsort(ids.astype(np.int16) if ids.max() < 1 << 15 else ids, kind="stable")  # a radix sort where ids are short
    ids = ids[order]
    order %= len(rows)
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sums, lens = rows.take(order[starts], 0), np.diff(starts, append=len(ids))
    more = np.flatnonzero(lens > 1)  # most ids come once
    if len(more):
        many = lens[more]
        sums[more] = np.add.reduceat(rows.take(order[ragged(starts[more], many)], 0), np.cumsum(many) - many, axis=0)
    return ids[starts], sums


MODELS = "chunk int, shard long, seen long, part binary"


def added(models: DataFrame, left: int) -> DataFrame:
    """Sums of all models, FAN at most in one task: (chunk, part) rows of one chunk are added in the order of their shards, so reruns agree."""

    def add(batches):
        chunk, at, seen, part = None, 0, 0, None
        for b in batches:
            for c, shard, n, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (c, shard // FAN) != (chunk, at) and part is not None:
                    yield row(chunk, at, seen, part)
                    part = None
                chunk, at = c, shard // FAN
                seen, part = (n, np.frombuffer(x).copy()) if part is None else (seen + n, part + np.frombuffer(x))
        if part is not None:
            yield row(chunk, at, seen, part)

    def row(chunk, shard, seen, part):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["chunk", "shard", "seen", "part"])

    while True:
        models = models.repartition("chunk", F.floor(F.col("shard") / FAN)).sortWithinPartitions("chunk", "shard").mapInArrow(add, MODELS)
        left = -(-left // FAN)
        if left == 1:
            return models


class Shard:
    """Trains a copy of the model on one shard's texts, as they come; see averaged()."""

    def __init__(self, number: int, counts: np.ndarray, flat: np.ndarray):
        self.number, self.flat, self.net, self.kind = number, flat, Net(counts, flat), kind_of(len(counts))
        self.rng, self.ids, self.weights, self.bytes, self.seen = np.random.default_rng(number), [], [], 0, 0

    def take(self, ids: bytes, n: int) -> None:
        self.ids.append(ids)
        self.weights.append(n)
        self.bytes += len(ids)
        if self.bytes > SLICE:
            self.learn()

    def learn(self) -> None:
        padded, places, sizes = laid_out(pa.array(self.ids, pa.large_binary()), self.kind)
        order = self.rng.permutation(len(places))
        self.net.learn(padded, places[order], np.repeat(np.array(self.weights, np.float32), sizes)[order])
        self.seen += int((sizes * np.array(self.weights, np.int64)).sum())
        self.ids, self.weights, self.bytes = [], [], 0

    def told(self):
        if self.ids:
            self.learn()
        if not self.seen:
            return
        change = (self.net.flat() - self.flat).astype(np.float64) * self.seen
        parts = [change[k : k + CHUNK].tobytes() for k in range(0, len(change), CHUNK)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([self.number] * n, pa.int64()), pa.array([self.seen] * n, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "shard", "seen", "part"])


def averaged(texts: DataFrame, counts: np.ndarray, flat: np.ndarray, shards: int) -> np.ndarray:
    """The model after a round on texts(ids, n, shard): each shard trains a copy of it on its texts, then copies are averaged by their windows.

    A shard's texts come in the order of their hashes, so its model, and the average, depend on the texts alone and not on how tasks hold them.
    """

    def run(batches):
        now = None
        for b in batches:
            for ids, n, shard in zip(*(b.column(k).to_pylist() for k in range(3))):
                if now is None or shard != now.number:
                    if now:
                        yield from now.told()
                    now = Shard(shard, counts, flat)
                now.take(ids, n)
        if now:
            yield from now.told()

    dealt = texts.repartitionById(shards, "shard").sortWithinPartitions("shard", F.xxhash64("ids"), "ids")
    change, windows = np.zeros(len(flat)), 0
    for r in added(dealt.select("ids", "n", "shard").mapInArrow(run, MODELS), shards).collect():  # a model's numbers, in chunks
        one = np.frombuffer(r["part"])
        change[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(one)] = one
        windows += r["seen"] * (r["chunk"] == 0)
    return (flat + change / max(windows, 1)).astype(np.float32)


def trained(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS, shard: int = SHARD) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(tokens of each text, token counts, model) from all texts of docs(doc_id, text), each token once.

    Tokens are written once, for all rounds and the scoring. Equal texts are one row, which weighs as many, before they are shuffled; a hash
    of its tokens gives a text its round and its shard. A shard holds `shard` windows or PER_NUMBER for each parameter, so models make up
    a fixed share of what is shuffled, however large the corpus.
    """
    words, endings, spelling, counts = vocabulary_of(docs, scratch)
    tokens = scratch.save(tokenized(docs, Vocabulary(words, endings, spelling, kind_of(len(counts)))), "tokens")
    flat = Net(counts).flat()
    if rounds:
        shards = max(1, math.ceil(counts.sum() / max(shard, PER_NUMBER * numbers(math.isqrt(len(counts))))))
        digit = lambda seed, most: F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(most)).cast("int")
        texts = tokens.where(F.octet_length("ids") > 0).groupBy("ids").agg(F.count("*").alias("n")).select("ids", "n", digit(1, shards).alias("shard"), digit(2, rounds).alias("turn"))
        texts = scratch.save(texts, "texts")
        for turn in range(rounds):
            flat = averaged(texts.where(F.col("turn") == turn), counts, flat, shards)
    return tokens, counts, flat


def score(docs: DataFrame, rounds: int = ROUNDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) for each row of docs(doc_id, text), by a network trained on docs itself.

    log_prob: the sum over all words of the text, in lower case, of the log-probabilities of their tokens given SPAN tokens on each side. The
    commonest words of all texts are tokens; of another word the token is its last two bytes, and p(its other bytes | these) counts, too,
    by steps from byte to byte. The vocabulary grows as the square root of the corpus's words, from SIDE * SIDE ids to MOST * MOST.
    Training takes every token of every text once, in `rounds` rounds of shards whose models are averaged; shards hold fixed
    texts, so scores don't depend on how the table is split into tasks.
    Defined cases: a null or empty text has no tokens, log_prob 0 and a null mean_log_prob; repeated rows get the same score
    each and count each in training; an empty table gives no rows; a null doc_id stays null; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens, counts, flat = trained(docs, Scratch(docs.sparkSession), rounds, shard)

    def run(batches):
        net = Net(counts, flat)
        for part in text_slices(batches, "ids"):
            padded, places, sizes = laid_out(part.column(1), kind_of(len(counts)))
            total = np.concatenate([[0.0], np.cumsum(net.log_probs(padded, places))])
            ends = np.cumsum(sizes)
            logs = total[ends] - total[ends - sizes] + part.column(2).to_numpy()
            mean = pa.array(logs / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(logs), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
