"""Language identification by a byte convolutional network, trained and run in numpy."""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import crc_mod, ragged, split_of, text_slices, utf8

#: Filter widths in bytes, filters of each, bytes in a window.
WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 128
LETTER = regex.compile(r"\p{L}")
#: A-Z count as a-z; byte 0 pads.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Net:
    """Convolutions over one-hot bytes (so a filter is a table of 256 weights for each of its places), max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.prior = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """The largest value of each filter over each window, after the ramp, and its places if asked for."""
        best, at = [], []
        for table in self.tables:
            n = x.shape[1] - len(table) + 1
            z = table[0][x[:, :n]]
            for j in range(1, len(table)):
                z += table[j][x[:, j : j + n]]
            if places:
                at.append(z.argmax(1))
            best.append(z.max(1))
        return np.maximum(np.concatenate(best, 1) + self.bias, 0), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.pooled(x)[0] @ self.out + self.prior

    def params(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.prior]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for params(); a filter gets one only at the place where it is largest."""
        h, at = self.pooled(x, True)
        p = softmax(h @ self.out + self.prior)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (h > 0)
        found = []
        for w, (table, place) in enumerate(zip(self.tables, at)):
            g, part = np.zeros_like(table), back[:, w * FILTERS : (w + 1) * FILTERS]
            for j in range(len(table)):
                seen = x[np.arange(len(x))[:, None], place + j]
                np.add.at(g[j], (seen, np.arange(FILTERS)[None]), part)
            found.append(g)
        return [*found, back.sum(0), h.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 6) -> None:
        """Adagrad on the cross-entropy."""
        rng = np.random.default_rng(seed)
        sums = [np.full(p.shape, 1e-6, np.float32) for p in self.params()]
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                i = order[k : k + batch]
                for q, s, g in zip(self.params(), sums, self.gradients(x[i], y[i])):
                    s += g * g
                    q -= rate * g / np.sqrt(s)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts in windows of fixed length, the last of a text padded; and each text's number of windows."""
    lens = np.diff(at)
    n = -(-lens // WINDOW)
    x = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    x[ragged((np.cumsum(n) - n) * WINDOW, lens)] = FOLD[data]
    return x.reshape(-1, WINDOW), n


def predicted(net: Net, data: np.ndarray, at: np.ndarray, texts) -> tuple[list, list]:
    """(language, probability) of each text: its windows' log-probabilities, averaged by their bytes."""
    x, n = windows(data, at)
    logs = np.zeros((len(x), len(net.labels)))
    for k in range(0, len(x), 256):
        logs[k : k + 256] = np.log(softmax(net.logits(x[k : k + 256])) + 1e-9)
    logs *= (x != 0).sum(1, keepdims=True)
    ends = np.cumsum(n)
    sums = np.concatenate([np.zeros((1, len(net.labels))), np.cumsum(logs, 0)])
    p = softmax((sums[ends] - sums[ends - n]) / np.maximum(np.diff(at), 1)[:, None])
    plain = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    langs, scores = [], []
    for i in range(len(n)):
        if plain[at[i + 1]] > plain[at[i]] or (n[i] and LETTER.search(texts[i].as_py() or "")):
            langs.append(net.labels[int(p[i].argmax())])
            scores.append(float(p[i].max()))
        else:
            langs.append("und")
            scores.append(0.0)
    return langs, scores


def trained(docs: DataFrame, sample: int = 3000, parts: int = 4, held: int = 2, slice_: int = 3 * WINDOW, most: int = 128) -> Net | None:
    """A network for the languages of docs(doc_id, text, lang), from about `sample` rows, at most twice that, shared evenly by its languages.

    Rows whose crc32(doc_id) modulo `parts` is `held`, and those without lang or text, are left out. Each row
    gives `slice_` characters of its text, from a place that a hash sets, and of these one whole window and a shorter one. Of over `most` values of
    lang, which a table with dirty labels may have, those of the most rows are learnt. None if there is no such row.
    """
    usable = docs.where("lang is not null and text is not null").where(crc_mod("doc_id", parts) != held)
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, sample / len(labels) / counts[k]))]), F.col("lang"))
    chosen = usable.where(F.col("lang").isin(labels)).withColumn("h", F.xxhash64("doc_id", F.length("text"))).where(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000)
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - slice_, F.lit(1))).cast("int") + 1
    rows = chosen.select("lang", F.substring("text", start, F.lit(slice_)).alias("part"), "h").orderBy("h", "lang", "part").limit(2 * sample).collect()
    rng = np.random.default_rng(4)
    x, y = [], []
    for r in rows:
        raw = FOLD[np.frombuffer(r["part"].encode(), np.uint8)]
        for length in (WINDOW, int(rng.integers(12, WINDOW))):  # short windows too, since texts may be short
            if len(raw):
                at = int(rng.integers(0, max(1, len(raw) - length)))
                one = raw[at : at + length]
                x.append(np.pad(one, (0, WINDOW - len(one))))
                y.append(labels.index(r["lang"]))
    net = Net(labels)
    if x:
        net.fit(np.stack(x), np.array(y))
    return net


def detect(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs(doc_id, text) with held_out, lang_pred and score; see identify(). Only the text goes into a prediction."""

    def run(batches):
        for part in text_slices(batches):
            texts = part.column(1)
            data, at = utf8(texts)
            langs, scores = predicted(net, data, at, texts) if net else (["und"] * len(part), [0.0] * len(part))
            held = split_of(part.column(0).to_pylist(), 4) == 2
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row: the language of its whole text by a network trained on docs itself.

    Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row all are `und`; rows without lang are
    predicted but not learnt from; repeated rows get the same prediction each; an empty table gives no rows; a null
    doc_id counts as the empty text for the split; other columns are not looked at.
    """
    return detect(docs, trained(docs.select("doc_id", "text", "lang"), sample))


def keep_known(docs: DataFrame, least: float = 0.3, sample: int = 3000) -> DataFrame:
    """The rows of docs in a language that its labels teach: not `und`, and with a score of at least `least`. Columns are kept, whatever their names.

    Null texts and those without a letter go; without any label all rows go; repeated rows go or stay together; an empty table stays empty.
    """
    net = trained(docs.select("doc_id", "text", "lang"), sample)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for part in text_slices(batches):
            texts = part.column(1)
            langs, scores = predicted(net, *utf8(texts), texts) if net else (["und"] * len(part), [0.0] * len(part))
            good = [la != "und" and s >= least for la, s in zip(langs, scores)]
            yield part.select(["_row"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, rows.select("_row").schema).select("_row.*")
