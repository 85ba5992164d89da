"""Toxicity by a weighted finite-state grammar over clauses."""

import re
from hashlib import blake2b
from math import log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, crc_mod, split_of, text_slices

# The grammar's own words. The insults are where learning starts; labels add others.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool dumb imbecile jerk bastard filth vermin garbage".split()
THREATS = "kill hurt destroy beat shoot stab burn hang strangle crush".split()
#: Phrases that insult or threaten as a whole.
INSULT_PHRASES = ("shut up", "drop dead", "go to hell", "waste of space", "waste of skin", "good for nothing", "sick of your", "makes me sick", "crawl back to")
THREAT_PHRASES = ("beat up", "hunt down", "get rid of", "come for", "coming for", "blow up", "cut up", "wipe out", "put down like", "make pay")
#: Whom a threat or insult before them may be aimed at; they are targets, too.
OBJECTS = "you your yours yourself yourselves her herself him himself his them themselves their those everyone".split()
TARGETS = "you your yours he she they him her them his their this these those it everyone".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't hardly".split()
REPORTS = "said says wrote claimed called quoted reported alleged according word term".split()

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
TERM = re.compile(r"[^\W_]+")
BREAK = re.compile(r"[.!?;\n]")
#: Log-weight of an insult or threat that nothing is known of; its changes by what stands around it.
PLAIN, NEGATED, REPORTED, AIMED, UNAIMED = 2.0, -1.5, -1.0, 0.7, -0.6
#: Characters of a text that count as one page, some hundred words.
PAGE = 600
#: Words up to an object that a threat or insult before it aims at. Letters of a learnt stem.
AHEAD, STEM = 4, 5


class Transducer:
    """Deterministic: arcs (state, symbol) -> (output symbol, weight, state); other symbols pass unchanged to the state's `default`."""

    def __init__(self, arcs: dict, default: dict | None = None):
        self.arcs, self.default = arcs, default or {}

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.default.get(state, state))


def composed(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that feeds the first one's output to the second; states are pairs, as far as they can be reached."""
    arcs, todo, seen = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        pair = todo.pop()
        for s in symbols:
            mid, w1, a = first.step(pair[0], s)
            out, w2, b = second.step(pair[1], mid)
            if (a, b) not in seen:
                seen[a, b] = len(seen)
                todo.append((a, b))
            arcs[seen[pair], s] = (out, w1 + w2, seen[a, b])
    return Transducer(arcs)


def countdown(opens: str, most: int, on: dict[str, tuple[str, float]]) -> Transducer:
    """After a symbol of `opens`, up to `most` symbols further on, rewrite and weigh the symbols of `on`."""
    arcs = {(state, s): (s, 0.0, most) for state in range(most + 1) for s in opens}
    for state in range(1, most + 1):
        arcs |= {(state, s): (out, w, state - 1) for s, (out, w) in on.items()}
    return Transducer(arcs, {state: state - 1 for state in range(1, most + 1)})


def completed(most: int) -> Transducer:
    """An insult that nothing before it aims weighs less; an object up to `most` symbols after it, or after such a threat, carries the weight of aiming the last one."""
    arcs = {}
    for state in range(2 * most + 1):  # 1 to `most` wait after a threat, those above after an insult
        arcs |= {(state, "H"): ("H", 0.0, most), (state, "I"): ("I", UNAIMED, state - 1 if 1 < state <= most else 2 * most)}
        if state:
            arcs[state, "O"] = ("O", PLAIN + AIMED if state <= most else AIMED - UNAIMED, 0)
    return Transducer(arcs, {state: 0 if state == most + 1 else state - 1 for state in range(1, 2 * most + 1)})


SYMBOLS = "NRTOIHW"


def stages(ahead: int = AHEAD) -> tuple[Transducer, ...]:
    """Negation weakens an insult or threat within three words; reported speech, all that follows in the clause; a target
    within five words before strengthens what is left; so does an object up to `ahead` words after, if none stood before.
    """
    negation = countdown("N", 3, {"I": ("J", NEGATED), "H": ("P", NEGATED)})
    reported = Transducer({(s, "R"): ("R", 0.0, 1) for s in (0, 1)} | {(1, a): (b, REPORTED, 1) for a, b in ("IQ", "JQ", "Hp", "Pp")})
    aimed = countdown("TO", 5, {"I": ("L", AIMED), "H": ("K", AIMED)})
    return negation, reported, aimed, completed(ahead)


def grammar(ahead: int = AHEAD) -> Transducer:
    """Symbols: N negation, R reported speech, T target, O target that may be an object, K and L aimed threats and insults, I insult, H threat, W any other word; J and Q are weakened insults, P and p such threats."""
    whole, *others = stages(ahead)
    for one in others:
        whole = composed(whole, one, SYMBOLS)
    return whole


class Lexicon:
    """The lexical transducer, from words to symbols and weights. Insults and threats are phrases of one word or more; a state is how much of one was read."""

    def __init__(self, learnt: dict[str, float]):
        self.learnt = learnt
        self.kinds = {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "T" for w in TARGETS} | {w: "O" for w in OBJECTS} | {w: "H" for w in THREATS}
        self.phrases = {tuple(p.split()): k for k, of in (("I", INSULT_PHRASES), ("H", THREAT_PHRASES)) for p in of}
        self.begun = {p[:k] for p in self.phrases for k in range(1, len(p))}

    def step(self, state: tuple, word: str) -> tuple[str, float, tuple]:
        """(symbol, weight, state): the symbol of a phrase is that of its last word."""
        for read in (state, ()):
            if (kind := self.phrases.get((*read, word))) is not None:
                return kind, PLAIN, ()
        state = next((r for r in ((*state, word), (word,)) if r in self.begun), ())
        weight = self.learnt.get(word)
        if weight is None and len(word) > STEM:
            weight = self.learnt.get(word[:STEM] + "*")
        if weight is not None:
            return "I", weight, state
        kind = self.kinds.get(word, "W")
        return kind, PLAIN if kind == "H" else 0.0, state

    def anchors(self) -> list[str]:
        """Words and stems one of which stands in each clause that may score."""
        return [*self.learnt, *THREATS, *{max(p, key=len) for p in self.phrases}]


class Scorer:
    """Lexicon and grammar together. learnt: word, or stem of STEM letters with a final *, to its log-weight."""

    def __init__(self, learnt: dict[str, float], ahead: int = AHEAD):
        self.lexicon, self.grammar = Lexicon(learnt), grammar(ahead)
        self.finder = ahocorasick.Automaton()
        for w in self.lexicon.anchors():
            self.finder.add_word(w.rstrip("*"), w)
        self.finder.make_automaton()

    def clause(self, text: str) -> float:
        """The weight of a clause that the grammar accepts, otherwise 0: one with a threat that has a target before or after it, or with an insult among other words.

        It is the sum of what its insults and threats weigh where they stand. A word alone says nothing of anyone, unless it is exclaimed.
        """
        read, state, total, words = (), 0, 0.0, 0
        for m in WORD.finditer(text):
            words += 1
            symbol, own, read = self.lexicon.step(read, m[0])
            out, weight, state = self.grammar.step(state, symbol)
            if symbol == "I" or symbol in "HO" and weight > 0:
                total += max(0.0, own + weight)
        return total if words > 1 or text.rstrip()[-1:] == "!" else 0.0

    def total(self, text: str) -> float:
        """Over the clauses that hold an anchor of the lexicon, which one pass over the whole text finds."""
        low, total, done = text.lower(), 0.0, 0
        for end, word in self.finder.iter(low):
            start = end + 1 - len(word.rstrip("*"))
            if start < done or start and low[start - 1].isalnum() or word[-1] != "*" and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            begins = done
            for m in BREAK.finditer(low, done, start):
                begins = m.end()
            stop = BREAK.search(low, end + 1)
            done = stop.end() if stop else len(low)
            total += self.clause(low[begins:done])
        return total


def kind_of(words: list[str]) -> int:
    """The least hash of a text's runs of three words: alike for copies and, mostly, near copies, and hardly ever for others."""
    runs = (" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2)))
    return int.from_bytes(min(blake2b(r.encode(), digest_size=8).digest() for r in runs), "big", signed=True)


def items_of(train: DataFrame) -> DataFrame:
    """(toxic, kind, item) for each distinct word and stem of the texts of train(text, toxic)."""

    def run(batches):
        for part in text_slices(batches):
            toxic, kinds, items = [], [], []
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                read = TERM.findall((text or "").lower())
                words = set(read)
                if words:
                    mine = words | {w[:STEM] + "*" for w in words if len(w) > STEM}
                    toxic += [label] * len(mine)
                    kinds += [kind_of(read)] * len(mine)
                    items += mine
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(kinds, pa.int64()), pa.array(items, pa.string())], ["toxic", "kind", "item"])

    return train.select("toxic", "text").mapInArrow(run, "toxic int, kind long, item string").distinct()


def lexicon_of(train: DataFrame, least: int = 3, lift: float = 20.0, chance: float = 20.0) -> dict[str, float]:
    """Words and stems that toxic documents have and others don't, with their log-lift, from train(text, toxic), which is of bounded size.

    A word counts once for each kind of document, so copies of one document don't make its words toxic. It is learnt if it is in `least` kinds
    of toxic documents, `lift` times as common there as elsewhere, and by a log-likelihood ratio of `chance` (one word in 100,000 by chance).
    A stem stays if two such words have it.
    """
    each = Scratch(train.sparkSession).save(items_of(train), "items")
    totals = {r["toxic"]: r["n"] for r in each.select("toxic", "kind").distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counts = each.groupBy("item").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))

    def part(seen, whole):
        """seen * log(seen / expected)"""
        expected = (F.col("bad") + F.col("good")) * F.lit(whole / (bad + good))
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("bad"), bad) + part(F.col("good"), good))
    found = counts.where(F.col("bad") >= least).where(F.length("item") >= 3).where(weight > log(lift)).where(ratio > chance)
    found = found.where(~F.col("item").isin(*OBJECTS, *TARGETS, *NEGATIONS, *REPORTS))  # the grammar's own
    learnt = {r["item"]: min(4.0, r["weight"]) for r in found.select("item", weight.alias("weight")).collect()}  # of the sample's words
    words = [w for w in learnt if w[-1] != "*"]
    return {w: x for w, x in learnt.items() if w[-1] != "*" or sum(v.startswith(w[:-1]) for v in words) > 1}


def measures(total: float, chars: int) -> tuple[float, float]:
    """Of a text: the log of what its clauses weigh, and of what they weigh for each PAGE characters, as a single clause tells less of a long text."""
    return log1p(total), log1p(total / max(1.0, chars / PAGE))


def slope(x: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the logistic of measures() and a constant, by Newton steps with a small penalty; both kinds weigh the same."""
    if not len(x) or toxic.min() == toxic.max():
        return np.array([2.0, 1.0, -1.5])
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    share = (counts * toxic).sum() / counts.sum()
    w = counts * np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    beta = np.array([1.0, 0.0, -1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - toxic)) + 0.01 * beta
        beta = beta - 0.7 * np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), grad)
    return beta


_scorers: dict = {}


def scorer_for(lexicon: dict[str, float]) -> Scorer:
    """One for each Python worker and lexicon."""
    key = hash(tuple(sorted(lexicon.items())))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(lexicon)
    return _scorers[key]


def scored(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(toxic, whole, dense) of each row's whole text: its label and measures()."""

    def run(batches):
        s = scorer_for(lexicon)
        for part in text_slices(batches):
            found = [measures(s.total(t or ""), len(t or "")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())], ["toxic", "whole", "dense"])

    return docs.select("toxic", F.col("text").cast("string").alias("text")).mapInArrow(run, "toxic int, whole double, dense double")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 6000, parts: int = 5, held: int = 0) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights of slope()) from the texts of about `sample` labelled doc_ids, at most twice that, half of them toxic if there are as many.

    Rows whose crc32(doc_id) modulo `parts` is `held` are left out.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(crc_mod("doc_id", parts) != held)
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, sample / 2 / counts.get(1, 1)).otherwise(sample / 2 / counts.get(0, 1))
    chosen = usable.withColumn("h", F.xxhash64("doc_id")).where(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("h").alias("h"))
    rows = chosen.orderBy("h").limit(2 * sample).select("doc_id", "toxic").collect()
    if not rows:
        return dict.fromkeys(INSULTS, PLAIN), slope(np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in rows], "doc_id long, toxic int")  # of bounded size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), "doc_id")
    lexicon = dict.fromkeys(INSULTS, PLAIN) | lexicon_of(texts)
    seen = scored(texts, lexicon).groupBy("toxic", F.round("whole", 1).alias("whole"), F.round("dense", 1).alias("dense")).agg(F.count("*").alias("n")).collect()  # a few values, not rows
    x = np.array([(r["whole"], r["dense"]) for r in seen], float).reshape(-1, 2)
    return lexicon, slope(x, *(np.array([r[c] for r in seen], float) for c in ("toxic", "n")))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text), with a lexicon and slope fitted on labels(doc_id, toxic).

    Defined cases: a null or empty text has the score of a text without any matched clause; rows without label are scored like others; labels of one
    doc_id that disagree count as toxic, and null ones not at all; without labels the built-in words and a fixed slope hold;
    repeated rows get the same score each; an empty table gives no rows; other columns are not looked at.
    """
    lexicon, beta = fitted(docs, labels, sample)

    def run(batches):
        s = scorer_for(lexicon)
        for part in text_slices(batches):
            found = np.array([measures(s.total(t or ""), len(t or "")) for t in part.column(1).to_pylist()]).reshape(-1, 2)
            scores = (1 / (1 + np.exp(-np.clip(found @ beta[:2] + beta[2], -30, 30)))).tolist()
            held = split_of(part.column(0).to_pylist(), 5) == 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
