"""Masked pseudo-likelihood: the network against loops and finite differences, scores against the layout of the table, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import lm
from skein.llm.common import Scratch

KIND = "doc_id long, text string, score double, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    common = [invented(rng, 1) for _ in range(30)]
    texts = []
    for _ in range(300):  # each word sets the next one's kind: what stands around a word tells much of it
        k, words = rng.randrange(30), []
        for _ in range(rng.randint(20, 200)):
            words.append(common[k])
            k = (k * 7 + rng.randrange(3)) % 30
        texts.append(" ".join(words))
    texts += [texts[0]] * 20 + ["", None, " \n\t", "日本語 ünï", "y" * 5000, "z " * 30000]
    return spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(texts)] + [(None, texts[1], None, None), (0, texts[0], None, None)], KIND)


def fitted(spark, docs):
    return lm.vocabulary_of(docs.selectExpr("doc_id", "text"), Scratch(spark))


def ids_of(vocabulary, *texts):
    return [np.frombuffer(x, vocabulary.kind).tolist() for x in vocabulary.of_texts(pa.array(texts, pa.string()))[0]]


def some_net(side=8, seed=3):
    rng = np.random.default_rng(seed)
    net = lm.Net(rng.integers(1, 90, side * side).astype(float))
    for name in lm.shapes(side):
        setattr(net, name, rng.normal(0, 0.5, getattr(net, name).shape))
    net.low0 = net.low0.astype(float)
    return net, rng.integers(0, side * side, 60)


def loop_log_p(net, padded, place):
    """One window, number by number."""
    h = [max(0.0, sum(net.near[j * net.size + padded[place + o], k] for j, o in enumerate(lm.OFFSETS)) + net.bias[k]) for k in range(lm.HIDDEN)]
    high, low = divmod(int(padded[place]), net.side)
    y = [sum(h[k] * net.high[k, i] for k in range(lm.HIDDEN)) + net.high0[i] for i in range(net.side)]
    z = [sum(h[k] * net.low[k, i] for k in range(lm.HIDDEN)) + net.low0[high, i] for i in range(net.side)]
    return y[high] - math.log(sum(map(math.exp, y))) + z[low] - math.log(sum(map(math.exp, z)))


def test_log_probs_are_those_of_a_loop_and_sum_to_one():
    net, padded = some_net()
    places = np.arange(2, 50)
    assert np.allclose(net.log_probs(padded, places), [loop_log_p(net, padded, p) for p in places], atol=1e-5)
    every = []
    for token in range(net.size):
        padded[9] = token
        every.append(net.log_probs(padded, np.array([9]))[0])
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_gradients_are_finite_differences():
    net, padded = some_net()
    at, weight = np.arange(5, 40), np.linspace(0.5, 3, 35)[:, None]
    loss = lambda: -(net.log_probs(padded, at) * weight[:, 0]).sum()
    around, back, grads = net.gradients(padded, at, weight)
    ids, rows = lm.summed(around.ravel(), back)
    grads["near"] = np.zeros_like(net.near)
    grads["near"][ids] = rows
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        array = getattr(net, name)
        spots = [tuple(rng.integers(0, n) for n in array.shape) for _ in range(30)]
        spots += [(int(i), int(rng.integers(lm.HIDDEN))) for i in ids[:20]] if name == "near" else []
        for spot in spots:
            kept, step = array[spot], 1e-5
            array[spot] = kept + step
            up = loss()
            array[spot] = kept - step
            down = loss()
            array[spot] = kept
            assert (up - down) / 2 / step == pytest.approx(g[spot], rel=1e-3, abs=1e-4), (name, spot)


def test_counts_and_spelling_cover_all_words(spark, docs):
    words, endings, spelling, counts = fitted(spark, docs)
    vocabulary, want, steps = lm.Vocabulary(words, endings, spelling, "h"), np.zeros(lm.SIDE**2), np.ones((257, 257))
    for r in docs.collect():
        np.add.at(want, ids_of(vocabulary, r.text)[0], 1)
        for w in WORD.findall((r.text or "").lower()):
            raw = [lm.END, *w.encode(), lm.END]
            np.add.at(steps, (raw[1:], raw[:-1]), 1)
    assert (counts == want).all()
    assert np.allclose(np.exp(spelling), steps / steps.sum(1, keepdims=True)) and np.allclose(np.exp(spelling).sum(1), 1)


def test_words_without_ids_are_spelled(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "side_of", lambda words: 5)  # 21 words, two endings
    words, endings, spelling, counts = fitted(spark, docs)
    assert len(words) == 21 and len(endings) == 2
    vocabulary = lm.Vocabulary(words, endings, spelling, "h")
    found = Counter(w for r in docs.collect() for w in WORD.findall((r.text or "").lower()))
    for w in [*found, "q", "qx", "日本"]:
        raw = w.encode()
        (ids,), cost = vocabulary.of_texts(pa.array([w]))
        (token,) = np.frombuffer(ids, "h")
        chain = [lm.END, *raw[::-1], lm.END]
        skipped = 2 if token != lm.UNKNOWN else 0
        want = 0.0 if lm.FIRST <= token < lm.FIRST + 21 else sum(spelling[a, b] for a, b in list(zip(chain, chain[1:]))[skipped:])
        assert cost[0] == pytest.approx(want), w
    top = {w for w, n in found.most_common(15)}  # their counts differ
    assert all(lm.FIRST <= ids_of(vocabulary, w)[0][0] < lm.FIRST + 21 for w in top)


def test_training_helps_and_scores_do_not_depend_on_the_layout(spark, docs):
    def scores(df, rounds):
        return {(r.doc_id, r.n_tokens): r.log_prob for r in lm.score(df, rounds=rounds, shard=4000).collect() if r.doc_id is not None and r.doc_id < 300}

    def mean(s):
        return sum(s.values()) / sum(n for _, n in s)

    before, after = scores(docs, 0), scores(docs.coalesce(1), 4)
    assert mean(after) > mean(before) + 0.3, (mean(before), mean(after))
    assert scores(docs.repartition(8), 4) == pytest.approx(after, rel=1e-6)


def test_averages_of_many_models(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    rows = [(c, s, 10 + s, np.full(3, float(s)).tobytes()) for c in range(2) for s in range(9)]
    got = lm.added(spark.createDataFrame(rows, lm.MODELS).repartition(5), 9).collect()
    assert sorted((r.chunk, r.seen, np.frombuffer(r.part).tolist()) for r in got) == [(c, 126, [36.0] * 3) for c in range(2)]


def test_training_takes_every_token(spark):
    pairs = [(f"left{k}", f"right{k}") for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(pairs)], "doc_id long, text string")
    words, endings, spelling, counts = fitted(spark, docs)
    vocabulary = lm.Vocabulary(words, endings, spelling, "h")
    _, _, flat = lm.trained(docs, Scratch(spark))
    moved = (lm.Net(counts).near != lm.Net(counts, flat).near).any(1).reshape(4, -1)
    for a, b in pairs:  # what stands beside a token moves only if that token is trained on
        (i,), (j,) = ids_of(vocabulary, a, b)
        assert moved[1, i], f"{b} was never a target"
        assert moved[2, j], f"{a} was never a target"


def test_vocabulary_grows(spark, docs, monkeypatch):
    assert lm.side_of(1e6) == lm.SIDE and lm.side_of(16e8) == pytest.approx(2 * lm.side_of(1e8), abs=1) and lm.side_of(1e18) == lm.MOST
    few = docs.where("doc_id < 40")
    for side in (70, 184):  # two bytes an id, and four
        monkeypatch.setattr(lm, "side_of", lambda words, side=side: side)
        tokens, counts, flat = lm.trained(few.selectExpr("doc_id", "text"), Scratch(spark))
        assert lm.Net(counts, flat).side == side and all(np.frombuffer(r.ids, lm.kind_of(side * side)).max() < side * side for r in tokens.collect() if r.ids)


def test_odd_rows(spark, docs):
    got = lm.score(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert r.n_tokens == len(WORD.findall(texts[r.doc_id] or "")) if r.doc_id is not None else True
        assert (r.mean_log_prob is None) == (r.n_tokens == 0) and r.log_prob <= 0
    assert len({r.log_prob for r in got if r.doc_id == 0}) == 1
    assert lm.score(spark.createDataFrame([], KIND)).count() == 0
    got = lm.score(spark.createDataFrame([(1, None, None, None), (2, "", None, None)], KIND)).collect()
    assert all(r.n_tokens == 0 and r.log_prob == 0 and r.mean_log_prob is None for r in got) and len(got) == 2
