"""Weak supervision: EM on planted votes, the column against the model, odd rows."""

import random

import pytest

from skein.llm import quality

FIRST = {kind: next(k for k, r in enumerate(quality.RULES) if r[1] == kind) for kind in quality.KINDS[1:]}


def planted(seed, coin=None, n=20000, hit=0.7, wrong=0.005, shares=(0.85, 0.1, 0.05)):
    """Counts of patterns and of (pattern, kind); rule `coin` votes bad on a fifth of all documents, whatever they are."""
    rnd, counts, truth = random.Random(seed), {}, {}
    for _ in range(n):
        kind, p = rnd.choices(range(3), shares)[0], ""
        for k, (_, made_for, *_) in enumerate(quality.RULES):
            bad = 0.2 if k == coin else hit if quality.KINDS[kind] == made_for else wrong
            u = rnd.random()
            p += "2" if u < 0.05 else "0" if u < 0.05 + 0.95 * bad else "1"
        counts[p] = counts.get(p, 0) + 1
        truth[p, kind] = truth.get((p, kind), 0) + 1
    return counts, truth


def test_em_recovers_planted_rates():
    counts, _ = planted(1)
    model = quality.fitted(counts)
    assert [round(s, 2) for s in model.shares] == pytest.approx([0.85, 0.1, 0.05], abs=0.02)
    for c, kind in enumerate(quality.KINDS):
        for k, (_, made_for, *_) in enumerate(quality.RULES):
            want = 0.95 * (0.7 if kind == made_for else 0.005)
            assert model.rates[c][k]["0"] == pytest.approx(want, abs=0.05), (kind, k)


@pytest.mark.parametrize("coin", range(len(quality.RULES)))
def test_an_inaccurate_rule_is_overruled(coin):
    counts, truth = planted(2, coin)
    model = quality.fitted(counts)
    lone = "".join("0" if k == coin else "1" for k in range(len(quality.RULES)))
    assert model.good(lone) > 0.9  # where all must pass, this document fails
    others = [model.accuracy(k) for k in range(len(quality.RULES)) if k != coin]
    assert model.accuracy(coin) < 0.85 < min(others)
    wrong = sum(n for (p, kind), n in truth.items() if (model.good(p) >= 0.5) != (kind == 0))
    all_pass = sum(n for (p, kind), n in truth.items() if ("0" not in p) != (kind == 0))
    assert wrong < 0.04 * 20000 < all_pass


def test_a_lone_vote_of_an_accurate_rule_counts():
    """Symbols fail alone on half of the noisy documents, with an abstention of `letters` on the others; good ones never have such votes."""
    symbols, letters = (next(k for k, r in enumerate(quality.RULES) if r[0] == name) for name in ("symbols", "letters"))
    good = "1" * len(quality.RULES)
    lone = good[:symbols] + "0" + good[symbols + 1 :]
    unsure = lone[:letters] + "2" + lone[letters + 1 :]
    model = quality.fitted({good: 9000, lone: 300, unsure: 320})
    assert model.good(good) > 0.99 and model.good(lone) < 0.5 and model.good(unsure) < 0.01


def test_the_column_is_the_models_posterior(spark):
    rnd = random.Random(5)
    model = quality.fitted(planted(3, 0)[0])
    patterns = ["".join(rnd.choice("012") for _ in quality.RULES) for _ in range(300)] + ["1" * len(quality.RULES)]
    df = spark.createDataFrame([(p,) for p in patterns], "_votes string")
    for r in df.select("_votes", quality.posterior(model).alias("p")).collect():
        logs = [1.0, 1.0, 1.0]
        for c in range(3):
            logs[c] = model.shares[c]
            for k, v in enumerate(r["_votes"]):
                logs[c] *= model.rates[c][k][v]
        assert r["p"] == pytest.approx(logs[0] / sum(logs), rel=1e-9)


def test_kept_is_the_verdict_of_a_fit_on_all_rows(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [prose(rnd.randrange(15, 300)) for _ in range(200)] + ["# $ % " + "#a$b " * 40 + prose(20) for _ in range(20)] + [(prose(12) + "\n") * 9 for _ in range(20)] + [None, "", "one", "x " * 50_000]
    df = spark.createDataFrame([(k, t, 1, "h", "v") for k, t in enumerate(texts)] + [(0, texts[0], 2, None, None), (None, prose(50), 3, None, None)], "doc_id long, text string, _votes int, placed string, probability string")
    found = quality.measured(df.select("doc_id", "text")).select("doc_id", quality.votes().alias("v"), quality.base_failed().alias("failed")).collect()
    counts = {}
    for r in found:
        counts[r["v"]] = counts.get(r["v"], 0) + 1
    model = quality.fitted(counts)
    want = sorted((repr(r["doc_id"]), not r["failed"] and model.good(r["v"]) >= 0.5) for r in found)
    assert sorted((repr(r["doc_id"]), r["kept"]) for r in quality.quality(df).collect()) == want
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(i for i, k in want if k)
    verdict = dict(want)
    assert sum(verdict[str(k)] for k in range(200)) > 150 and not any(verdict[str(k)] for k in range(200, 244))
    none = df.where("false")
    assert quality.quality(none).collect() == [] and quality.keep_good(none).collect() == []


def test_variety_votes_at_every_length(spark):
    few = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa"]
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(few) for _ in range(n)) for n in (50, 400, 401, 5000)] + [" ".join(f"word{k}" for k in range(n)) for n in (50, 401, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = next(k for k, r in enumerate(quality.RULES) if r[0] == "variety")
    assert [r["v"][at] for r in quality.measured(df).select("doc_id", quality.votes().alias("v")).orderBy("doc_id").collect()] == list("0000111")
