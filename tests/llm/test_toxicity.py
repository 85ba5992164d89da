"""The toxicity grammar against its transducers one after another, threats and insults in clauses, odd rows."""

import random
import re
import time

from skein.llm import toxicity


def one_after_another(symbols, ahead):
    """Each transducer over the whole output of the one before."""
    now, weights = list(symbols), [0.0] * len(symbols)
    for transducer in toxicity.stages(ahead):
        state, out = 0, []
        for k, s in enumerate(now):
            s, w, state = transducer.step(state, s)
            out.append(s)
            weights[k] += w
        now = out
    return now, weights


def test_composition_is_one_after_another():
    rnd = random.Random(2)
    for ahead in (0, 1, 4):
        whole = toxicity.grammar(ahead)
        for _ in range(400):
            symbols, state = [rnd.choice(toxicity.SYMBOLS) for _ in range(rnd.randrange(1, 25))], 0
            want, weights = one_after_another(symbols, ahead)
            for s, w, x in zip(symbols, want, weights):
                out, weight, state = whole.step(state, s)
                assert out == w and abs(weight - x) < 1e-9, (symbols, ahead)


def plain_total(scorer, text):
    """Clause by clause, without the finder and without composition."""
    total = 0.0
    for clause in re.findall(r"[^.!?;\n]*[.!?;\n]?", text.lower()):
        words, read, told = toxicity.WORD.findall(clause), (), []
        for w in words:
            symbol, own, read = scorer.lexicon.step(read, w)
            told.append((symbol, own))
        _, weights = one_after_another([s for s, _ in told], toxicity.AHEAD)
        part = sum(max(0.0, own + w) for (s, own), w in zip(told, weights) if s == "I" or s in "HO" and w > 0)
        total += part if len(words) > 1 or clause[-1:] == "!" else 0.0
    return total


def test_totals_are_those_of_all_clauses():
    scorer, rnd = toxicity.Scorer({"fool": 2.0, "zorgl*": 3.0, "dumb": 1.0}), random.Random(4)
    words = "fool zorgler zorgle foolish dumb you your they it not never said kill burning burn shut up drop dead hunt down come for . ! , ; the house is nice\n a".split(" ")
    for _ in range(500):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))
        assert abs(scorer.total(text) - plain_total(scorer, text)) < 1e-9, text


def test_clauses_not_words():
    s = toxicity.Scorer({"fool": 2.0})
    assert s.total("you fool!") > s.total("what a fool!") > s.total("he said a fool!") > s.total("not a fool!") > s.total("foolish man") == 0
    assert s.total("fool") == s.total("fool.\nfool;") == s.total("kill") == s.total("kill!") == 0 < s.total("fool!")  # nothing is said of anyone
    assert s.total("i will kill you") == s.total("you they will kill") == toxicity.PLAIN + toxicity.AIMED
    assert abs(s.total("fool that you are") - s.total("you fool")) < 1e-9 and s.total("you kill them") == s.total("you kill")
    for threat in ("kill you", "we will burn them alive", "i will hurt her and her family", "i will hunt down your friends", "we are coming for you"):
        assert s.total(threat) >= toxicity.PLAIN, threat
    for insult in ("you should shut up", "go to hell, all of you", "drop dead you"):
        assert s.total(insult) > 1, insult
    for fine in ("kill the process", "burn the log", "shut the door", "up to you", "drop the dead weight", "go to the hall", "they are good for you"):
        assert s.total(fine) == 0, fine


def test_threats_before_their_target(spark):
    texts = ["i will kill you", "kill yourself", "we should hurt them", "someone will kill every one of you", "i will not kill you", "kill the process. you may rest", "the plan is good", "kill time before he comes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, none).collect()}
    assert all(score[k] > score[4] >= score[6] for k in range(4)) and score[5] == score[6] == score[7]


def test_words_of_few_documents_are_learnt_and_those_of_copies_are_not(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(8))
    common = [word() for _ in range(200)]
    prose = lambda: " ".join(rnd.choice(common) for _ in range(30))
    rows = [(f"{prose()} you zorgle {prose()}", 1) for _ in range(400)] + [(f"{prose()} blorkling {prose()}", 1) for _ in range(12)]
    rows += [(f"{prose()}", 0) for _ in range(900)]
    same = f"{prose()} harmless {prose()}"
    rows += [(same, 1)] * 50
    learnt = toxicity.lexicon_of(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"zorgle", "blorkling"} <= set(learnt) and "harmless" not in learnt and not set(learnt) & {*common, "you"}


def test_odd_rows(spark):
    kind = "doc_id long, text string, score double, total double, toxic int, held_out int"
    rows = [(1, "you idiot, you are scum", 1.0, None, None, None), (1, "you idiot, you are scum", None, None, None, None), (None, "fine prose about trees", None, 2.0, 5, 1), (3, None, None, None, None, None), (4, "", None, None, None, None)]
    rows += [(5, "x" * 1_000_000 + " you idiot", None, None, None, None), (6, "word " * 100_000 + "you idiot.", None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 1, None), (None, 1, 1), (9, 0, 7)], "doc_id long, quality int, toxic int")
    begun = time.time()
    got = toxicity.toxicity(docs, labels).collect()
    assert time.time() - begun < 60 and len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[3] == score[4] == score[None] < score[5] and score[6] > score[4] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.toxicity(docs.where("false"), labels).collect() == [] and len(toxicity.toxicity(docs, labels.where("false")).collect()) == len(rows)
