"""The pipeline: each stage on its predecessor's rows against a brute-force version, and all of them together."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import langid, quality
from skein.llm.common import Scratch
from tests.llm.test_llm import near

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rnd = random.Random(11)
    tongues = {"aa": ["the", "of", "and", "ingtion", "thered", "onble", "hathe", "wherion"], "bb": ["der", "und", "ein", "schön", "großen", "keiter", "zurück", "über"]}
    words = {la: roots + [rnd.choice(roots) + rnd.choice(roots) + rnd.choice("abcdefg") for _ in range(150)] for la, roots in tongues.items()}
    prose = lambda la, n: " ".join(rnd.choice(words[la]) for _ in range(n))
    rows = []
    for i in range(220):
        la = ("aa", "bb")[i % 2]
        rows.append((i, prose(la, rnd.randrange(25, 120)), la if i % 5 else None, ["s", "t", None][i % 3]))
    for i in range(220, 260):  # near copies and copies
        base = rows[i % 7][1].split()
        for _ in range(i % 3):
            base[rnd.randrange(len(base))] = "odd" + str(i)
        rows.append((i, " ".join(base), "aa", "s"))
    rows += [(260 + k, "# $ % " + "#a$b " * 40, "aa", "t") for k in range(8)] + [(270 + k, prose("aa", 6), "aa", "s") for k in range(5)]
    rows += [(280, None, "aa", "s"), (281, "", None, None), (282, "123 456 " * 30, "bb", "t"), (283, "Ünï 日本語", None, "u"), (None, prose("bb", 40), "bb", "s"), (0, rows[0][1], "aa", "s")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, None) for r in rows], KIND).coalesce(2).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def as_set(rows):
    return Counter(repr(tuple(r)) for r in rows)


def test_stages_and_the_whole(spark, made):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "tokens"]
    scratch, docs, out = Scratch(spark), spark.read.parquet(f"{made}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := scratch.save(stage(spark, docs, made), name))
        assert name == "tokens" or docs.columns == columns

    before, after = out["language"]
    net = langid.trained(before.select("doc_id", "text", "lang"))
    want = Counter()
    for r in before.collect():  # one text at a time
        text = (r["text"] or "").encode()
        lang, score = (x[0] for x in langid.predicted(net, np.frombuffer(text, np.uint8), np.array([0, len(text)]), [type("T", (), {"as_py": lambda self, r=r: r["text"]})()]))
        if r["text"] and any(c.isalpha() for c in r["text"]) and lang != "und" and score >= 0.3:
            want[repr(tuple(r))] += 1
    assert as_set(after.collect()) == want and 250 < after.count() < before.count()

    before, after = out["quality"]
    votes = [(r, r2["v"], r2["f"]) for r, r2 in zip(before.collect(), quality.measured(before).select(quality.votes().alias("v"), quality.base_failed().alias("f")).collect())]
    model = quality.fitted(Counter(v for _, v, _ in votes))
    assert as_set(after.collect()) == as_set(r for r, v, failed in votes if not failed and model.good(v) >= 0.5)
    assert not {r["doc_id"] for r in after.collect()} & set(range(260, 276)) and after.count() > 200

    before, after = out["near_duplicates"]
    rows = before.collect()
    assert as_set(r[:1] for r in after.collect()) == Counter({repr((int(x.split(",")[0][1:]),)) if x[1] != "N" else "(None,)": 1 for x in near(rows, 5) if x.endswith("True)")})
    assert set(as_set(after.collect())) <= set(as_set(rows)) and after.count() < before.count() - 20

    before, after = out["mix"]
    words = lambda r: len((r["text"] or "").split())
    size, taken, copies = defaultdict(int), defaultdict(int), as_set(after.collect())
    for r in before.collect():
        size[r["source"]] += words(r)
        assert copies[repr(tuple(r))] <= 2
    for r in after.collect():
        taken[r["source"]] += words(r)
    assert set(copies) <= set(as_set(before.collect())) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())

    tok = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    before, after = out["tokens"]
    want = Counter()
    for r in before.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[repr((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))] += 1
    assert as_set(after.collect()) == want

    left = len(Scratch.open)
    whole = corpus_pipeline.run(spark, made)
    assert as_set(whole.collect()) == want and len(Scratch.open) == left + 1  # all tables but the last are gone
    assert corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    spark.createDataFrame([], KIND).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
