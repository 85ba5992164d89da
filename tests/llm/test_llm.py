"""The operators against brute force, libraries and exact round trips, with odd rows."""

import base64
import hashlib
import io
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import bpe, embed, langid, minhash, mixing, quality, toxicity, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word(i):
    return "".join(chr(97 + (i * k) % 26) for k in (7, 11, 17, 5))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    vocab = [word(i) for i in range(400)]
    texts = [" ".join(rng.choice(vocab, int(n))) + "." for n in rng.integers(5, 300, 60)]
    base = " ".join(rng.choice(vocab, 150)).split()
    for _ in range(40):  # near copies of one text, some too far from it
        copy = list(base)
        for k in rng.integers(0, 150, int(rng.integers(1, 9))):
            copy[k] = f"w{rng.integers(1e9)}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 30 + [texts[4].upper()] + ["one two", "one two", "", None, " \n\t", "123 456", "Ünï " * 50, "x " * 20000, "same line here\n" * 30, "日本語のテキスト", "a\x1cb\x85c\xa0d"]
    return [(i, t, [None, "aa", "bb"][i % 3], [None, "s", "t", "u"][i % 4], None, 1.0, "k") for i, t in enumerate(texts)] + [(None, "null id text", None, None, None, None, None), (0, texts[0], "aa", None, None, 1.0, "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def near(rows, width):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]))
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((repr((r[0], len(sets[i]), low.get(root(i)), r[0] == low.get(root(i)))) for i, r in enumerate(rows)))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    assert sorted(repr(tuple(r)) for r in minhash.near_duplicates(docs, width).collect()) == near(rows, width)


def test_near_duplicates_in_blocks(docs, rows):
    assert sorted(repr(tuple(r)) for r in minhash.near_duplicates(docs, 4, block=8).collect()) == near(rows, 4)


def test_one_of_each(spark, docs, rows):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted({x.split(",")[0][1:] for x in near(rows, 5) if x.endswith("True)")})
    prose = [" ".join(word(i * 7 + k * k) for k in range(40)) for i in range(6)]
    odd = [(None, prose[0], "a"), (None, prose[1], "b"), (None, prose[1], "c"), (7, prose[2], "d"), (7, prose[3], "e"), (8, prose[3] + " more", "f"), (9, prose[4], "g"), (9, prose[4], "g"), (5, prose[5], "h"), (None, prose[5], "i"), (1, None, "j"), (1, "", "k"), (None, " ", "l")]
    df = spark.createDataFrame(odd, "doc_id long, text string, digest string")
    got = sorted(r["digest"] for r in minhash.one_of_each(df).collect())
    assert got in (sorted("adeghjkl" + x) for x in "bc")  # every text once, of the smallest id where there is one
    assert minhash.one_of_each(df.where("false")).collect() == [] == minhash.near_duplicates(df.where("false")).collect()


def test_quality(docs, rows):
    got = sorted((repr(tuple(r)[:7]) for r in quality.quality(docs).collect()))
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count, under = Counter(windows), set()
        for i, x in enumerate(windows):
            if count[x] > 1:
                under.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append(repr((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(under), len(w) < 20 or 100 * len(under) > 30 * len(w))))
    assert got == sorted(want)
    good = Counter(r["doc_id"] for r in quality.quality(docs).collect() if r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == good


def test_mix(docs, rows):
    out = mixing.mix(docs).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs).collect())) and len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(r["source_size"] == sizes[r["source"]] for r in out)
    assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK for s in target)
    assert mixing.targets([10, 1000], [5, 2], 1500) == [20, 1480]


def test_bpe_is_the_librarys(docs, rows):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append(repr((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert sorted(repr(tuple(r)) for r in bpe.round_trip(docs, path).collect()) == sorted(want)
    b = bpe.Bpe(path)
    for t in ("<|endoftext|>a <|endoftext|>", "a" * 5000, "it's  \n\n x²½ 日本 \x1c\x85", "<|endo"):
        assert b.encode(t) == tok.encode(t, add_special_tokens=False).ids and b.decode(b.encode(t)) == t
        one, other = bpe.long_digests(b, t), next(bpe.digests(b, [t]))
        assert one[1:] == other[1:] and one[0].tolist() == other[0].tolist() == b.encode(t)
    rng = np.random.default_rng(6)
    for letters in ("ab", "abcdefgh0123", "aé日"):  # words of one cut, far over LONG
        t = "".join(rng.choice(list(letters), 9000))
        raw = b.byte_id[np.frombuffer(t.encode(), np.uint8)]
        assert b.merge_long(raw).tolist() == b.merge(raw.copy(), np.array([len(raw)]))[0].tolist()
        assert b.encode(t) == tok.encode(t, add_special_tokens=False).ids
    with_ids = bpe.round_trip(docs, path, keep_ids=True).where("doc_id = 5").first()
    assert with_ids["ids"] == tok.encode(rows[5][1], add_special_tokens=False).ids and bpe.round_trip(docs.where("false"), path).collect() == []


def test_warc(spark, tmp_path):
    pages = [(1, "u", "<p>x</p>"), (2, "u 2", "<p>x</p>"), (3, None, None), (4, "v", ""), (5, "w", "é" * 100000), (None, "n", "<p>x</p>"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw, top = (h or "").encode(), largest[h or ""]
        again = top >= 0 and top != i
        want.append(repr((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None)))
    assert sorted(repr(tuple(r)) for r in warc.round_trip(df).collect()) == sorted(want)
    one = warc.record(1, "a", "u", b"hello")
    assert next(warc.read(io.BytesIO(one)))[1].endswith(b"hello")
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(one[:-9])))
    assert warc.round_trip(df.where("false")).collect() == []


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x[100:200] = x[5] + rng.normal(size=(100, 64)) * 0.33
    vectors = [v.tolist() for v in x] + [x[7].tolist()] * 5 + [(x[7] * 3).tolist(), [0.0] * 64, None, [1.0] * 3, [float("nan")] * 64]
    vectors = [None if v is None else [float(np.float32(c)) for c in v] for v in vectors] + [[None] * 64]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    full = np.array([v if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v) else [0.0] * 64 for v in vectors])
    norm = np.linalg.norm(full, axis=1, keepdims=True)
    unit = full / np.where(norm == 0, 1, norm)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    for block in (128, 16):
        got = {r["vec_id"]: r for r in embed.near_vectors(df, block=block).collect()}
        assert [got[i]["n_links"] for i in range(len(vectors))] == linked.sum(1).tolist()
        assert got[150]["component_id"] == got[100]["component_id"] and got[302]["component_id"] == 7 and got[307]["component_id"] == 307


def test_language(spark, docs, rows):
    rng = np.random.default_rng(3)
    tongue = {"aa": "the of and ing tion", "bb": "der und ein schö ßen"}
    made = [(i, " ".join(rng.choice(tongue[la].split(), 30)), la) for i in range(300) for la in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = langid.identify(df).collect()
    assert sum(r["lang_pred"] == made[r["doc_id"]][2] for r in out if r["held_out"]) >= 0.9 * sum(r["held_out"] for r in out) > 0
    odd = langid.identify(docs).collect()
    assert len(odd) == len(rows) and {r["lang_pred"] for r in odd} <= {"aa", "bb", "und"}
    by = {r["doc_id"]: r for r in odd}
    assert all(by[i]["lang_pred"] == "und" for i, t, *_ in rows if i is not None and not any(c.isalpha() for c in t or ""))
    assert langid.identify(df.where("false")).collect() == [] and langid.keep_known(docs).columns == docs.columns


def test_toxicity(spark, docs, rows):
    made = [(i, f"the {word(i)} is here. " + ("you are a zorgle fool." if i % 3 == 0 else "all is well."), i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in made], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(df, labels).collect()
    assert all(r["predicted"] == int(made[r["doc_id"]][2]) for r in out) and any(r["held_out"] for r in out)
    assert len(toxicity.toxicity(docs, labels.where("false")).collect()) == len(rows)
