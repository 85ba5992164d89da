"""Quality rules as weak supervision: rules vote or abstain, EM weighs them. DataFrame operations only."""

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACES, WORD, Scratch

SYMBOLS = "#*$%&|<>"
#: The window of repeated words.
WINDOW = 8


def length(c) -> Column:
    return F.length(c).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more in the array.

    Windows are told apart by a 64-bit hash. Where all differ, which one pass shows, the rest is skipped.
    """
    n = F.size(words) - F.lit(WINDOW - 1)
    marks = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(marks)


def covered(marks: Column) -> Column:
    """From the windows' hashes: the number of words under windows that are not unique."""
    placed = F.array_sort(F.transform(marks, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def same(p, i, step):
        other = F.get(placed_col, i + step)
        return F.coalesce(other["h"] == p["h"], F.lit(False))

    placed_col = F.col("placed")
    twice = F.filter(placed_col, lambda p, i: same(p, i, -1) | same(p, i, 1))
    starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
    spans = F.transform(F.col("starts"), lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, b: a + b)
    return placed, starts, spans, total


def measured(docs: DataFrame) -> DataFrame:
    """docs with _words, the measures _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and what rules need more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("_text", text)
    d = d.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("_marks", repeated_words(F.col("_words"))).withColumn("_twice", F.size(F.array_distinct("_marks")) < F.size("_marks"))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    d = d.select(
        *[c for c in d.columns if c not in ("_marks", "_words", "_lines", "_text")],
        F.when(F.col("_twice"), F.col("_marks")).alias("_marks"),
        F.size("_words").cast("long").alias("_n_words"),
        length(F.translate("_text", SPACES, "")).alias("_word_chars"),
        (length("_text") - length(F.translate("_text", SYMBOLS, ""))).alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (length("_text") - length(F.regexp_replace("_text", r"\p{Lu}", ""))).alias("_n_upper"),
        (length("_text") - length(F.regexp_replace("_text", r"\p{L}", ""))).alias("_n_letters"),
        F.size(F.array_distinct("_words")).cast("long").alias("_n_distinct"),
    )
    placed, starts, spans, total = covered(F.col("_marks"))
    d = d.withColumn("placed", F.when(F.col("_twice"), placed)).withColumn("starts", starts).withColumn("spans", spans)
    return d.withColumn("_n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("placed", "starts", "spans", "_marks", "_twice")


#: A rule's name, the kind of bad document that it is made for, what it looks at, the value up to which it votes good and that
#: from which it votes bad; between them it abstains. Variety is log distinct words / log words, which hardly changes with length.
RULES = (
    ("symbols", "noise", "try_divide(_n_symbols, _word_chars)", 0.02, 0.08),
    ("capitals", "noise", "try_divide(_n_upper, _n_letters)", 0.25, 0.6),
    ("long words", "noise", "try_divide(_word_chars, _n_words)", 9.0, 14.0),
    ("short words", "noise", "-try_divide(_word_chars, _n_words)", -3.0, -2.0),
    ("letters", "noise", "1 - try_divide(_n_letters, _word_chars)", 0.2, 0.4),
    ("repeats", "repetition", "try_divide(_n_repeat_words, _n_words)", 0.1, 0.3),
    ("lines", "repetition", "try_divide(_n_dup_lines, _n_lines)", 0.1, 0.5),
    ("variety", "repetition", "-try_divide(ln(_n_distinct), ln(_n_words))", -0.75, -0.62),
)
#: Latent kinds of documents: good ones, and one for each kind of bad ones, since failures of one kind exclude others.
KINDS = ("good", *dict.fromkeys(kind for _, kind, *_ in RULES))
#: Before EM: how often a rule votes bad, votes good or abstains ("0", "1", "2") on bad documents of its kind, and on all others; the kinds' shares.
#: EM finds the nearest of several solutions, so it starts from rules that are often, seldom and hardly ever wrong, and the likeliest solution counts.
STARTS = tuple(({"0": 0.3, "1": 0.65, "2": 0.05}, {"0": wrong, "1": 0.95 - wrong, "2": 0.05}) for wrong in (0.02, 0.005, 0.002))
SHARES = (0.8, *[0.2 / (len(KINDS) - 1)] * (len(KINDS) - 1))
#: The prior: what stands before EM counts as so many documents of each kind. Nothing else holds the estimates.
WEIGHT, ROUNDS = 10, 60


def votes() -> Column:
    """A digit for each rule: 1 good, 0 bad, 2 abstains (also where it can't be computed)."""
    return F.concat(*[F.when(F.expr(value) <= good, "1").when(F.expr(value) >= bad, "0").otherwise("2") for _, _, value, good, bad in RULES])


class Model:
    """shares: of each kind; rates[kind][rule][vote]: how often a rule votes so on documents of a kind. Given the kind, rules vote independently."""

    def __init__(self, shares, rates):
        self.shares, self.rates = shares, rates

    def logs(self, pattern: str) -> list[float]:
        return [log(s) + sum(log(rule[v]) for rule, v in zip(rates, pattern)) for s, rates in zip(self.shares, self.rates)]

    def posterior(self, pattern: str) -> list[float]:
        logs = self.logs(pattern)
        top = max(logs)
        p = [exp(x - top) for x in logs]
        return [x / sum(p) for x in p]

    def likelihood(self, counts: dict[str, int]) -> float:
        """The log-probability of all these votes."""
        total = 0.0
        for p, n in counts.items():
            logs = self.logs(p)
            total += n * (max(logs) + log(sum(exp(x - max(logs)) for x in logs)))
        return total

    def good(self, pattern: str) -> float:
        return self.posterior(pattern)[0]

    def accuracy(self, rule: int) -> float:
        """How often the rule is right when it votes: good on good documents, bad on those of the kind that it is made for."""
        kind = KINDS.index(RULES[rule][1])
        right = self.shares[0] * self.rates[0][rule]["1"] + self.shares[kind] * self.rates[kind][rule]["0"]
        wrong = self.shares[0] * self.rates[0][rule]["0"] + self.shares[kind] * self.rates[kind][rule]["1"]
        return right / (right + wrong)


def fitted(counts: dict[str, int]) -> Model:
    """Expectation-maximisation over counts of vote patterns, without labels: which kind each pattern is of, then shares of kinds and the rules' rates.

    A rule that votes bad where the other rules of its kind see nothing wrong comes to say little; one that others bear out comes to outweigh
    many good votes, as those are as common on documents of that kind. An abstention is a third outcome whose rates are estimated, too.
    """
    return max((settled(counts, *start) for start in STARTS), key=lambda model: model.likelihood(counts))


def settled(counts: dict[str, int], made_for: dict, others: dict) -> Model:
    """EM from one start, which also is its prior."""
    before = [[made_for if kind == made else others for _, made, *_ in RULES] for kind in KINDS]
    model = Model(list(SHARES), before)
    for _ in range(ROUNDS if counts else 0):
        of = {p: model.posterior(p) for p in counts}
        held = [WEIGHT * len(KINDS) * SHARES[c] + sum(n * of[p][c] for p, n in counts.items()) for c in range(len(KINDS))]
        rates = []
        for c in range(len(KINDS)):
            rates.append([])
            for k in range(len(RULES)):
                seen = {v: WEIGHT * x for v, x in before[c][k].items()}
                for p, n in counts.items():
                    seen[p[k]] += n * of[p][c]
                rates[c].append({v: x / sum(seen.values()) for v, x in seen.items()})
        model = Model([x / sum(held) for x in held], rates)
    return model


def posterior(model: Model) -> Column:
    """The probability that a document is good, from its column _votes."""
    against = F.lit(0.0)
    for c in range(1, len(KINDS)):
        s = F.lit(log(model.shares[c] / model.shares[0]))
        for k in range(len(RULES)):
            v = F.substring("_votes", k + 1, 1)
            less = {x: log(model.rates[c][k][x] / model.rates[0][k][x]) for x in "012"}
            s = s + F.when(v == "1", less["1"]).when(v == "0", less["0"]).otherwise(less["2"])
        against = against + F.exp(s)
    return 1 / (1 + against)


def base_failed() -> Column:
    return (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def weighed(measures: DataFrame) -> Model:
    """Fit on the votes of all rows; at most 3 ** rules counts come to the driver."""
    return fitted({r["_votes"]: r["n"] for r in measures.groupBy("_votes").agg(F.count("*").alias("n")).collect()})


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for each row.

    Words are runs of non-space characters of the whole text. base_failed: fewer than 20 words, or over 30 % of them in repeated
    windows of eight words. Otherwise kept is the verdict of weak supervision: a good-document probability of 0.5 or more, from the
    rules' votes weighed by the rates that EM estimates from all rows' votes, without labels, for good documents and each kind of bad ones.

    Defined cases: a null text has no words and fails, as does a blank one; repeated rows are each returned, and each counts in the fit;
    an empty table gives no rows; nulls in and names of other columns change nothing. A text's words must fit one row.
    """
    scratch = Scratch(docs.sparkSession)
    columns = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    found = measured(docs.select("doc_id", F.col("text").alias("text"))).withColumn("_votes", votes())
    found = scratch.save(found.select("doc_id", *columns, base_failed().alias("base_failed"), "_votes"), "measures")
    probability = posterior(weighed(found))
    out = found.withColumn("probability", probability)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5)).drop("_votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs, whatever their names.

    Each text is measured once: rows are written with their votes to the shared folder, and read again to be filtered. Null and blank texts
    go, repeated rows go or stay together, an empty table stays empty.
    """
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["text"].alias("text"))
    found = measured(inner).select("_row", base_failed().alias("_failed"), votes().alias("_votes"))
    found = Scratch(docs.sparkSession).save(found, "measured")
    return found.where(~F.col("_failed") & (posterior(weighed(found)) >= 0.5)).select("_row.*")
