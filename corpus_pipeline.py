"""From documents to tokens: five stages, each written as Parquet and read again as the next one's documents."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, langid, minhash, mixing, quality
from skein.llm.common import Scratch
from skein.llm.queries import tokenizer_path


#: What the last stage's result reads. The caller has written that result when the next stage begins.
_read: list = []


def stage(work: Callable) -> Callable:
    """work(docs), after the tables of the stage before are dropped."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done()
        known = list(Scratch.open)
        out = work(docs)
        _read.extend(s for s in Scratch.open if s not in known)
        return out

    return run


def done() -> None:
    Scratch.spent(_read)
    _read.clear()


@stage
def language(docs: DataFrame) -> DataFrame:
    """Drops documents of no language that the labels teach: null ones, those without a letter, and those of a score below 0.3."""
    return langid.keep_known(docs)


@stage
def rules(docs: DataFrame) -> DataFrame:
    """Drops documents that fail the base rules or the weighed votes."""
    return quality.keep_good(docs)


@stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps one document of each group (five-word shingles, 80 %): one row of the smallest doc_id."""
    return minhash.one_of_each(docs)


@stage
def mix(docs: DataFrame) -> DataFrame:
    """Repeats and drops documents so that sources come near their target shares."""
    return mixing.mixed(docs)


@stage
def tokens(docs: DataFrame) -> DataFrame:
    """The token ids of every document of the mix, their number, and digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, tokenizer_path(), keep_ids=True)


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again. What a stage read goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, work in STAGES:
        scratch = Scratch(spark)
        docs = scratch.save(work(spark, docs, sf_dir), name)
        done()
        Scratch.spent(before)
        before = [scratch]
    return docs
