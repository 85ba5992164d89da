"""Tokens and full-text search."""

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a token is made of, as Java and the regex package name it.
INSIDE = r"\p{IsAlphabetic}\p{N}"
TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def tokenize(text) -> list[str]:
    """Lower-cased runs of letters and digits of two UTF-8 bytes or more; vowel signs and other marks that count as alphabetic are letters."""
    if not isinstance(text, str):
        return []
    return [t.lower() for t in TOKEN.findall(text) if len(t.encode()) >= 2]


def tokens(column: Column) -> Column:
    return F.transform(F.filter(F.split(column, f"[^{INSIDE}]+"), lambda t: F.octet_length(t) >= 2), F.lower)


def contains_all(column: Column, wanted: list[str]) -> Column:
    """Whether a text has all these tokens: a plain search for each, and only where it finds one, its bounds. No array is built."""
    low = F.lower(column)

    def has(token: str) -> Column:
        return low.contains(token) & low.rlike(f"(?<![{INSIDE}])\\Q{token}\\E(?![{INSIDE}])")

    return reduce(lambda a, b: a & b, map(has, dict.fromkeys(wanted)))


def postings(df: DataFrame, field: str, id_col: str = "_id") -> DataFrame:
    """The inverted index (token, id), each pair once; saved sorted by token, it answers searches by reading few row groups."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("token"), F.col(id_col).alias(id_col))


def search_postings(index: DataFrame, text: str, id_col: str = "_id") -> DataFrame:
    """Ids that all tokens of the text are posted for; counts are combined before the shuffle."""
    wanted = list(dict.fromkeys(tokenize(text)))
    return index.where(F.col("token").isin(*wanted)).groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(id_col)
