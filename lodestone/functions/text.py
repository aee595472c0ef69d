"""Full text: the tokenizer, and terms of a text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates tokens: anything neither alphabetic nor a number.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Sorted distinct terms; split first, then lower-cased."""
    return F.array_sort(F.array_distinct(F.array_remove(F.transform(F.split(text, SEPARATORS), F.lower), "")))


def terms(text: str) -> list[str]:
    """The same of a Python string, for search terms."""
    out, word = set(), []
    for c in text + " ":
        if c.isalpha() or unicodedata.category(c)[0] in "NM" and (c.isalnum() or c.isnumeric() or unicodedata.category(c)[0] == "M"):
            word.append(c)
        elif word:
            out.add("".join(word).lower())
            word = []
    return sorted(out)


def term_index(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """An inverted index: a row (term, key...) for each term of each row."""
    return df.select(F.explode(tokens(F.col(column))).alias("term"), *key)


def term_statistics(df: DataFrame, column: str) -> DataFrame:
    """How many rows hold each term, exactly."""
    return df.select(F.explode(tokens(F.col(column))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))


def search(index: DataFrame, query: str, key: list[str]) -> DataFrame:
    """Keys of the rows that hold all terms of ``query``."""
    wanted = terms(query)
    if not wanted:
        return index.select(*key).limit(0)
    met = index.where(F.col("term").isin(wanted)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return met.where(F.col("_n") == len(wanted)).select(*key)
