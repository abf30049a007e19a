"""Counts and distributions. Everything aggregates in the map tasks first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import chars, exploded, remove_all


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, value, n) for several columns in one pass and one shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    rows = df.select(*by, F.inline(pairs))
    return rows.groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, then a `Total` row over all values."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    # from the same counts: their shuffle is run once and read twice
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))
    total = total.select(F.lit("Total").alias("value"), "n")
    return top.unionByName(total)


def glyph_text(text: Column) -> Column:
    """The text without special tokens and blanks."""
    return remove_all(text, [*K.PASS_THROUGH, " "])


def glyph_total(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.sum(F.length(glyph_text(F.col(text))).cast("bigint")).alias("total_glyphs"))


def alphabet(df: DataFrame, text: str) -> DataFrame:
    """(char, n_texts): the distinct characters besides special tokens.

    Characters are made distinct within each text before anything leaves the row.
    """
    plain = remove_all(F.col(text), K.VOCAB_SPECIALS)
    found = exploded(df, [], F.array_distinct(chars(plain)), "char")
    return found.groupBy("char").agg(F.count("*").alias("n_texts"))


def length_histogram(df: DataFrame, text: str) -> DataFrame:
    n = F.length(remove_all(F.col(text), K.VOCAB_SPECIALS))
    # Names and bounds of the buckets
    bucket = (
        F.when(n <= 64, "0-64").when(n <= 128, "64-128").when(n <= 256, "128-256")
        .otherwise("mt256")
    )
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _tokens(text: str, unit: str) -> Column:
    if unit == "glyph":
        return chars(glyph_text(F.col(text)))
    plain = F.regexp_replace(remove_all(F.col(text), K.PASS_THROUGH), r"(?U)\s+", " ")
    return F.array_remove(F.split(plain, " "), "")


def token_frequencies(df: DataFrame, text: str, unit: str = "word") -> DataFrame:
    """(token, n), tokens being white-space separated words or single glyphs."""
    return (
        exploded(df, [], _tokens(text, unit), "token")
        .groupBy("token").agg(F.count("*").alias("n"))
    )


def token_summary(df: DataFrame, text: str, unit: str = "word") -> DataFrame:
    """Texts, total tokens and mean tokens per text."""
    n = F.size(_tokens(text, unit)).cast("bigint")
    return df.agg(
        F.count("*").alias("n_texts"), F.sum(n).alias("total_tokens"),
        F.round(F.avg(n), 6).alias("mean_tokens"),
    )
