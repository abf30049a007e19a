"""Nested annotated-text records to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import strip


def genre_list(genres: Column) -> Column:
    """Names joined by commas; `Unknown` only where there is no genre at all."""
    joined = F.array_join(F.transform(genres, lambda g: g["genre"]["genre"]), ", ")
    return F.when(F.size(genres) > 0, joined).otherwise(F.lit("Unknown"))


def period_name(period: Column) -> Column:
    return F.coalesce(period["period"], F.lit("Unknown"))


def header_name(inscription: Column) -> Column:
    """What follows the first & in the first word; null when there is none."""
    word = F.split(inscription, " ", 2)[0]
    return F.get(F.split(word, "&", 2), F.lit(1))


def body_lines(inscription: Column) -> Column:
    """The lines after the language mark."""
    mark = F.lit(K.ATF_LANGUAGE_MARK)
    body = F.substr(inscription, F.locate(K.ATF_LANGUAGE_MARK, inscription) + F.length(mark))
    return F.split(body, "\n")


def translation_lines(lines: Column) -> Column:
    prefix = K.ATF_TRANSLATION_PREFIX
    found = F.filter(lines, lambda l: F.startswith(l, F.lit(prefix)))
    cut = F.transform(found, lambda l: strip(F.substr(l, F.lit(len(prefix) + 1))))
    return F.array_join(cut, "\n")


def text_lines(lines: Column) -> Column:
    other = F.filter(lines, lambda l: ~F.startswith(l, F.lit(K.ATF_TRANSLATION_PREFIX)))
    return F.array_join(F.transform(other, strip), "\n")


def parsed(records: DataFrame) -> DataFrame:
    """Records with the language mark to (id, name, transliteration, translation, …)."""
    atf = F.coalesce(F.col("inscription.atf"), F.lit(""))
    df = records.where(F.contains(atf, F.lit(K.ATF_LANGUAGE_MARK)))
    df = df.withColumn("_lines", body_lines(F.col("inscription.atf")))
    return df.select(
        F.coalesce("id", F.lit("")).alias("id"),
        header_name(F.col("inscription.atf")).alias("name"),
        text_lines(F.col("_lines")).alias("transliteration"),
        translation_lines(F.col("_lines")).alias("translation"),
        period_name(F.col("period")).alias("period"), genre_list(F.col("genres")).alias("genre"),
    )
