"""Text -> wordforms -> morphemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K


def wordforms(text: Column) -> Column:
    """Blank-separated wordforms; newline and ellipsis are wordforms of their own."""
    padded = F.replace(
        F.replace(text, F.lit("\n"), F.lit(" \n ")), F.lit("..."), F.lit(" ... ")
    )
    words = F.split(padded, " ")
    for skipped in ("", "|", ".|"):
        words = F.array_remove(words, skipped)
    return words


def expanded_number(wf: Column) -> Column:
    """A bare number, or one before the first hyphen, gets its unit reading."""
    units = F.create_map(*[F.lit(x) for kv in K.NUMBER_READINGS.items() for x in kv])
    head = F.substring_index(wf, "-", 1)
    reading = F.try_element_at(units, head)
    rest = F.substr(wf, F.length(head) + 1)
    return F.coalesce(F.concat(reading, rest), wf)


# a {determinative}, or what lies between two of them (an unclosed brace is plain text)
PIECE = r"\{[^}]*+\}|(?:[^{]|\{(?![^}]*\}))++"
# a hyphen that is not inside parentheses
MORPHEME_BREAK = r"-(?![^(]*\))"


def morphemes(wf: Column) -> Column:
    """Pieces split at blanks, then at hyphens; special tokens stay whole.

    Only forms with a hyphen or brace, or starting with a digit, go through the splits.
    """
    starts_with_digit = F.ascii(wf).between(48, 57)
    number = F.when(starts_with_digit, expanded_number(wf)).otherwise(wf)
    pieces = F.when(
        F.contains(wf, F.lit("}")), F.regexp_extract_all(number, F.lit(PIECE), F.lit(0))
    ).otherwise(F.array(number))
    words = F.flatten(F.transform(pieces, lambda p: F.split(p, " ")))
    split = F.flatten(F.transform(words, lambda w: F.when(
        F.contains(w, F.lit(")")), F.split(w, MORPHEME_BREAK)).otherwise(F.split(w, "-"))))
    plain = ~(starts_with_digit | F.contains(wf, F.lit("-")) | F.contains(wf, F.lit("{")))
    return F.when(plain | wf.isin(K.PASS_THROUGH), F.array(wf)).otherwise(
        F.array_remove(split, "")
    )


def tokens(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(*keep, wpos, mpos, special, morpheme); a text without any keeps one null row.

    The arrays are columns before they are exploded: an expression inside the generator
    itself would be interpreted row by row instead of compiled.
    """
    words = df.select(*keep, wordforms(F.col(text)).alias("_ws"))
    words = words.select(*keep, F.posexplode_outer("_ws").alias("wpos", "wf"))
    words = words.select(
        *keep, "wpos", F.col("wf").isin(K.PASS_THROUGH).alias("special"),
        morphemes(F.col("wf")).alias("_ms"),
    )
    return words.select(*keep, "wpos", "special", F.posexplode_outer("_ms").alias("mpos", "morpheme"))


def distinct_morphemes(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(*by, morpheme, n): the morphemes of all texts with their number of places, special
    wordforms left out.

    Wordforms are counted first, so that only distinct ones are split.
    """
    words = df.select(*by, wordforms(F.col(text)).alias("_ws"))
    words = words.select(*by, F.explode_outer("_ws").alias("wf")).where("wf IS NOT NULL")
    words = words.groupBy(*by, "wf").agg(F.count("*").alias("n")).where(~F.col("wf").isin(K.PASS_THROUGH))
    found = words.select(*by, "n", morphemes(F.col("wf")).alias("_ms"))
    found = found.select(*by, "n", F.explode_outer("_ms").alias("morpheme")).where("morpheme IS NOT NULL")
    return found.groupBy(*by, "morpheme").agg(F.sum("n").alias("n"))
