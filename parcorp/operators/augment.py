"""The data work around a translation service: prompts, length gate, resume, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.sequences import encoded_length
from parcorp.functions.text import remove_all, seeded_md5, strip
from parcorp.operators.joins import still_to_do
from parcorp.operators.ranking import running_total


def prompt_text(text: Column) -> Column:
    t = remove_all(text, K.LAYOUT_TOKENS)
    t = F.replace(t, F.lit(K.UNK), F.lit("..."))
    t = F.regexp_replace(t, r"\n{2,}+", "\n")
    t = F.regexp_replace(t, r"(?<! ) ++\.\.\. *+|\.\.\. *+", "...")
    return strip(t)


def prompts(df: DataFrame, header: str, text: str = "transliteration",
            limit: int = K.MAX_PAIR_LEN) -> DataFrame:
    """Add the cleaned text, its encoded length and the prompt (empty when too long)."""
    df = df.withColumn(text, prompt_text(F.col(text)))
    df = df.withColumn("n_tokens", encoded_length(F.col(text)).cast("bigint"))
    prompt = F.concat(F.lit(header + "INPUT:\n"), F.col(text), F.lit("\n\nOUTPUT:\n"))
    return df.withColumn("prompt", F.when(F.col("n_tokens") > limit, "").otherwise(prompt))


def pending_prompts(df: DataFrame, done: DataFrame, header: str, row_id: str = "id") -> DataFrame:
    """Prompts for the ids that have no result yet."""
    return prompts(still_to_do(df, done, row_id), header)


def non_empty_translations(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce("translation", F.lit("")) != "")


def running_usage(df: DataFrame, usage: str, seed: int = 2, row_id: str = "id") -> DataFrame:
    """Add `total`: the usage so far, in the seeded order of processing."""
    keyed = df.withColumn("_key", seeded_md5(seed, F.col(row_id)))
    return running_total(keyed, F.col(usage), "_key", "total", tie=[row_id]).drop("_key")
