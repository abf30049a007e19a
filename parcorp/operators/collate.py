"""Union of corpora with different columns, corpus filters, category names, stage counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.operators.dedup import keep_first


def union_common(corpora: Sequence[DataFrame], order: str = "corpus_ord") -> DataFrame:
    """All rows of all corpora on the columns they share, with the corpus position."""
    common = [c for c in corpora[0].columns if all(c in df.columns for df in corpora)]
    parts = [
        df.select(*common).withColumn(order, F.lit(i)) for i, df in enumerate(corpora)
    ]
    return reduce(DataFrame.unionByName, parts)


def wanted_language() -> Column:
    return (
        F.col("language").isin(K.KEPT_LANGUAGES)
        & ~F.contains("langs", F.lit(K.DROPPED_LANG_MARK))
        & ~F.col("period").isin(K.DROPPED_PERIODS)
        & ~F.col("genre").isin(K.DROPPED_GENRES)
    )


def has_text() -> Column:
    return F.col("transliteration") != ""


def renamed(column: str, names: Sequence[tuple[str, str]]) -> Column:
    """The category's standard name, or itself when it has none."""
    out = F.col(column)
    for target in dict.fromkeys(new for _, new in names):
        out = F.when(F.col(column).isin([old for old, new in names if new == target]), target
                     ).otherwise(out)
    return out


def normalise(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"period": renamed("period", K.PERIOD_NAMES), "genre": renamed("genre", K.GENRE_NAMES)}
    )


def collate(corpora: Sequence[DataFrame], row_order: str, with_order: bool = False) -> DataFrame:
    """Corpora to one table (id, transliteration, period, genre), one row per id.

    `with_order` keeps (corpus_ord, row order), so that later steps still know which row
    came first. Filters come before the de-duplication: it cannot be crossed by a pushed
    filter.
    """
    df = union_common([c.na.fill("") for c in corpora])
    df = df.where(wanted_language() & has_text())
    df = df.select("id", "transliteration", "period", "genre", "corpus_ord", row_order)
    df = keep_first(df, ["id"], ["corpus_ord", row_order])
    order = ["corpus_ord", row_order] if with_order else []
    return normalise(df.select("id", "transliteration", "period", "genre", *order))


def stage_counts(df: DataFrame, stages: Sequence[tuple[str, Column]], row_id: str = "id") -> DataFrame:
    """Rows left after each filter, and distinct ids at the end, from one aggregate."""
    passed, aggs = F.lit(True), []
    for name, condition in stages:
        passed = passed & condition
        aggs.append(F.count_if(passed).alias(name))
    aggs.append(F.count_distinct(F.when(passed, F.col(row_id))).alias("distinct_ids"))
    names = [name for name, _ in stages] + ["distinct_ids"]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in names])
    return row.select(F.inline(pairs))
