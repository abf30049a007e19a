"""Exact de-duplication by whole normalised text, safe against huge groups of copies."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp.llm.common import written

SALTS = 16


def normalised(text: Column) -> Column:
    """A-Z to lower case, nothing else; null becomes empty. Plain ASCII takes the short way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row (digest, text, keep, n) per distinct text of `rows` (digest, text, id).

    Three steps, the full text being part of the key in each: every task combines its own
    rows; tasks of one salt merge; the salts' winners combine. A text held by a third of
    all rows sends one row per task to the second step and one per salt to the third.
    The salt is the task's number, so it never takes the rows of one task apart.
    """
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "text").agg(
        F.max("id").alias("keep"), F.count("*").alias("n")
    )
    return merged.groupBy("digest", "text").agg(
        F.max("keep").alias("keep"), F.sum("n").alias("n")
    )


def exact_groups(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", salts: int = SALTS,
    digest=sha256,
) -> DataFrame:
    """(row, digest, keep, size, kept) for every row; `row` holds all columns of `docs`.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest id
    stays. Null texts equal empty ones. Rows that repeat an id and its text are counted
    one by one and share their decision. A null id never wins against another id; a group
    of null ids only keeps null. An empty table gives an empty result.

    Texts that share a digest without being equal are told apart by the text itself.
    """
    body = normalised(F.col(text))
    rows = docs.select(F.col(row_id).alias("id"), body.alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    best = winners(rows, salts)
    slim = written(best.select("digest", "keep", "n"), "exact-winners")
    several = slim.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")

    left = docs.select(F.struct("*").alias("row"), digest(body).alias("digest"), F.col(row_id).alias("id"), body.alias("t"))
    groups = slim.where("n > 1").join(several, "digest", "left_anti")
    groups = groups.select(F.col("digest").alias("d"), F.col("keep").alias("k"), "n")
    if several.isEmpty():
        out = left.drop("t").join(groups, F.col("digest") == F.col("d"), "left")
    else:  # digests shared by unequal texts: their rows are matched by text
        exact = best.join(several, "digest", "left_semi").select(
            F.col("digest").alias("d2"), F.col("text").alias("t2"), F.col("keep").alias("k2"), F.col("n").alias("n2"))
        same = (F.col("digest") == F.col("d2")) & (F.col("t") == F.col("t2"))
        out = (
            left.join(groups, F.col("digest") == F.col("d"), "left").join(exact, same, "left")
            .withColumn("k", F.coalesce("k2", "k")).withColumn("n", F.coalesce("n2", "n"))
        )
    out = out.withColumn("size", F.coalesce("n", F.lit(1)).cast("bigint"))
    out = out.withColumn("keep", F.when(F.col("size") > 1, F.col("k")).otherwise(F.col("id")))
    return out.select("row", "digest", "keep", "size", F.col("id").eqNullSafe(F.col("keep")).alias("kept"))
