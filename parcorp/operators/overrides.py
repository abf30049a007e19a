"""Curated per-text corrections held in a table (step, id, find, repl)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_overrides(
    df: DataFrame, overrides: DataFrame, step: str, text: str, row_id: str = "id"
) -> DataFrame:
    """Replace `find` by `repl` in the texts the step's overrides name.

    Several overrides of one text are applied in the order of `find`. The left join has
    no hint: the planner broadcasts the overrides only when their size allows it.
    """
    fixes = (
        overrides.where(F.col("step") == step)
        .groupBy(F.col("id").alias(row_id))
        .agg(F.sort_array(F.collect_set(F.struct("find", "repl"))).alias("_fixes"))
    )
    fixed = F.aggregate(
        F.coalesce("_fixes", F.array().cast("array<struct<find:string,repl:string>>")),
        F.col(text), lambda acc, p: F.replace(acc, p["find"], p["repl"]),
    )
    return df.join(fixes, row_id, "left").withColumn(text, fixed).drop("_fixes")
