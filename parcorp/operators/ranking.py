"""Global positions and running totals without a single-task window.

Rows are ordered by a uniform hex key (a digest of their id). Its leading digits cut
the rows into evenly filled buckets, whatever the data; each bucket is windowed on its
own and the totals of the buckets before it are added.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.session import materialised

BUCKET_DIGITS = 3  # 4096 buckets per group where the caller names no number
BUCKET_ROWS = 4096


def bucket_digits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """How many hex digits make buckets of about `per_bucket` rows out of `rows`."""
    return max(1, math.ceil(math.log(max(rows / per_bucket, 1), 16)))


def ranked_over_tasks(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """Add the 1-based position in the given order. The rows are sorted over all tasks and
    numbered within each; only the tasks' row counts reach the driver."""
    place = F.monotonically_increasing_id()  # task number, then 33 bits of position
    df = materialised(df.orderBy(*order).withColumn("_place", place))
    task, index = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = sorted(map(tuple, df.groupBy(task.alias("t")).count().collect()))
    before = itertools.accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(t, b) for (t, _), b in zip(counts, before)], "_task bigint, _before bigint")
    df = df.join(F.broadcast(offsets), task == F.col("_task"))  # one row per task
    return df.withColumn(out, index + F.col("_before") + 1).drop("_place", "_task", "_before")


def running_total(
    df: DataFrame, value: Column, key: str, out: str, group: Sequence[str] = (),
    tie: Sequence[str] = ("id",), group_info: DataFrame | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add `out`: the total of `value` up to and including the row, in order of `key`.

    `group_info` (one row per group) rides along on the small table of bucket offsets,
    so its columns reach the rows by bucket and no group, however large, is joined whole.
    """
    df = df.withColumn("_b", F.substring(key, 1, digits)).withColumn("_v", value)
    by_bucket = W.partitionBy(*group, "_b").orderBy(key, *tie)
    inner = F.sum("_v").over(by_bucket.rowsBetween(W.unboundedPreceding, 0))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    )
    info: list[str] = []
    if group_info is not None:
        info = [c for c in group_info.columns if c not in group]
        offsets = offsets.join(group_info, list(group), "left")
    rows = df.withColumn("_in", inner).alias("r")
    offsets = offsets.alias("o")
    same = F.col("r._b") == F.col("o._b")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    total = (F.col("r._in") + F.col("o._off")).alias(out)
    keep = [F.col(f"r.{c}") for c in df.columns if c not in ("_b", "_v")]
    return rows.join(offsets, same).select(*keep, total, *[F.col(f"o.{c}") for c in info])


def positions(df: DataFrame, key: str, out: str = "position", group: Sequence[str] = (),
              tie: Sequence[str] = ("id",), group_info: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position of each row in order of `key` (within `group`)."""
    return running_total(df, F.lit(1).cast("bigint"), key, out, group, tie, group_info)
