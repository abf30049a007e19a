"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lookups above this size are joined by shuffle, not broadcast.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int = 8, app: str = "parcorp") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # methods above 8000 bytes are never compiled natively by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for checkpoints and intermediate tables that all executors reach.

    The cluster names it in `spark.checkpoint.dir`. Where that is unset it is `folder`, or
    a temporary folder if the session is a single process on one machine. What is written
    there is left to the caller to clean up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named is None and folder is None and (set_before := spark.sparkContext.getCheckpointDir()):
        named = set_before.rsplit("/", 1)[0]  # another session of this application chose it
    if named is None:
        if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = folder or tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint that outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a compressed table in the shared folder: for rows that
    are read several times, column by column, and take more room than a lookup."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes, whatever the width of texts and arrays: the length
    of its values as text and a fixed cost per value."""
    row = F.lit(16).cast("bigint")
    for name in df.columns:
        row = row + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + 8
    return row


def size_in_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take, summed by the tasks."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the table is small enough to broadcast, by its measured size."""
    return size_in_bytes(df) <= limit


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, computed once, with a broadcast hint if its measured size allows one."""
    df = materialised(df)
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    The text operators are bound by the processor, so one big row group must not keep
    them on one core. A table with enough splits (any large one) is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
