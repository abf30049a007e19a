"""Tables of finished work that are joined, over and over, by id: bucketed by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def done_table(spark, name: str, path: str, schema: str, row_id: str = "id", buckets: int = BUCKETS) -> str:
    """Name the table at `path` in this session's catalog, whether or not it has rows yet.

    Its files are bucketed and sorted by id; a large table wants buckets of some 100 MB.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet "
              f"CLUSTERED BY (`{row_id}`) SORTED BY (`{row_id}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").where("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def add_done(df: DataFrame, name: str, row_id: str = "id") -> None:
    """Append finished rows: one file per bucket and call."""
    spark = df.sparkSession
    columns = spark.table(name).columns
    df.select(*columns).repartition(_buckets(spark, name), row_id).write.insertInto(name)


def still_to_do_bucketed(work: DataFrame, name: str, row_id: str = "id") -> DataFrame:
    """Rows of `work` whose id the done table does not have.

    Only the work is dealt out, to the buckets of the done table; that is read in place, and
    only its ids.
    """
    spark = work.sparkSession
    dealt = work.repartition(_buckets(spark, name), row_id)
    return dealt.join(spark.table(name).select(row_id), row_id, "left_anti")
