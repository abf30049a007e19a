"""Cleaning as a stream over a landing folder.

New files are cleaned once. Repeats of an id within the watermark are dropped by the
stream's state, later ones by an anti-join with what is already in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from parcorp.functions.cleaning import clean


def landing_stream(
    spark: SparkSession, path: str, schema: str | StructType, pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Rows of the files that arrive in a folder, with the time they were read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    files = reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return files.withColumn("ingested", F.current_timestamp())


def first_seen(stream: DataFrame, row_id: str = "id", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("ingested", delay).dropDuplicatesWithinWatermark([row_id])


def clean_into(
    texts: DataFrame, table: str, checkpoint: str, text: str = "transliteration",
    row_id: str = "id", **trigger,
) -> StreamingQuery:
    """Start the query that appends cleaned texts with new ids to a parquet table.

    Every micro-batch writes its own folder and a repeated batch overwrites it, so a
    batch that is run again after a failure leaves the same table.
    """
    spark = texts.sparkSession
    cleaned = clean(first_seen(texts, row_id), text, "transliteration_clean", row_id, drop_empty=True)
    cleaned = cleaned.drop("ingested")
    written = StructType([*cleaned.schema.fields, StructField("batch", LongType())])
    _ensure(spark.createDataFrame([], cleaned.schema), table)

    def write(batch: DataFrame, batch_id: int) -> None:
        # only the ids are read, and this batch's own folder (of a first attempt) is not
        done = spark.read.schema(written).parquet(table).where(F.col("batch") != batch_id)
        new = batch.join(done.select(row_id), row_id, "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = cleaned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _ensure(empty: DataFrame, table: str) -> None:
    empty.write.mode("ignore").parquet(f"{table}/batch=-1")


def cleaned_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("batch")
