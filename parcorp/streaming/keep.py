"""Keep-first de-duplication as a stream, whatever the order in which rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from parcorp.operators.dedup import keep_first


def keep_first_into(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], table: str, checkpoint: str, **trigger,
) -> StreamingQuery:
    """Start the query that keeps, by `order`, the first row of each value of `keys`.

    The state holds that row per key, across batches and restarts, for as long as the
    checkpoint lives: rows that arrive late or out of order are decided as if all had been
    there at once. A batch writes the keys whose first row it changed to a folder of its own
    and overwrites that when it is run again. `kept` reads the result.
    """
    payload = [c for c in stream.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order))
    best = stream.groupBy(*keys).agg(first.alias("_first"))
    best = best.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in stream.columns])
    stream.sparkSession.createDataFrame([], best.schema).write.mode("ignore").parquet(f"{table}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def kept(spark: SparkSession, table: str, schema: StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first rows so far: of a key that changed in several batches, the first of those."""
    fields = StructType([*schema.fields, StructField("batch", LongType())])
    return keep_first(spark.read.schema(fields).parquet(table).drop("batch"), keys, order)
