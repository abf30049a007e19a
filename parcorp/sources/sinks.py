"""Writers. No writer gathers a partition value in one task: each task writes its own
rows of every value, so a genre that holds a third of the rows is written by all tasks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000


def _writer(df: DataFrame, mode: str = "overwrite"):
    return df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)


def table_parquet(df: DataFrame, path: str) -> None:
    _writer(df).parquet(path)


def table_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV that keeps empty strings apart from nulls and newlines in texts."""
    _writer(df).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def partition_name(column: Column) -> Column:
    return F.replace(column, F.lit("/"), F.lit(""))


def by_genre(df: DataFrame, path: str, full_path: str) -> None:
    """One folder per genre, and the whole table."""
    table_parquet(df, full_path)
    full = df.sparkSession.read.parquet(full_path)  # computed once
    named = full.withColumn("genre_name", partition_name(F.col("genre")))
    _writer(named).partitionBy("genre_name").parquet(path)


def rewrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions that `df` has rows of; the files of all others stay as they are.
    Run again, it leaves the same table."""
    _writer(df).option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def rewrite_genres(df: DataFrame, path: str) -> None:
    """Replace the folders of the genres in `df` in a table of `by_genre`."""
    rewrite_partitions(df.withColumn("genre_name", partition_name(F.col("genre"))), path, "genre_name")


def by_split(df: DataFrame, path: str, *more: str) -> None:
    """One folder per split (and per further column), which leave the payload."""
    _writer(df).partitionBy("split", *more).parquet(path)


def lookup_json(df: DataFrame, path: str) -> None:
    """A lookup as one JSON object per key, in as many files as there are tasks."""
    _writer(df).json(path)


def nested_counts(df: DataFrame) -> DataFrame:
    """(glyph, readings): a map reading -> n per glyph, from (glyph, reading, n).

    For sign lists, whose glyphs have a few dozen readings; long tables stay long.
    """
    entries = F.sort_array(F.collect_list(F.struct("reading", "n")))
    return df.groupBy("glyph").agg(F.map_from_entries(entries).alias("readings"))


def result_records(df: DataFrame, path: str) -> None:
    """Results keyed by id, appended as JSON records."""
    _writer(df, "append").json(path)


def result_batch(df: DataFrame, path: str, batch: int) -> None:
    """Results of one batch, in a folder of its own: a batch that is run again replaces what
    its first attempt left, so that no record is there twice."""
    _writer(df).json(f"{path}/batch={batch}")


def line_pairs(df: DataFrame, pred: str, label: str, path: str) -> None:
    """Two lines per row: the prediction, then the label."""
    _writer(df.select(F.concat_ws("\n", pred, label).alias("value"))).text(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """The table saved at `path`, or what an earlier run saved there."""
    spark = df.sparkSession
    try:
        spark.read.schema("value string").text(f"{path}/_SUCCESS")
    except AnalysisException:  # there is no finished table
        table_parquet(df, path)
    return spark.read.parquet(path)
