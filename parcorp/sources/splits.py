"""Large files of nested or quoted records, read by many tasks.

A file is read as units that end with a separator: lines of a CSV file, what stands between
the commas of a JSON file. A unit changes the state of a scanner that would read the file
from its start: whether it is inside quotes, and how deep the brackets are. The change is a
function of the state before, small enough to be combined before that state is known: one
bit for the quotes, and a number of brackets for either case. So every split of a file is
reduced to its own change, these are added up along the file, and each split then finds on its
own where records begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.session import materialised, sized

SPLIT = ("file", "block")


def units(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, i, value): what stands between the separators, numbered in order within
    each split (`block` is its first byte). A unit belongs to the split in which it starts."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value")


def quotes(value: Column) -> Column:
    """How many double quotes a text holds."""
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def csv_changes(rows: DataFrame) -> DataFrame:
    """Quotes open and close, doubled ones leave the state; brackets mean nothing."""
    none = F.lit(0).cast("bigint")
    return rows.withColumns({"flips": quotes(F.col("value")) % 2, "out": none, "in": none})


def json_changes(rows: DataFrame) -> DataFrame:
    """`flips`: an odd number of quotes that are not escaped; `out`, `in`: brackets opened
    minus closed outside strings, if the unit starts outside or inside a string.

    Escapes stand in strings only, and none of them ends in a comma, so no unit starts
    between a backslash and its character.
    """
    plain = F.regexp_replace("value", r"\\.", "")
    parts = F.split(plain, '"', -1)

    def depth(first: int) -> Column:
        outside = F.array_join(F.filter(parts, lambda _, k: k % 2 == first), "")
        opened = F.length(outside) - F.length(F.translate(outside, "[{", ""))
        return (opened - (F.length(outside) - F.length(F.translate(outside, "]}", "")))).cast("bigint")

    return rows.withColumns({"flips": (F.size(parts) - 1) % 2, "out": depth(0), "in": depth(1)})


def records(rows: DataFrame, separator: str, level: int = 0) -> DataFrame:
    """(file, block, record, opening, text): the units of each record put together.

    A record begins at the start of a file and after every separator that stands outside
    quotes in `level` open brackets; it belongs to the split in which it begins (`record` counts
    from 1 there; `opening`: the first of its file). One that goes on over further splits
    gets their units as well.

    The texts are shuffled once, by split. What is joined from elsewhere has one row per
    split, and the units that continue a record of an earlier split.
    """
    run = W.partitionBy(*SPLIT).orderBy("i")
    before, upto = run.rowsBetween(W.unboundedPreceding, -1), run.rowsBetween(W.unboundedPreceding, 0)
    along = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")

    def change(inside: Column) -> Column:
        return F.when(inside == 0, F.col("out")).otherwise(F.col("in"))

    # 1. what each split changes, and the state in which it begins
    inner = rows.withColumn("inside", F.coalesce(F.sum("flips").over(before), zero) % 2)
    totals = inner.groupBy(*SPLIT).agg(
        (F.sum("flips") % 2).alias("flips"), F.sum(change(F.col("inside"))).alias("out"),
        F.sum(change(1 - F.col("inside"))).alias("in"))
    totals = materialised(totals)
    begins = totals.withColumn("s_inside", F.coalesce(F.sum("flips").over(along), zero) % 2)
    begins = begins.withColumn("s_depth", F.coalesce(F.sum(change(F.col("s_inside"))).over(along), zero))
    begins = begins.withColumn("s_first", F.count("*").over(along) == 0)
    begins = sized(begins.select(F.col("file").alias("s_file"), F.col("block").alias("s_block"), "s_inside", "s_depth", "s_first"))
    here = (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block"))

    # 2. where records begin
    numbered = rows.join(begins, here)
    numbered = numbered.withColumn("flipped", F.col("s_inside") + F.sum("flips").over(upto))
    inside = (F.col("flipped") - F.col("flips")) % 2
    numbered = numbered.withColumn("deep", F.col("s_depth") + F.sum(change(inside)).over(upto))
    ends = (F.col("flipped") % 2 == 0) & (F.col("deep") == level)
    start = F.coalesce(F.lag(ends).over(run), F.col("s_first") | ((F.col("s_inside") == 0) & (F.col("s_depth") == level)))
    numbered = numbered.withColumn("start", start.cast("bigint")).withColumn("record", F.sum("start").over(upto))

    # 3. units before the first start of a split go to the last record begun before it
    starts = numbered.groupBy(*SPLIT).agg(
        F.min(F.when(F.col("record") > 0, F.col("i"))).alias("first_i"), F.max("record").alias("n"))
    starts = materialised(starts)
    last = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(along)
    owners = starts.withColumn("owner", last).where("owner IS NOT NULL")
    owners = sized(owners.select(F.col("file").alias("s_file"), F.col("block").alias("s_block"), "first_i", "owner"))
    heads = rows.join(owners, here & (F.col("first_i").isNull() | (F.col("i") < F.col("first_i"))))

    def together(sort: list[str]) -> Column:
        return F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(*sort, "value"))), lambda x: x["value"]), separator)

    tails = heads.groupBy("file", "owner.block", "owner.n").agg(together(["block", "i"]).alias("tail"))
    tails = tails.select(F.col("file").alias("t_file"), F.col("block").alias("t_block"), F.col("n").alias("t_n"), "tail")
    pieces = numbered.where("record > 0").groupBy(*SPLIT, "record").agg(
        together(["i"]).alias("text"), F.first("s_first").alias("s_first"))
    same = (F.col("file") == F.col("t_file")) & (F.col("block") == F.col("t_block")) & (F.col("record") == F.col("t_n"))
    return pieces.join(materialised(tails), same, "left").select(
        *SPLIT, "record", (F.col("s_first") & (F.col("record") == 1)).alias("opening"),
        F.concat_ws(separator, "text", "tail").alias("text"))
