"""Seeded shuffle, exact stratified split, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp import constants as K
from parcorp.functions.text import seeded_md5
from parcorp.operators.ranking import bucket_digits, positions, ranked_over_tasks
from parcorp.session import materialised, sized


def shuffled(df: DataFrame, seed: int, row_id: str = "id") -> DataFrame:
    """Rows in a random order that depends on the seed and the ids only."""
    return df.orderBy(seeded_md5(seed, F.col(row_id)), row_id)


def shuffled_positions(df: DataFrame, seed: int, row_id: str = "id") -> DataFrame:
    """The place of each row in that order, without sorting all rows in one go."""
    keyed = df.withColumn("_key", seeded_md5(seed, F.col(row_id)))
    return positions(keyed, "_key", tie=[row_id]).drop("_key")


def oversample(df: DataFrame, majority: Column, factor: int = K.OVERSAMPLING) -> DataFrame:
    """Majority rows once, all others `factor` times, in one scan; `copy` counts from 1."""
    times = F.when(majority, F.lit(1)).otherwise(F.lit(factor))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def _shares(strata: DataFrame, n: str, draws: int, total: int, out: str) -> DataFrame:
    """Share `draws` over the strata by largest remainder, ties by stratum name."""
    product = F.col(n).cast("decimal(38,0)") * F.lit(draws).cast("decimal(19,0)")
    whole = F.lit(max(total, 1)).cast("decimal(19,0)")  # nothing may be left to draw from
    strata = strata.withColumn("_rem", (product % whole).cast("bigint"))
    strata = strata.withColumn("_floor", ((product - F.col("_rem")) / whole).cast("bigint"))
    strata = ranked_over_tasks(strata, [F.desc("_rem"), "_s"], "_rank")
    spare = draws - strata.agg(F.coalesce(F.sum("_floor"), F.lit(0))).first()[0]
    extra = (F.col("_rank") <= spare).cast("bigint")
    return strata.withColumn(out, F.col("_floor") + extra).drop("_rem", "_floor", "_rank")


def split_quotas(strata: DataFrame, test_every: int = 20, validation_every: int = 19) -> DataFrame:
    """Rows per stratum (_s, n) to test and validation sizes: 1/20, then 1/19 of the rest.

    The total test and validation sizes are rounded up. Strata are sorted by their
    remainders over all tasks; only totals reach the driver.
    """
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    draws = -(-total // test_every)
    strata = _shares(strata, "n", draws, total, "n_test")
    strata = strata.withColumn("_left", F.col("n") - F.col("n_test"))
    strata = _shares(strata, "_left", -(-(total - draws) // validation_every), total - draws, "n_validation")
    return strata.select("_s", "n_test", "n_validation")


def stratified_split(
    df: DataFrame, stratum: str = "period", held_out: Column | None = None, seed: int = 42,
    row_id: str = "id",
) -> DataFrame:
    """Add `split`: 90/5/5 train, validation, test with exact sizes per stratum.

    Held-out rows always go to train. Within a stratum rows are ordered by a seeded digest
    of their id, which also deals them into evenly filled buckets. Counts per bucket tell
    which buckets lie before a border as a whole; only the few rows of the buckets that
    hold a border are ranked, to find the digest and id where it lies. The rows themselves
    then need one join with the buckets' borders. Ids are taken to be unique: rows that
    repeat an id go to the same split.
    """
    if held_out is None:
        held_out = F.col("genre") == K.HELD_OUT_GENRE
    key = seeded_md5(seed, F.col(row_id))
    name = F.when(~held_out, F.coalesce(F.col(stratum), F.lit("")))
    slim = df.select(F.col(row_id).alias("_id"), key.alias("_key"), name.alias("_s")).where("_s IS NOT NULL")
    slim = materialised(slim)  # read for the counts and for the ranks
    digits = bucket_digits(slim.count())
    slim = slim.withColumn("_b", F.substring("_key", 1, digits))
    counts = materialised(slim.groupBy("_s", "_b").agg(F.count("*").alias("_n")))
    quotas = split_quotas(counts.groupBy("_s").agg(F.sum("_n").alias("n")))
    before = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    borders = counts.join(quotas, "_s").withColumns({
        "_test": F.col("n_test") - F.col("_off"),
        "_held": F.col("n_test") + F.col("n_validation") - F.col("_off"),
    }).where("_held > 0").select("_s", "_b", "_n", "_test", "_held")

    def inside(column: str) -> Column:
        return (F.col(column) > 0) & (F.col(column) < F.col("_n"))

    place = F.struct("_key", "_id")
    ranked = slim.join(borders.where(inside("_test") | inside("_held")), ["_s", "_b"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_key", "_id")))
    cuts = ranked.groupBy("_s", "_b").agg(
        F.max(F.when(F.col("_rank") <= F.col("_test"), place)).alias("_cut_test"),
        F.max(F.when(F.col("_rank") <= F.col("_held"), place)).alias("_cut_held"))
    # broadcast if small enough, so that the rows are not shuffled at all
    borders = sized(borders.join(cuts, ["_s", "_b"], "left").select(
        F.col("_s").alias("_bs"), F.col("_b").alias("_bb"), "_n", "_test", "_held", "_cut_test", "_cut_held"))

    mine = F.struct(F.col("_key"), F.col(row_id).alias("_id"))

    def within(border: str, cut: str) -> Column:
        return (F.col(border) >= F.col("_n")) | ((F.col(border) > 0) & (mine <= F.col(cut)))

    rows = df.withColumns({"_key": key, "_s": name})
    same = (F.col("_s") == F.col("_bs")) & (F.substring("_key", 1, digits) == F.col("_bb"))
    split = F.when(within("_test", "_cut_test"), "test").when(within("_held", "_cut_held"), "validation").otherwise("train")
    return rows.join(borders, same, "left").withColumn("split", split).select(*df.columns, "split")
