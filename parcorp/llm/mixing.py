"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.llm.common import written
from parcorp.operators.ranking import running_total

BLOCK_ROWS = 16
BUCKET_ROWS = 2_000
CHUNK = 512  # slots that are gathered in one array


def default_weights(counts: dict[str, int], flat: float = 0.7, top: int = 50) -> dict[str, int]:
    """Weights that grow as the count to the power `flat`; the largest is `top`."""
    most = max(counts.values(), default=1)
    return {s: max(1, round(top * (n / most) ** flat)) for s, n in counts.items()}


def schedule(spark: SparkSession, blocks: dict[int, int], weights: dict[int, int]) -> DataFrame:
    """(slot, src, block): which block (from 0) of which source fills each slot.

    `blocks` and `weights` hold whole numbers by source number. The schedule goes in rounds
    of as many slots as the weights add up to. In each, a source has a quota of as many
    blocks as its weight, or in its last round what it has left; the others then share the
    round in proportion to their weights. With quota q in a round of Q slots, block i of a
    source is released at floor(i Q / q) and due at ceil((i + 1) Q / q). Each slot goes to the released block that is due first, ties to the
    smaller source number. So after any number of slots every source has the floor or the
    ceiling of its share: it is off by less than one block. Shares are whole at the end of a
    round, so rounds do not depend on each other: each is one row, scheduled by a fold over
    its slots.

    Sources of equal quota have equal releases and due times, so they form a queue of which
    only the head can be next: block i of the first, of the second, …, then block i + 1 of the
    first. The fold compares the heads of the queues, as many as there are different quotas.
    """
    src = sorted(s for s in blocks if blocks[s] > 0)
    if any(weights[s] <= 0 for s in src):
        raise ValueError("weights must be positive")
    if not src:
        return spark.createDataFrame([], "slot bigint, src bigint, block bigint")
    sources = spark.createDataFrame([(s, blocks[s], weights[s]) for s in src], "s bigint, n bigint, w bigint")
    zero = F.lit(0).cast("bigint")
    active = sources.select("s", "n", "w", F.explode(
        F.sequence(zero, F.ceil(F.col("n") / F.col("w")) - 1)).alias("r"))
    base = F.col("w") * F.col("r")
    active = active.select("r", "s", base.alias("base"), F.least("w", F.col("n") - base).alias("q"))
    queues = active.groupBy("r", "q").agg(F.sort_array(F.collect_list(F.struct("s", "base"))).alias("members"))
    rounds = queues.groupBy("r").agg(
        F.sum(F.col("q") * F.size("members")).alias("length"),
        F.sort_array(F.collect_list(F.struct("q", F.size("members").cast("bigint").alias("m"), "members"))).alias("queues"))
    rounds = written(rounds, "mix-rounds")
    width = len(f"{max(-(-blocks[s] // weights[s]) for s in src):x}")
    rounds = rounds.withColumn("_hex", F.lpad(F.lower(F.hex("r")), width, "0"))
    rounds = running_total(rounds, F.col("length"), "_hex", "_end", tie=["r"], digits=min(3, width))

    def step(acc: Column, slot: Column) -> Column:
        def offer(x: Column, j: Column) -> Column:
            k = F.get(acc["taken"], j)
            i = F.floor(k / x["m"])
            ready = (i < x["q"]) & (F.floor(i * F.col("length") / x["q"]) <= slot)
            return F.when(ready, F.struct(
                F.ceil((i + 1) * F.col("length") / x["q"]).alias("due"),
                F.get(x["members"], (k % x["m"]).cast("int"))["s"].alias("s"), j.alias("j")))

        best = F.array_min(F.transform("queues", offer))["j"]
        queue, k = F.get(F.col("queues"), best), F.get(acc["taken"], best)
        member = F.get(queue["members"], (k % queue["m"]).cast("int"))
        return F.struct(
            F.transform(acc["taken"], lambda c, j: c + (j == best).cast("bigint")).alias("taken"),
            F.concat(acc["picks"], F.array(F.struct(
                member["s"].alias("src"), (member["base"] + F.floor(k / queue["m"])).alias("block"),
            ))).alias("picks"),
        )

    none = F.expr("cast(array() as array<struct<src:bigint,block:bigint>>)")
    begin = F.struct(F.transform("queues", lambda _: zero).alias("taken"),
                     F.expr("cast(array() as array<array<struct<src:bigint,block:bigint>>>)").alias("parts"))

    def chunk(acc: Column, c: Column) -> Column:
        first = c * CHUNK
        done = F.aggregate(
            F.sequence(first, F.least(first + CHUNK, F.col("length")) - 1),
            F.struct(acc["taken"].alias("taken"), none.alias("picks")), step)
        # bound once: the fold over the chunk must not run twice
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d["taken"].alias("taken"), F.concat(acc["parts"], F.array(d["picks"])).alias("parts"))), 1)

    chunks = F.sequence(zero, F.floor((F.col("length") - 1) / CHUNK))
    picks = F.flatten(F.aggregate(chunks, begin, chunk)["parts"])
    return rounds.select((F.col("_end") - F.col("length")).alias("start"), F.posexplode(picks).alias("i", "p")).select(
        (F.col("start") + F.col("i")).alias("slot"), "p.src", "p.block")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS,
        seed: int = 42, row_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(id, source, block, slot, position) for every row: its place in the mixture.

    The rows of a source are put in a random order that depends on `seed` and the ids,
    dealt into blocks, and the blocks are interleaved by `schedule`. Every row is placed
    once; the last block of a source may be short. Weights are whole numbers per source,
    by default `default_weights`. A null source counts as the empty name. Rows with equal
    ids, and rows without one, are all placed, in any order among each other. No rows, no places.

    What reaches the driver is one row per source, however many there are.
    """
    name = F.coalesce(F.col(source), F.lit(""))
    slim = docs.select(F.col(row_id).alias("id"), name.alias("_s"))
    counts = {r["_s"]: r.n for r in slim.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    weights = weights if weights is not None else default_weights(counts)
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    number = {s: i for i, s in enumerate(sorted(counts))}
    spark = docs.sparkSession
    plan = schedule(
        spark, {number[s]: -(-n // block_rows) for s, n in counts.items()},
        {number[s]: weights[s] for s in counts},
    )
    names = spark.createDataFrame([(s, i, counts[s]) for s, i in number.items()], "_s string, src bigint, n bigint")
    plan = written(plan, "mix-schedule")
    # blocks stand one after the other in the order of their slots; the last of a source may be short
    blocks = sum(-(-n // block_rows) for n in counts.values())
    width = len(f"{blocks:x}")
    sized = plan.join(names.select("src", "n"), "src").withColumn(
        "rows", F.least(F.lit(block_rows), F.col("n") - F.col("block") * block_rows))
    sized = sized.withColumn("_hex", F.lpad(F.lower(F.hex("slot")), width, "0"))
    ends = running_total(sized, F.col("rows"), "_hex", "_end", tie=["slot"], digits=min(3, width))
    plan = written(ends.select("src", "block", "slot", (F.col("_end") - F.col("rows")).alias("first")), "mix-places")

    rows = sum(counts.values())
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    # rows without an id are told apart by where they lie, so that they do not share a bucket
    own = F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))
    keyed = slim.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), own))))
    ranked = running_total(keyed, F.lit(1).cast("bigint"), "_key", "_rank", ["_s"], ["id"],
                           names.select("_s", "src"), digits)
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn(
        "block", F.floor(F.col("_rank") / block_rows))
    placed = ranked.join(plan, ["src", "block"])
    return placed.select(F.col("id").alias(row_id), F.col("_s").alias(source), "block", "slot",
                         (F.col("first") + F.col("_rank") % block_rows).alias("position"))
