"""Best-fit packing of texts into training sequences, under conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.llm.common import with_package, written
from parcorp.session import sized

CAPACITY = 2048  # words of a bin
SHARD_ROWS = 4096  # pieces that are packed together
_WORD = r"[^\x20\x09-\x0D]+"
_BIN_BITS = 20


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, in the given order.

    Open bins are kept in order of their residual, then number, and carry one bitmap for
    the sources and duplicate clusters they hold (numbers; -1: none). The search starts at
    the first bin that is large enough and goes on to its successors until one has neither
    the piece's source nor its cluster: the tightest compatible bin. If there is none, a
    new bin is opened.
    """
    def bits(values: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """A bit for every value that occurs more than once; others cannot conflict."""
        seen, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
        wanted = (n > 1) & (seen != -1)
        number = np.where(wanted, start + np.cumsum(wanted) - 1, -1)
        return number[inverse], start + int(wanted.sum())

    source_bit, n = bits(sources, 0)
    cluster_bit, n = bits(clusters, n)
    held = np.zeros((len(sizes), n // 64 + 1), np.uint64)
    order = np.empty(0, np.int64)  # residual << _BIN_BITS | bin, ascending
    out, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        own = [(b // 64, np.uint64(1 << (b % 64))) for b in (int(source_bit[i]), int(cluster_bit[i])) if b >= 0]
        at, found, step = int(np.searchsorted(order, size << _BIN_BITS)), -1, 64
        while at < len(order):
            bins = order[at:at + step] & ((1 << _BIN_BITS) - 1)
            free = np.ones(len(bins), bool)
            for word, bit in own:
                free &= (held[bins, word] & bit) == 0
            hit = int(free.argmax())
            if free[hit]:
                found = at + hit
                break
            at, step = at + step, step * 4
        if found >= 0:
            key = int(order[found])
            residual, number = key >> _BIN_BITS, key & ((1 << _BIN_BITS) - 1)
            order = np.delete(order, found)
        else:
            residual, number = capacity, opened
            opened += 1
            if opened > 1 << _BIN_BITS:
                raise ValueError("a shard needs more bins than its numbers can name")
        out[i], offset[i] = number, capacity - residual
        for word, bit in own:
            held[number, word] |= bit
        if residual > size:
            key = (residual - size) << _BIN_BITS | number
            order = np.insert(order, np.searchsorted(order, key), key)
    return out, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, row_id: str = "doc_id", text: str = "text",
           source: str = "source") -> DataFrame:
    """(id, source, cluster, piece, first_word, n_words): texts cut at the capacity.

    The duplicate cluster is a digest of the lower-cased text; texts without words are one
    piece of no words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_count(body, F.lit(_WORD)).cast("bigint")
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("bigint") - 1, F.lit(0).cast("bigint"))
    rows = docs.select(F.col(row_id).cast("bigint").alias("id"), F.col(source).alias("source"),
                       F.xxhash64(F.lower(body)).alias("cluster"), n.alias("n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("piece") * capacity
    return rows.select("id", "source", "cluster", "piece", first.alias("first_word"),
                       F.least(F.col("n") - first, F.lit(capacity)).alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, row_id: str = "doc_id",
         text: str = "text", source: str = "source", places: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin, offset) for every piece of every row.

    No bin holds more than `capacity` words, nor two pieces of one source or of one
    duplicate cluster. Rows without a source conflict through their cluster only. Texts
    longer than the capacity are cut into pieces (which share a source and a cluster, or
    else a cluster, so they go to different bins); texts without words get no bin (null).
    Rows that repeat an id are packed as often; an empty table gives no rows.

    Pieces are dealt by a digest into shards of about `shard_rows`, so that a source or a
    cluster with a third of all rows is spread over all of them, and each shard is packed
    by one task, largest pieces first. Bins are numbered by shard.

    With `places` (`row_id`, `source`, position), as `mixing.mix` gives them, shards are windows
    of consecutive positions instead, so that bins follow the mixture. Rows that share id
    and source are spread over the positions of all of them.

    A shard that turns out to hold more than twice `shard_rows` pieces (very long texts next
    to each other in the mixture, an id that very many rows share) is dealt into several.
    """
    with_package(docs.sparkSession)
    cut = pieces(docs, capacity, row_id, text, source).withColumn("own", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    rows = cut.where("n_words > 0")
    if places is None:
        shard = F.pmod(F.xxhash64("id", "piece", F.lit(1)), F.lit(shards))
    else:
        spots = places.groupBy(F.col(row_id).cast("bigint").alias("i"), F.col(source).alias("s")).agg(
            F.min("position").alias("low"), F.max("position").alias("high"))
        spots = written(spots, "places")
        total = (spots.agg(F.max("high")).first()[0] or 0) + 1
        rows = rows.join(spots, F.col("id").eqNullSafe(F.col("i")) & (F.coalesce("source", F.lit("")) == F.col("s")))
        at = F.col("low") + F.pmod(F.xxhash64("cluster"), F.col("high") - F.col("low") + 1)
        # a text of very many pieces goes on in the windows that follow
        shard = F.pmod(F.expr(f"at * {shards} div {total} + piece div {shard_rows}"), F.lit(shards))
        rows = rows.withColumn("at", at)
    rows = rows.withColumn("shard", shard.cast("bigint"))
    parts = F.ceil(F.col("c") / (2 * shard_rows)).cast("bigint")
    crowds = rows.groupBy("shard").agg(F.count("*").alias("c")).withColumn("parts", parts)
    # one row per shard; numbers go on along the shards
    before = F.sum("parts").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    crowds = crowds.select(F.col("shard").alias("s_"), "parts", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(sized(crowds), F.col("shard") == F.col("s_"))
    rows = rows.withColumn("shard", F.col("before") + F.pmod(F.xxhash64("own"), F.col("parts")))
    rows = rows.select("id", "source", "cluster", "piece", "first_word", "n_words", "shard", "own")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "id", "piece", "cluster", "own"], ascending=[False, True, True, True, True])
        number, offset = best_fit(
            part["n_words"].to_numpy(np.int64), pd.factorize(part["source"])[0],
            pd.factorize(part["cluster"])[0], capacity)
        return pd.DataFrame({
            "id": part["id"].astype("Int64"), "piece": part["piece"], "first_word": part["first_word"], "n_words": part["n_words"],
            "bin": part["shard"].to_numpy(np.int64) << _BIN_BITS | number, "offset": offset})

    schema = "id bigint, piece bigint, first_word bigint, n_words bigint, bin bigint, offset bigint"
    packed = rows.groupBy("shard").applyInPandas(fit, schema)
    void = cut.where("n_words = 0").select(
        "id", "piece", "first_word", "n_words", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("offset"))
    return packed.unionByName(void).withColumnRenamed("id", row_id)
