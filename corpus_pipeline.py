"""Documents to training sequences: five stages, each a DataFrame of the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.llm import exact_dedup, langid, mixing, packing, simhash
from parcorp.llm.common import columns_of, written
from parcorp.session import sized

MIN_SCORE = 0.3  # share of a text's letters that its main language must explain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled rows; those without a letter, in an
    unlearned script or of words that no learned language explains go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.accepted(docs, model, MIN_SCORE, explained=True)


def exact_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest id, of several such the smallest row (as JSON)."""
    kept = exact_dedup.exact_groups(docs).where("kept")
    # rows that repeat an id and its text: groups of which more than one row is left. The table
    # between join and count lets the join split a digest of very many rows.
    left = written(kept.where("size > 1").select(F.col("digest").alias("d")), "exact-left")
    again = written(left.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d"), "exact-again")
    if again.isEmpty():
        return kept.select("row.*")
    same = F.col("digest") == F.col("d")
    several = written(kept.join(again, same, "left_semi").select("row", "digest"), "exact-several")
    text = exact_dedup.normalised(F.col("row.text")).alias("t")
    several = several.groupBy("digest", text).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(again, same, "left_anti").select("row.*").unionByName(several.select("row.*"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one row: that with the smallest id, null ids last.

    Rows get a key of their own first, since ids may repeat or be null.
    """
    key = f"_row_{uuid.uuid4().hex}"
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows")
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id"))
    groups = simhash.near_groups(keyed, row_id=key).select(F.col(key).alias("r"), F.col("component_id").alias("g"))
    groups = written(groups.join(ids, F.col("r") == F.col("k")).select("k", "id", "g"), "near-groups")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "k")
    best = groups.groupBy("g").agg(F.min(order).alias("best"), F.count("*").alias("c")).where("c > 1")
    best = written(best.select(F.col("g").alias("h"), F.col("best.k").alias("keep")), "near-best")
    gone = groups.join(best, F.col("g") == F.col("h")).where("k <> keep").select(F.col("k").alias(key))
    return keyed.join(written(gone, "near-copies"), key, "left_anti").select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: rows and files follow its positions."""
    places = mixing.mix(docs).groupBy(F.col("doc_id").alias("id")).agg(
        F.min("position").alias("low"), F.max("position").alias("high"))
    rows = docs.select(F.struct("*").alias("row"))
    placed = rows.join(sized(places), F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    # rows that share an id, or have none, are spread over the places of all of them
    at = F.col("low") + F.pmod(F.xxhash64("row.text", F.monotonically_increasing_id()), F.col("high") - F.col("low") + 1)
    return placed.withColumn("at", at).orderBy("at").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, int] | None = None,
                   shard_rows: int = packing.SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin, offset): the pieces of all training bins.
    Bins are numbered along the mixture, window by window of its positions."""
    return packing.pack(docs, shard_rows=shard_rows, places=mixing.mix(docs, weights))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_pack", pack_sequences),
]
ORACLE_SQL = None  # Viterbi, XXH64 and best-fit search are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
