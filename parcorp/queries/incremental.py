"""Work that goes on: resumed runs, rewritten partitions, repeated batches, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcorp.queries.corpus import q_dedup_id  # noqa: F401  (its SQL is the twin)
from parcorp.queries.files import folder, texts
from parcorp.queries.records import q_resume_anti  # noqa: F401
from parcorp.queries.registry import ORACLES, query, table
from parcorp.sources import readers, sinks
from parcorp.sources.done import add_done, done_table, still_to_do_bucketed
from parcorp.streaming.keep import keep_first_into, kept
from parcorp.streaming.landing import landing_stream


@query("q_resume_bucketed", ORACLES["q_resume_anti"])
def q_resume_bucketed(spark, sf_dir):
    """Labels arrive in two runs; the third works on what is left."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    name = done_table(spark, f"done_{uuid.uuid4().hex}", folder(spark, "done"), "id bigint, quality bigint")
    for part in (0, 1):
        add_done(done.where(F.pmod("id", F.lit(2)) == part).withColumn("quality", F.col("quality").cast("bigint")), name)
    work = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return still_to_do_bucketed(work, name)


@query("q_rewrite_genre", """
SELECT doc_id AS id, CASE source WHEN 'src2' THEN 'anew: ' || text ELSE text END AS transliteration, lang AS period, source AS genre_name
FROM documents WHERE source IS NOT NULL
""")
def q_rewrite_genre(spark, sf_dir):
    """One genre is made anew, twice; the files of the others stay."""
    df = texts(spark, sf_dir).where("genre IS NOT NULL")
    path = folder(spark, "genres")
    sinks.by_genre(df, path, folder(spark, "full"))
    anew = df.where("genre = 'src2'").withColumn("transliteration", F.concat(F.lit("anew: "), "transliteration"))
    for _ in range(2):
        sinks.rewrite_genres(anew, path)
    return spark.read.parquet(path).select("id", "transliteration", "period", F.col("genre_name").cast("string").alias("genre_name"))


@query("q_result_batches", ORACLES["q_result_records"])
def q_result_batches(spark, sf_dir):
    """Results in two batches, of which the second is run three times."""
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("translation"), F.col("role").alias("genre"))
    path = folder(spark, "batches")
    user = F.col("genre") == "user"
    for batch in (0, 1, 1, 1):
        sinks.result_batch(conv.where(~user if batch else user), path, batch)
    return readers.generated_json(spark, path).select("id", "translation", "genre")


@query("q_stream_keep_first", ORACLES["q_dedup_id"])
def q_stream_keep_first(spark, sf_dir):
    """The last turn of each conversation, from files that arrive a few at a time."""
    rows = table(spark, sf_dir, "conversations").withColumn("last_first", -F.col("turn"))
    out = folder(spark, "arriving")
    rows.repartition(6).write.parquet(f"{out}/in")
    stream = landing_stream(spark, f"{out}/in", rows.schema, files_per_batch=2).drop("ingested")
    keep_first_into(stream, ["conv_id"], ["last_first"], f"{out}/table", f"{out}/state").awaitTermination()
    return kept(spark, f"{out}/table", rows.schema, ["conv_id"], ["last_first"]).drop("last_first")
