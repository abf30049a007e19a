import os
import random
import re

import pytest
from pyspark.sql import functions as F

from parcorp.operators.dedup import keep_first, keep_first_chain
from parcorp.operators.observe import StageCounts
from parcorp.sources import readers, sinks
from parcorp.sources.done import add_done, done_table, still_to_do_bucketed
from parcorp.streaming.keep import keep_first_into, kept
from parcorp.streaming.landing import landing_stream


def test_counts_come_with_the_rows(spark):
    rows = [(i, f"t{i % 7}", f"g{i % 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, t string, g string")
    seen = StageCounts()
    out = keep_first_chain(seen.seen(df, "all"), [["t"], ["g"]], ["id"], seen, ["before", "texts", "glyphs"])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    assert out.count() == 3
    jobs = len(tracker.getJobIdsForGroup("counted"))
    assert [tuple(r) for r in seen.table(spark).collect()] == [("all", 50), ("before", 50), ("texts", 7), ("glyphs", 3)]
    spark.sparkContext.setJobGroup("plain", "")
    assert keep_first_chain(df, [["t"], ["g"]], ["id"]).count() == 3
    assert len(tracker.getJobIdsForGroup("plain")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("buckets", [3, 16])
def test_done_side_is_read_in_place(spark, tmp_path, buckets):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    path, schema = str(tmp_path / "done"), "id bigint, v string"
    name = done_table(session, f"d{buckets}", path, schema, buckets=buckets)
    work = session.range(100).withColumn("w", F.lit("x"))
    assert still_to_do_bucketed(work, name).count() == 100  # nothing is done yet
    for lo in (0, 30):
        add_done(session.range(lo, lo + 30).selectExpr("'v' AS v", "id"), name)
    done_table(session, f"again{buckets}", path, schema, buckets=buckets)  # as a later application would
    for table in (name, f"again{buckets}"):
        left = still_to_do_bucketed(work, table)
        assert sorted(r.id for r in left.collect()) == list(range(60, 100))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and f"SelectedBucketsCount: {buckets} out of {buckets}" in plan
        scan = plan.splitlines().index(next(line for line in plan.splitlines() if "Bucketed: true" in line))
        above = plan.splitlines()[scan - 4:scan]
        assert not any("Exchange" in line for line in above), plan
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) <= 2 * buckets


def listing(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_rewriting_one_genre(spark, tmp_path):
    path = str(tmp_path / "genres")
    df = spark.createDataFrame([(i, "ab/c"[i % 4] + "x", f"t{i}") for i in range(40)], "id int, genre string, t string")
    sinks.by_genre(df, path, str(tmp_path / "full"))
    before = listing(path)
    for _ in range(2):
        sinks.rewrite_genres(df.where("genre = 'bx'").withColumn("t", F.lit("new")), path)
    after = listing(path)
    assert {f for f in before if "genre_name=bx" not in f} == {f for f in after if "genre_name=bx" not in f}
    assert all(before[f] == after[f] for f in before if f in after) and not any("genre_name=bx" in f for f in before if f in after)
    got = {r.id: r.t for r in spark.read.parquet(path).collect()}
    assert got == {i: "new" if i % 4 == 1 else f"t{i}" for i in range(40)}


def test_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(10)], "id string, translation string")
    for batch, part in ((0, "id < '5'"), (1, "id >= '5'"), (1, "id >= '5'"), (0, "id < '5'")):
        sinks.result_batch(rows.where(part), path, batch)
    found = readers.generated_json(spark, path)
    assert sorted((r.id, r.translation) for r in found.collect()) == [(str(i), f"t{i}") for i in range(10)]
    assert "batch" not in found.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_keeps_the_first_row_whatever_the_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(12)]), rnd.randrange(1000), f"r{i}") for i in range(200)]
    schema = "k int, at int, v string"
    every = spark.createDataFrame(rows, schema)
    rnd.shuffle(rows)
    table, state = f"{tmp_path}/table", f"{tmp_path}/state"

    def run(part, files):
        spark.createDataFrame(part, schema).repartition(files).write.mode("append").parquet(f"{tmp_path}/in")
        stream = landing_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1).drop("ingested")
        keep_first_into(stream, ["k"], ["at", "v"], table, state).awaitTermination()

    run(rows[:120], 3)
    run(rows[120:], 2)  # started again: late rows may come before those that were kept
    got = kept(spark, table, every.schema, ["k"], ["at", "v"])
    want = keep_first(every, ["k"], ["at", "v"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    batches = {re.search(r"batch=(-?\d+)", d)[0] for d, _, _ in os.walk(table) if "batch=" in d}
    assert len(batches) >= 6
