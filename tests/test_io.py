import json

import pytest
from pyspark.sql import functions as F

from parcorp import schemas
from parcorp.operators import augment, joins
from parcorp.operators import sequences as Q
from parcorp.plans import corpus, training
from parcorp.sources import readers, sinks
from parcorp.streaming.landing import clean_into, cleaned_table, landing_stream

ROWS = [("P1", "a\nb \"q\" , c", "Ur III", "Math/Science"), ("P2", "", "", "Legal")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, schemas.TEXTS)
    sinks.table_csv(df, f"{tmp_path}/t")
    assert rows(readers.corpus_csv(spark, f"{tmp_path}/t")) == ROWS


def test_keyed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("artifact_id,artifact_type\n1,NA\n,seal\n")
    # null words are null, as for the tables' usual reader, unless told otherwise
    assert rows(readers.keyed_csv(spark, f"{tmp_path}/a.csv", schemas.ARTIFACTS).na.drop(subset=["artifact_id"])) == [(1, None)]
    kept = readers.keyed_csv(spark, f"{tmp_path}/a.csv", schemas.ARTIFACTS, null_words=[""])
    assert rows(kept.na.drop(subset=["artifact_id"])) == [(1, "NA")]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('genre,note,transliteration,"id",period\nLegal,n,"a\nb",P1,nan\n,m,NULL,P2,Ur III\n')
    assert rows(readers.corpus_csv(spark, f"{tmp_path}/a.csv")) == [("P1", "a\nb", "", "Legal"), ("P2", "", "Ur III", "")]
    (tmp_path / "b.csv").write_text("artifact_type,artifact_id\nseal,7\n")
    assert rows(readers.keyed_csv(spark, f"{tmp_path}/b.csv", schemas.ARTIFACTS)) == [(7, "seal")]
    (tmp_path / "c.csv").write_text("artifact_id,designation\n7,foo\n")
    with pytest.raises(ValueError, match="artifact_type"):
        readers.keyed_csv(spark, f"{tmp_path}/c.csv", schemas.ARTIFACTS)


def test_generated_records_many_per_file(spark, tmp_path):
    df = spark.range(50).selectExpr("cast(id as string) id", "concat('t', id) translation").coalesce(1)
    sinks.result_records(df, f"{tmp_path}/g")
    assert readers.generated_json(spark, f"{tmp_path}/g").where("translation = concat('t', id)").count() == 50


def test_bad_records_are_kept_apart(spark, tmp_path):
    lines = ['{"id": "P1", "period": null, "cdl": "big"}', '{"id": "P2", ', '{"id": "P3", "period": "x", "cdl": "y"}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    records = readers.record_json(spark, f"{tmp_path}/r.json", "id string, period string, cdl string").cache()
    good, bad = readers.good_and_bad(records)
    assert rows(good) == [("P1", ""), ("P3", "x")] and "cdl" not in good.columns
    assert [r[0] for r in bad.collect()] == [lines[1]]
    records.unpersist()


def test_json_folders(spark, tmp_path):
    for i, t in enumerate(["ok", "", None]):
        record = {"id": f"P{i}", "transliteration": "a\nb", "genre": "g", "period": "p"}
        if t is not None:
            record["translation"] = t
        (tmp_path / f"{i}.json").write_text(json.dumps(record, indent=4))
    (tmp_path / "note.txt").write_text("{}")
    got = augment.non_empty_translations(readers.generated_json(spark, str(tmp_path), pretty=True))
    assert [r.id for r in got.collect()] == ["P0"]
    for name in ("c1", "c2"):
        (tmp_path / f"{name}.arr").write_text(json.dumps([{"id": name, "period": {"period": "x"}}, {"id": name}]))
    records = readers.atf_records(spark, [f"{tmp_path}/c1.arr", f"{tmp_path}/c2.arr"])
    assert records.count() == 4


def test_result_records_resume(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out = f"{tmp_path}/generated"
    sinks.result_records(work.where("id = 'a'").withColumn("translation", F.lit("x")), out)
    done = spark.read.schema(schemas.GENERATED).json(out)
    sinks.result_records(joins.still_to_do(work, done).withColumn("translation", F.lit("y")), out)
    assert rows(spark.read.schema(schemas.GENERATED).json(out).select("id", "translation")) == [
        ("a", "x"), ("b", "y"), ("c", "y")]


def test_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, schemas.TEXTS)
    sinks.by_genre(df, f"{tmp_path}/by_genre", f"{tmp_path}/full")
    assert {p.name for p in (tmp_path / "by_genre").iterdir() if "=" in p.name} == {
        "genre_name=MathScience", "genre_name=Legal"}
    assert rows(spark.read.parquet(f"{tmp_path}/full")) == ROWS
    sinks.by_split(df.withColumn("split", F.lit("train")).withColumn("image_type", F.lit("photo")), f"{tmp_path}/s", "image_type")
    part = spark.read.parquet(f"{tmp_path}/s/split=train/image_type=photo")
    assert "split" not in part.columns and part.count() == 2
    assert readers.split_table(spark, f"{tmp_path}/s").where("split = 'train'").count() == 2


def test_other_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("𒀭", "an", 3), ("𒀭", "il₂", 1), ("𒆠", "ki", 2)], "glyph string, reading string, n bigint")
    sinks.lookup_json(sinks.nested_counts(counts), f"{tmp_path}/l")
    got = spark.read.schema("glyph string, readings map<string, bigint>").json(f"{tmp_path}/l")
    assert {r.glyph: r.readings for r in got.collect()} == {"𒀭": {"an": 3, "il₂": 1}, "𒆠": {"ki": 2}}
    sinks.line_pairs(spark.createDataFrame([("p", "l")], "a string, b string"), "a", "b", f"{tmp_path}/p")
    assert [r.value for r in spark.read.text(f"{tmp_path}/p").collect()] == ["p", "l"]
    first = sinks.cached(counts, f"{tmp_path}/c")
    assert rows(sinks.cached(counts.limit(0), f"{tmp_path}/c")) == rows(first) == rows(counts)


def test_file_inventory(spark, tmp_path):
    (tmp_path / "p" / "x").mkdir(parents=True)
    for name in ("a.jpg", "x/b.jpg"):
        (tmp_path / "p" / name).write_bytes(b"1")
    local = readers.file_inventory(spark, f"{tmp_path}/p")
    present = spark.createDataFrame([("a.jpg",)], "name string")
    assert [r.name for r in joins.missing_files(local, present, f"{tmp_path}/p").collect()] == ["x/b.jpg"]


def test_missing_files_takes_the_root_as_it_is(spark):
    local = spark.createDataFrame([("/data/a+b/x.jpg",), ("hdfs://nn:8020/data/a+b/y.jpg",), ("/other/z.jpg",)], "path string")
    present = spark.createDataFrame([("x.jpg",)], "name string")
    for root in ("/data/a+b", "s3a://bucket/data/a+b/"):
        got = joins.missing_files(local, present, root)
        assert sorted(r.name for r in got.collect()) == ["/other/z.jpg", "y.jpg"]


def test_cached_reads_what_is_there(spark, tmp_path):
    df = spark.range(5)
    assert sinks.cached(df, f"{tmp_path}/c").count() == sinks.cached(df.limit(1), f"{tmp_path}/c").count() == 5


def test_stream_equals_batch_and_skips_known_ids(spark, tmp_path):
    schema = "id string, transliteration string"
    first = [("P1", "[lugal] e₂"), ("P2", "#SURFACE#"), ("P3", "mu x x")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")

    def run():
        stream = landing_stream(spark, f"{tmp_path}/in", schema)
        clean_into(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return rows(cleaned_table(spark, f"{tmp_path}/out").select("id", "transliteration_clean"))

    assert run() == [("P1", "...e₂"), ("P3", "mu...")]
    more = [("P1", "other"), ("P4", "ki")]
    spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    assert run() == [("P1", "...e₂"), ("P3", "mu..."), ("P4", "ki")]


def test_build_end_to_end(spark, tmp_path):
    from tests.test_corpus import CORPUS
    from tests.test_signs import SIGN_LIST
    (tmp_path / "osl.json").write_text(json.dumps(SIGN_LIST), encoding="utf-8")
    texts = [(f"P{i}", f"ki-[a] il₂ {{ki}} {'ki ' * i}", "", "", "Ur III", "Administrative" if i % 2 else "Legal", i) for i in range(40)]
    # the first row of equal texts has the larger id
    texts.insert(0, ("P99", texts[3][1], "", "", "Ur III", "Legal", -1))
    df = spark.createDataFrame(texts, CORPUS + ", row_ord int")
    index = spark.createDataFrame([("ki", "KI")], "reading string, name string")
    sign_list = readers.sign_list(spark, f"{tmp_path}/osl.json")
    out = corpus.build(spark, [df], sign_list, index, f"{tmp_path}/out")
    assert out["tablets"].count() == out["cleaned"].count() == 41
    assert out["corpus"].count() == 40
    assert {"P99"} == {r.id for r in out["corpus"].where("id IN ('P3', 'P99')").collect()}
    stages = {r.stage: r.n for r in out["stage_counts"].collect()}
    assert stages == {"collated": 41, "cleaned": 41, "with_glyphs": 41, "distinct_texts": 40, "distinct_glyphs": 40}
    row = out["corpus"].where("id = 'P1'").first()
    assert (row.transliteration, row.glyphs) == ("ki...il₂ {ki} ki", "𒆠...𒀭𒆠𒆠")
    counts = {r.split: r["count"] for r in out["splits"].groupBy("split").count().collect()}
    assert counts == {"train": 36, "test": 2, "validation": 2}
    vocab = Q.vocabulary(out["corpus"], "glyphs")
    chunks = training.glyph_chunks(out["splits"], vocab)
    train = out["splits"].where("split = 'train'")
    minority = train.where("genre <> 'Administrative'").count()
    assert chunks.where("split = 'train'").count() == 36 + 9 * minority
    ordered = [r.copy_id for r in training.in_order(chunks).collect()]
    assert ordered == [r.copy_id for r in training.in_order(chunks.repartition(3)).collect()] != sorted(ordered)
    kept, rest = training.pair_examples(out["splits"], vocab, Q.vocabulary(out["corpus"], "transliteration"), limit=60)
    assert kept.select("id").distinct().count() + rest.select("id").distinct().count() == 40
    assert kept.where("size(input_ids) > 60 OR size(labels) > 60").count() == 0
