import random

from pyspark.sql import functions as F

from parcorp.operators import collate, joins, ranking, sample, stats
from parcorp.operators.dedup import keep_first, keep_first_chain
from parcorp.operators.observe import StageCounts
from parcorp.operators.overrides import apply_overrides

CORPUS = "id string, transliteration string, language string, langs string, period string, genre string"


def corpora(spark):
    a = spark.createDataFrame([
        ("P1", "lugal", "Sumerian", "sux", "Uncertain", "Lexical; School", "e1", 1),
        ("P2", "an", "Akkadian", "sux", "Ur III", "Ritual", "e", 2),
        ("P3", "an", "", "sux akk", "Ur III", "Ritual", "e", 3),
        ("P4", "", "", "sux", "Ur III", "Ritual", "e", 4), ("P5", "ki", None, "sux", "fake", "Ritual", "e", 5),
        ("P6", "ki", None, "sux", None, "Hymn-Prayer", "e", 6),
    ], CORPUS + ", only_a string, row_ord int")
    b = spark.createDataFrame([
        ("P1", "other", "Sumerian", "sux", "x", "y", 1), ("P7", "mu", "", "", "Ur III", "fake (modern)", 2),
        ("P8", "mu", "", "", "Ur III", "Scientific", 3),
    ], CORPUS + ", row_ord int")
    return [a, b]


def test_collate(spark):
    got = {tuple(r) for r in collate.collate(corpora(spark), "row_ord").collect()}
    assert got == {("P1", "lugal", "Unknown", "Lexical"), ("P6", "ki", "Unknown", "Liturgy"),
                   ("P8", "mu", "Ur III", "Math/Science")}


def test_stage_counts(spark):
    df = collate.union_common([c.na.fill("") for c in corpora(spark)])
    assert "only_a" not in df.columns
    stages = [("union", F.lit(True)), ("language", collate.wanted_language()), ("text", collate.has_text())]
    got = {r.stage: r.n for r in collate.stage_counts(df, stages).collect()}
    assert got == {"union": 9, "language": 5, "text": 4, "distinct_ids": 3}


def test_keep_first_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(10**6)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, k string, o int").repartition(8)
    want = {}
    for i, k, o in rows:
        want[k] = min(want.get(k, (o, i)), (o, i))
    got = keep_first(df, ["k"], ["o", "id"])
    assert {r.k: (r.o, r.id) for r in got.collect()} == want
    assert keep_first(got, ["k"], ["o", "id"]).count() == len(want)


def test_chain_order_matters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x")], "id int, t string, g string")
    assert {r.id for r in keep_first_chain(df, [["t"], ["g"]], ["id"]).collect()} == {1, 3}
    assert {r.id for r in keep_first_chain(df, [["g"], ["t"]], ["id"]).collect()} == {1}


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, t string")
    assert {r.id for r in keep_first(df, ["t"], ["id"]).collect()} == {1, 3}


def test_wide_rows_are_not_moved_to_find_repeats(spark):
    from parcorp.plans import corpus

    rng = random.Random(3)
    rows = [(i if i % 9 else None, rng.choice([None, "", "hot", *[f"t{k}" for k in range(300)]]),
             rng.choice([None, "", *[f"g{k}" for k in range(200)]]), f"n{i}", rng.randrange(10**6)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, transliteration string, glyphs string, glyph_names string, o int").repartition(5)
    want = keep_first_chain(df, corpus.KEYS, ["o"]).drop("o")
    seen = StageCounts()
    got = corpus.without_repeats(df, ["o"], seen)
    assert got.columns == want.columns
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counts = [900, keep_first(df, ["transliteration"], ["o"]).count(), want.count()]
    assert [r.n for r in seen.table(spark).collect()] == counts


def test_running_total_matches_brute_force(spark):
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.total for r in ranking.running_total(df, F.col("v"), "k", "total").collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.k, r.id)):
        total += r.v
        assert got[r.id] == total


def test_split_sizes(spark):
    df = spark.range(1300).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 11).cast("string"))).alias("period"),
        F.when(F.col("id") < 300, "Lexical").otherwise("x").alias("genre"))
    got = sample.stratified_split(df).cache()
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 1200, "test": 50, "validation": 50}
    assert got.select("id").distinct().count() == 1300
    assert got.where("genre = 'Lexical' AND split <> 'train'").count() == 0
    hot = got.where("period = 'hot' AND genre <> 'Lexical'")
    n = hot.count()
    assert abs(hot.where("split = 'test'").count() - n / 20) < 1
    again = sample.stratified_split(df.repartition(3))
    assert got.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    other = sample.stratified_split(df, seed=1)
    assert got.select("id", "split").exceptAll(other.select("id", "split")).count() > 0


def test_split_of_a_tiny_table(spark):
    df = spark.createDataFrame([(1, None, "x")], "id int, period string, genre string")
    assert [r.split for r in sample.stratified_split(df).collect()] == ["test"]


def test_oversample_and_shuffle(spark):
    df = spark.createDataFrame([(i, "Administrative" if i < 3 else "x") for i in range(5)], "id int, genre string")
    assert sample.oversample(df, F.col("genre") == "Administrative").count() == 23
    order = [r.id for r in sample.shuffled(df, 3).collect()]
    placed = sample.shuffled_positions(df, 3).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == order
    assert sorted(order) == [0, 1, 2, 3, 4]


def test_counts(spark):
    df = spark.createDataFrame([("a b  a\n...",), ("<SURFACE>𒀭𒀭",)], "t string")
    assert {(r.value, r.n) for r in stats.top_k(df, "t", 1).collect()} == {("<SURFACE>𒀭𒀭", 1), ("Total", 2)}
    assert stats.glyph_total(df, "t").first().total_glyphs == 5
    assert {(r.char, r.n_texts) for r in stats.alphabet(df, "t").collect()} == {("a", 1), ("b", 1), (" ", 1), ("𒀭", 1)}
    assert {(r.token, r.n) for r in stats.token_frequencies(df, "t").collect()} == {("a", 2), ("b", 1), ("𒀭𒀭", 1)}
    assert {(r.token, r.n) for r in stats.token_frequencies(df, "t", "glyph").collect()} == {("a", 2), ("b", 1), ("𒀭", 2)}
    row = stats.token_summary(df, "t").first()
    assert (row.n_texts, row.total_tokens, row.mean_tokens) == (2, 4, 2.0)
    lens = spark.createDataFrame([("a" * n,) for n in (64, 65, 128, 256, 257)], "t string")
    assert {r.bucket: r.n for r in stats.length_histogram(lens, "t").collect()} == {
        "0-64": 1, "64-128": 2, "128-256": 1, "mt256": 1}


def test_overrides(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "x y")], "id string, t string")
    fixes = spark.createDataFrame([("s", "a", "x", "1"), ("s", "a", "y", "2"), ("other", "b", "x", "9")],
                                  "step string, id string, find string, repl string")
    got = {r.id: r.t for r in apply_overrides(df, fixes, "s", "t").collect()}
    assert got == {"a": "1 2", "b": "x y"}


def test_photos(spark, apply):
    assert apply(joins.photo_id, ["dl/photo/P123456_d.jpg", "dl/photo/none.jpg"]) == ["P123456", None]
    artifacts = spark.createDataFrame([(1, "tablet"), (None, "seal")], "artifact_id bigint, artifact_type string")
    assets = spark.createDataFrame(
        [(1, "photo", "dl/P1_d.jpg", "jpg"), (1, "lineart", "dl/P1.svg", "svg"), (None, "photo", "dl/P9.jpg", "jpg")],
        "artifact_id bigint, asset_type string, path string, file_format string")
    photos = joins.photo_index(artifacts, assets)
    assert [tuple(r) for r in photos.collect()] == [(1, "photo", "P1_d.jpg", "tablet", "P1")]
    texts = spark.createDataFrame([("P1", "𒀭", "p", "g", "train")], "id string, glyphs string, period string, genre string, split string")
    assert joins.texts_with_photos(texts, photos).first().split == "train"


def test_membership(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(2,), (2,), (4,)], "id int")
    assert tuple(joins.count_present(a, b).first()) == (4, 2)
    assert {r.id for r in joins.still_to_do(a, b).collect()} == {1, 3}
