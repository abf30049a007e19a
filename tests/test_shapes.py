import pytest
from pyspark.sql import functions as F

from parcorp.operators import shapes


def records(spark, rows):
    df = spark.createDataFrame(rows, "corpus string, at int, value string")
    return df.select("corpus", "at", F.parse_json("value").alias("record"))


ROWS = [
    ("a", 1, '{"id": "x", "n": 1, "only": true}'),
    ("a", 2, '{"id": null, "n": {"deep": [1, "2"]}, "a b.c": 3}'),
    ("b", 3, '{"n": [1, 2], "id": 7, "a b.c": "q\\"uote"}'),
    ("b", 4, "{}"),
    ("b", 5, '[{"id": 1}]'),
    ("b", 6, None),
    (None, 7, '{"id": 1.50, "n": "", "a b.c": null}'),
]


def test_fields_by_corpus(spark):
    got = {(r.corpus, r.field): (r.n, r.kind) for r in shapes.record_fields(records(spark, ROWS)).collect()}
    assert got[("a", "id")] == (2, "STRING")
    assert got[("a", "n")] == (2, "VARIANT")
    assert got[("b", "n")] == (1, "ARRAY<BIGINT>")
    assert got[(None, "a b.c")] == (1, "VOID")
    assert len(got) == 10


def test_collate_keeps_common_fields(spark):
    out = shapes.collate_records(records(spark, ROWS), keep=["at"])
    assert out.columns == ["corpus", "at", "a b.c", "id", "n"]
    got = {r.at: tuple(r)[2:] for r in out.collect()}
    assert got == {
        1: ("", "x", "1"), 2: ("3", "", '{"deep":[1,"2"]}'), 3: ('q"uote', "7", "[1,2]"),
        4: ("", "", ""), 5: ("", "", ""), 6: ("", "", ""), 7: ("", "1.5", "")}


def test_a_corpus_without_fields_leaves_none(spark):
    rows = ROWS + [("c", 8, "{}")]
    assert shapes.collate_records(records(spark, rows), keep=["at"]).columns == ["corpus", "at"]
    assert shapes.collate_records(records(spark, []), keep=["at"]).count() == 0


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="at"):
        shapes.collate_records(records(spark, [("a", 1, '{"at": 1}')]), keep=["at"])
