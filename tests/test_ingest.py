import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcorp.operators import cdl
from parcorp.queries import QUERIES, ingest
from parcorp.queries.ingest import in_small_splits
from parcorp.session import materialised
from parcorp.sources import readers, splits

SCHEMA = "id bigint, text string, note string"


@pytest.fixture(scope="module")
def small(spark):
    return in_small_splits(spark, 900)


def rows_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


# ---- CSV --------------------------------------------------------------------------------------
def write_csv(path, rows, end="\n", header=("note", "text", "more", "id")):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        for i, text, note in rows:
            out.writerow([note, text, "x", i])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_split_equals_the_whole_reader(small, tmp_path, end):
    rnd = random.Random(4)
    parts = ['"', '""', ",", "\n", "\n\n", "a", "é", " ", "\\", 'x"y', "word " * 30]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) + "z", rnd.choice(["", "n", "NaN", "a\nb"]))
            for i in range(200)]
    rows[50] = (50, "long\n" * 2000, "n")  # goes on over whole splits without a start
    rows[51] = (51, '"quoted",\n\n"' * 900, "n")
    write_csv(tmp_path / "a.csv", rows[:120], end)
    write_csv(tmp_path / "b.csv", rows[120:], end)
    write_csv(tmp_path / "c.csv", [], end)
    found = readers.csv_split(small, str(tmp_path), SCHEMA)
    whole = readers.csv_by_name(small, str(tmp_path), SCHEMA)
    want = [repr((i, t, None if n in ("", "NaN") else n)) for i, t, n in rows]
    assert rows_of(whole, "id", "text", "note") == sorted(want)
    assert rows_of(found, "id", "text", "note") == sorted(want)
    units = splits.units(small, str(tmp_path / "a.csv"), "\n")
    assert units.rdd.getNumPartitions() >= 4
    # a quote is open at the border of a split
    before = units.groupBy("block").agg(F.sum(splits.quotes(F.col("value"))).alias("q")).orderBy("block").collect()
    assert any(sum(r.q for r in before[:k]) % 2 for k in range(1, len(before)))


def test_csv_split_checks_headers(small, tmp_path):
    write_csv(tmp_path / "a.csv", [(1, "a", "b")])
    with pytest.raises(ValueError, match="no columns"):
        readers.csv_split(small, str(tmp_path), "id bigint, missing string")
    write_csv(tmp_path / "b.csv", [(1, "a", "b")], header=("text", "note", "more", "id"))
    with pytest.raises(ValueError, match="different headers"):
        readers.csv_split(small, str(tmp_path), SCHEMA)


# ---- JSON -------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def element(spark):
    return StructType.fromDDL("id bigint, text string, parts array<struct<a: string, b: array<bigint>>>")


def elements(n, seed=0):
    rnd = random.Random(seed)
    pieces = ["[", "]", "{", "}", ",", '"', "\\", "\n", "é", "ab", '\\"', " "]
    text = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 60)))
    return [{"id": i, "text": text(), "parts": [{"a": text(), "b": list(range(rnd.randrange(4)))} for _ in range(rnd.randrange(3))]}
            for i in range(n)]


def as_rows(items):
    return sorted(repr((e["id"], e["text"], [(p["a"], p["b"]) for p in e["parts"]])) for e in items)


def plain(df):
    return sorted(repr((r.id, r.text, [(p.a, p.b) for p in r.parts])) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_json_elements(small, element, tmp_path, indent):
    items = elements(150)
    items[70]["text"] = "[,{" * 3000
    (tmp_path / "a.json").write_text(json.dumps(items[:100], indent=indent))
    (tmp_path / "b.json").write_text("\n " + json.dumps(items[100:], indent=indent) + "\n")
    (tmp_path / "c.json").write_text("[ ]")
    (tmp_path / "d.json").write_text("")
    found = readers.json_elements(small, str(tmp_path), element)
    assert plain(found) == as_rows(items) and found.where("_corrupt IS NOT NULL").isEmpty()
    assert splits.units(small, str(tmp_path), ",").rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("indent", [None, 1])
def test_json_inner_array_and_entries(small, element, tmp_path, indent):
    items = elements(60, 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"x [{": {"y": items, "after": "[1,2,{"}, "more": "]"}, indent=indent))
    assert plain(readers.json_elements(small, str(tmp_path / "in"), element, depth=3)) == as_rows(items)
    entries = {f"k{i}, [\"{i}": e for i, e in enumerate(items)}
    (tmp_path / "map.json").write_text(json.dumps(entries, indent=indent))
    found = readers.json_elements(small, str(tmp_path / "map.json"), element, entries=True)
    assert sorted((r.key, r.value.id) for r in found.collect()) == sorted((k, e["id"]) for k, e in entries.items())


def test_json_element_that_does_not_parse(small, element, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2,, "x"}, {"id": 3}]')
    found = readers.json_elements(small, str(tmp_path), element)
    assert sorted(r.id for r in found.where("_corrupt IS NULL").collect()) == [1, 3]
    assert found.where("_corrupt IS NOT NULL").count() >= 1


# ---- trees --------------------------------------------------------------------------------------
def texts(spark, trees):
    lines = spark.createDataFrame([(i, None if t is None else json.dumps(t)) for i, t in enumerate(trees)], "i int, t string")
    return [r.t for r in lines.select("i", cdl.text_of_tree(F.try_parse_json("t")).alias("t")).orderBy("i").collect()]


def words(*ws):
    return [{"node": "l", "frag": w} for w in ws]


LINE = {"node": "d", "type": "line-start"}


def nested(nodes, levels):
    for _ in range(levels):
        nodes = [{"node": "c", "cdl": nodes}]
    return nodes


def test_text_of_trees(spark):
    got = texts(spark, [
        [], None, [LINE, *words("a", "b"), LINE, *words("c")], nested([LINE, *words("a", 'q"[{\\')], 40),
        [{"node": "c", "cdl": [{"node": "d", "type": "obverse"}, LINE, *words("a"), *nested([*words("b"), LINE], 3), *words("c")]},
         {"node": "d", "type": "nonx", "state": "ruling"}, {"node": "d", "type": "unheard-of"}, LINE, *nested(words("d"), 2)],
        [LINE, {"node": "l", "f": {"form": "f"}}, {"node": "l"}, {"node": "l", "frag": "g", "f": {"form": "h"}}, {"node": "x", "frag": "no"}],
        {"node": "no array"}, words("x"), [LINE, LINE, LINE],
    ])
    assert got == ["", None, "a b\nc", 'a q"[{\\', "<SURFACE>\na b\nc\n<RULING>\nd", "f g", None, "x", ""]


def test_failed_records_and_no_python(spark, tmp_path):
    good = {"id": "1", "cdl": nested([LINE, *words("a")], 5)}
    (tmp_path / "r.json").write_text(json.dumps(good) + "\n" + json.dumps(good)[:-3] + "\n")
    records = materialised(readers.record_json(spark, str(tmp_path), "id string, cdl variant"))
    rows, bad = readers.good_and_bad(records, drop=())
    found = cdl.with_text(rows)
    assert [tuple(r) for r in found.collect()] == [("1", "a")] and bad.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_trees_of_any_depth_are_read_by_few_casts(spark):
    around = [cdl.LEVELS + k for k in (-1, 0, 1, 2)] + [3 * cdl.LEVELS + 5]
    mixed = [LINE, *nested(words("a"), 40), *words("b"), *nested([LINE, *words("c")], cdl.LEVELS + 1), {"node": "l", "frag": "d", "cdl": 1}, 7, None]
    assert texts(spark, [*[nested([LINE, *words("a", "b")], k) for k in around], mixed]) == ["a b"] * len(around) + ["a b\nc d"]
    tree = spark.range(1).select(F.try_parse_json(F.col("id").cast("string")).alias("t")).select(cdl.text_of_tree(F.col("t")).alias("x"))
    assert tree._jdf.queryExecution().logical().toString().count("variant_get") <= 2  # not one per field and node


@pytest.mark.parametrize("name", ["q_csv_split", "q_json_array_split", "q_sign_list_split"])
def test_split_tables_are_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    docs = [(i, f'a "{i}",\n[b{{', "en", f"src{i % 5}", 9) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    run, paths = QUERIES[name], []
    monkeypatch.setattr(ingest, "folder", lambda _, kind: paths.append(f"{tmp_path}/{kind}{len(paths)}") or paths[-1])
    one = sorted(map(str, run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(ingest, "ROWS_A_FILE", 15)
    assert sorted(map(str, run(spark, str(tmp_path)).collect())) == one
    files = [f for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths[-1]).select("length").collect()]
    assert 3 <= len(files) <= 5 and max(f.length for f in files) < sum(f.length for f in files) / 2
