import json

import pytest
from pyspark.sql import functions as F

from parcorp.functions.tokens import morphemes, wordforms
from parcorp.operators import lookups as L
from parcorp.operators import resolve as R
from parcorp.sources import readers

SIGN_LIST = {"sl:signlist": {"j:letters": [{"sl:letter": {"j:signs": [
    {"sl:sign": {"n": "AN", "sl:ucun": "𒀭", "j:aka": [{"sl:aka": {"n": "DIĜIR"}}],
                 "j:values": [{"sl:v": {"n": "an"}}, {"x": 1}, {"sl:v": {"n": "il₂"}}],
                 "j:forms": [{"sl:form": {"n": "AN@g", "sl:ucun": "𒀮", "j:values": [{"sl:v": {"n": "an"}}]}}]}},
    {"sl:sign": {"n": "A&amp;A", "j:values": [{"sl:v": {"n": "aa"}}]}},
    {"sl:sign": {"n": "KI", "sl:ucun": "𒆠", "j:values": [{"sl:v": {"n": "ki"}}]}},
]}}]}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("signs")
    (folder / "osl.json").write_text(json.dumps(SIGN_LIST, indent=1), encoding="utf-8")
    (folder / "index.json").write_text(json.dumps({"index": {"an": "AN", "new": "KI"}}))
    return folder


def test_sign_list_to_lookups(spark, files):
    entries = L.sign_entries(readers.sign_list(spark, f"file:{files}/osl.json"))
    names = L.reading_names(L.reading_edges(entries))
    assert {r.reading: r.names for r in names.collect()} == {
        "an": ["AN", "AN@g"], "il₂": ["AN"], "aa": ["A&A"], "ki": ["KI"]}
    index = readers.index_json(spark, f"file:{files}/index.json")
    both = L.override(names, index)
    got = {r.reading: r.names for r in both.collect()}
    assert got["an"] == ["AN"] and got["new"] == ["KI"] and got["aa"] == ["A&A"]
    glyphs = L.name_glyphs(L.glyph_edges(entries))
    assert {r.name: r.glyph for r in L.name_glyph(glyphs).collect()} == {
        "AN": "𒀭", "DIĜIR": "𒀭", "AN@g": "𒀮", "A&A": "", "KI": "𒆠"}
    assert L.ambiguous(glyphs).count() == 0
    only = {r.name: r.reading for r in L.only_readings(both).collect()}
    assert only == {"A&A": "aa"}


@pytest.mark.parametrize("form, parts", [
    ("uri₅{ki}-ma", ["uri₅", "{ki}", "ma"]), ("gur₁₁(a-b)-x", ["gur₁₁(a-b)", "x"]),
    ("7-bi", ["7(diš)", "bi"]), ("12-bi", ["1(u)", "2(diš)", "bi"]), ("12", ["1(u)", "2(diš)"]),
    ("1/2", ["1/2(diš)"]), ("-", []), ("a{b", ["a{b"]), ("...", ["..."]), ("<unk>", ["<unk>"]),
    ("a-(b", ["a", "(b"]), ("(a-b)c-d", ["(a-b)c", "d"]), ("{a{b}c", ["{a{b}", "c"]), ("77-x", ["77", "x"]),
])
def test_morphemes(apply, form, parts):
    assert apply(morphemes, [form]) == [parts]


def test_long_wordforms_need_no_stack(apply):
    long = ["a-" * 100_000, "{" * 30_000 + "a-b", "{k}" * 20_000 + "b", "(" + "a-" * 2_000 + ")"]
    got = apply(lambda t: F.size(morphemes(t)), long)
    assert got == [100_000, 2, 20_001, 1]


def test_wordforms(apply):
    assert apply(wordforms, ["a-b\nc...d  | .| e", ""]) == [["a-b", "\n", "c", "...", "d", "e"], []]


READINGS = [
    ("lugal", ["LUGAL"]), ("an", ["AN", "DIĜIR"]), ("ki", ["KI"]), ("7(diš)", ["7(DIŠ)"]),
    ("ŋeš₂", ["DIŠ"]), ("sangaₓ", ["SANGA"]), ("ba", ["BA", "EŠ"]), ("un", ["UN"]), ("nn", ["N"]),
    ("xx", ["XSIGN"]), ("zero", ["NOGLYPH"]), ("lost", ["NOTINMAP"]), ("gal", ["GAL"]), ("uš₂", ["UŠ₂B"]),
]
GLYPHS = [
    ("LUGAL", "𒈗"), ("AN", "𒀭"), ("KI", "𒆠"), ("7(DIŠ)", "𒐌"), ("DIŠ", "𒁹"), ("SANGA", "𒋖"),
    ("BA", "𒁀"), ("KALAM@g", "𒌦"), ("XSIGN", "XY"), ("NOGLYPH", ""), ("GAL", "𒃲"), ("9(X)", "𒐎"),
    ("N", "𒉌"), ("UŠ₂B", "𒍗"),
]
# morpheme -> reading, name, glyph, reason, name status
U = ("<unk>", "<unk>", "<unk>")
CASES = {
    "lugal": ("lugal", "LUGAL", "𒈗", None, "found"),
    "{ki}": ("{ki}", "KI", "𒆠", None, "found"),
    "geš₂": ("ŋeš₂", "DIŠ", "𒁹", None, "found"),
    "x": ("...", "...", "...", None, "token"),
    "7(diš)": ("7(diš)", "7(DIŠ)", "𒐌", None, "found"),
    "7(DIŠ)": ("7(diš)", "7(DIŠ)", "𒐌", None, "found"),
    "9(X)": ("9(X)", "9(X)", "𒐎", None, "found"),
    "5": (*U, "number", None),
    "an": (*U, "ambiguous", None),
    "LUGAL": (*U, None, None),  # a bare name: no reading, but converted
    "UŠ₂": (*U, None, None),  # upper case of a reading
    "QQ": (*U, "sign_name", None),
    "SANGAₓ": (*U, "other", None),  # not upper case
    "lugal(ZZ)": ("lugal", "LUGAL", "𒈗", None, "found"),
    "ba(BA)": ("ba", "BA", "𒁀", None, "found"),
    "zz(GAL)": ("gal", "GAL", "𒃲", None, "found"),
    "zz(QQ)": (*U, "other", None),
    "un": ("un", "KALAM@g", "𒌦", None, "found"),
    "xx": (*U, None, "found"),
    "zero": (*U, None, "no_unicode"),
    "lost": (*U, None, "not_in_map"),
    "gibberish": (*U, "other", None),
}


@pytest.fixture(scope="module")
def lookups(spark):
    return L.SignLookups.of(
        spark.createDataFrame(READINGS, "reading string, names array<string>"),
        spark.createDataFrame(GLYPHS, "name string, glyph string"),
    )


def test_every_rule(spark, lookups):
    assert lookups.small
    df = spark.createDataFrame([(m,) for m in [*CASES, "nn"]], "morpheme string")
    rows = {r.morpheme: r for r in R.resolve(df, lookups).collect()}
    for m, want in CASES.items():
        r = rows[m]
        assert (r.reading, r.glyph_name, r.glyph, r.reason, r.name_status) == want, m
        assert r.converted == (r.reason is None), m
    assert rows["nn"].dropped and not rows["lugal"].dropped


DOCS = [
    (1, "lugal-ki{ki} ...\n nn lugal", "p"), (2, "nn-lugal-gibberish", "p"), (3, "", "q"),
    (4, "nn lugal", "q"), (5, "x-lugal " + "lugal-ki " * 50, "q"), (6, "<unk> \n<SURFACE> an", "q"),
]
BUILT = {
    1: ("lugal-ki-{ki} ... \n  lugal", "LUGAL KI KI ... \n  LUGAL", "𒈗𒆠𒆠 ... \n  𒈗"),
    2: ("lugal-<unk>", "LUGAL <unk>", "𒈗<unk>"), 3: ("", "", ""), 4: ("lugal", "LUGAL", "𒈗"),
    5: ("...-lugal" + " lugal-ki" * 50, "... LUGAL" + " LUGAL KI" * 50, "...𒈗" + " 𒈗𒆠" * 50),
    6: ("<unk> \n <SURFACE> <unk>", "<unk> \n <SURFACE> <unk>", "<unk> \n <SURFACE> <unk>"),
}


@pytest.mark.parametrize("small", [True, False])
def test_parallel_strings(spark, lookups, small):
    sides = L.SignLookups(lookups.readings, lookups.glyphs, lookups.only, small)
    docs = spark.createDataFrame(DOCS, "id int, text string, period string")
    toks = R.resolved_tokens(docs, sides, "text", ["id", "period"]).cache()
    built = {r.id: (r.transliteration, r.glyph_names, r.glyphs) for r in R.rebuilt(toks, ["id", "period"]).collect()}
    assert built == BUILT
    post = {r.id: r for r in R.postprocessed(R.rebuilt(toks, ["id"])).collect()}
    assert post[1].transliteration == "lugal-ki{ki}...\nlugal" and post[1].glyphs == "𒈗𒆠𒆠...\n𒈗"
    assert post[2].transliteration == "lugal <unk>"
    toks.unpersist()


def test_bare_names_may_be_kept(spark, lookups):
    sides = L.SignLookups.of(lookups.readings, lookups.glyphs, keep_named=True)
    df = spark.createDataFrame([("LUGAL",), ("UŠ₂",), ("QQ",)], "morpheme string")
    got = {r.morpheme: (r.reading, r.glyph) for r in R.resolve(df, sides).collect()}
    assert got == {"LUGAL": ("LUGAL", "𒈗"), "UŠ₂": ("UŠ₂", "𒍗"), "QQ": ("<unk>", "<unk>")}


def test_reports(spark, lookups):
    docs = spark.createDataFrame(DOCS, "id int, text string, period string")
    toks = R.resolved_counts(docs, lookups, "text").cache()
    stats = {(r.step, r.outcome): (r.n, r.percent) for r in R.conversion_stats(toks).collect()}
    # 112 morphemes besides special tokens; `gibberish` and `an` fail; x and nn have no glyph lookup
    total = sum(n for (step, _), (n, _) in stats.items() if step == "morpheme")
    assert stats["morpheme", "not_converted"] == (2, round(200 / total, 2))
    assert stats["name", "not_converted"][0] == 0
    failures = {(r.reason, r.morpheme): r.n for r in R.failure_counts(toks).collect()}
    assert failures == {("other", "gibberish"): 1, ("ambiguous", "an"): 1}
    seen = {(r.glyph, r.reading): r.n for r in R.observed_readings(toks).collect()}
    assert seen["𒈗", "lugal"] == 55 and seen["𒆠", "{ki}"] == 1 and ("...", "...") not in seen
    toks.unpersist()


def test_frequency_join_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(R, "FREQUENT", 2)
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    right = left.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    right = right.withColumn("v", F.upper("k"))
    got = R.join_by_frequency(left, right, "k", ["id"]).collect()
    assert len(got) == 3000
    assert all(r.v == (None if r.k in (None, "k3") else r.k.upper()) for r in got)


def test_no_key_of_a_shuffle_join_is_hot(spark):
    from parcorp.operators import resolve

    same_base = [(f"ki({c}{i})", "<unk>") for i in range(1000) for c in "ab"]
    same_name = [(f"r{i}", "KI") for i in range(1000)]
    df = spark.createDataFrame(same_base + same_name, "morpheme string, _name string")
    cols = {"_m": "morpheme", "_plain": "morpheme", "_lower": "lower(morpheme)", "_base": "split(morpheme, '[(]')[0]",
            "_paren": "contains(morpheme, '(')"}
    asked = resolve.asked_keys(df.withColumns({k: F.expr(v) for k, v in cols.items()}))
    for rows, keys in ((asked, ["kind", "key", "salt"]), (resolve.named_keys(df), ["_key", "_salt"])):
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        assert most < 0.05 * rows.count()


def test_large_lookups_give_the_same(spark):
    readings = spark.createDataFrame(
        [("ki", ["KI"]), ("a", ["A", "B"]), ("lu", ["LU"]), ("7(diš)", ["SEVEN"]), ("geš", [])], "reading string, names array<string>")
    glyphs = spark.createDataFrame([("KI", "𒆠"), ("A", "𒀀"), ("LU", ""), ("SEVEN", "X"), ("Y", "𒀁")], "name string, glyph string")
    words = ["ki", "{ki}", "KI", "a", "LU", "lu", "Y", "zu", "ZU", "x", "7(diš)", "9(diš)", "a(B)", "a(C)", "zu(KI)", "ki(Q)", "geš₂", "q(LU"]
    df = spark.createDataFrame([(w,) for w in words], "morpheme string")
    out = []
    for limit in (1 << 30, 0):
        lookups = L.SignLookups.of(readings, glyphs, limit=limit)
        assert lookups.small == (limit > 0)
        out.append(sorted(map(repr, R.resolve(df, lookups).select("morpheme", *R.RESULT).collect())))
    assert out[0] == out[1]


def test_only_distinct_wordforms_are_split(spark):
    from parcorp.functions.tokens import distinct_morphemes, tokens

    texts = ["a-b {d}-c 7-bi a-b\na-b ... <RULING>", "a-b - x-", None, "", "| a"]
    df = spark.createDataFrame([(t, g) for t in texts * 3 for g in ("p", None)], "t string, g string")
    plain = tokens(df, "t", ["g"]).where("morpheme IS NOT NULL AND NOT special").groupBy("g", "morpheme").count()
    got = distinct_morphemes(df, "t", ["g"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    counts = R.morpheme_counts(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count("Aggregate") == 2  # wordforms, then morphemes


@pytest.mark.parametrize("small", [True, False])
def test_rows_of_morphemes_stay_in_their_place(spark, lookups, monkeypatch, small):
    """Texts decide how many places there are; only texts, keys and answers are shuffled."""
    monkeypatch.setattr(R, "PLACE_BYTES", 2000)
    monkeypatch.setattr(R, "FREQUENT", 3)
    sides = L.SignLookups(lookups.readings, lookups.glyphs, lookups.only, small)
    docs = spark.createDataFrame([(i, f"lugal-ki r{i}-x an " * 20 + f"zz{i % 7}(GAL) nn") for i in range(200)], "id int, text string")
    toks = R.resolved_tokens(docs, sides, "text", ["id"])
    size = sum(len(r.text) for r in docs.collect())
    assert toks.rdd.getNumPartitions() >= size / 2000  # 4 by the session's setting
    built = R.rebuilt(toks, ["id"])
    plan = built._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Join" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = {r.id: r for r in built.collect()}
    for i in range(200):
        u = "<unk>"
        assert got[i].transliteration == " ".join([f"lugal-ki {u}-... {u}"] * 20) + " gal"
        assert got[i].glyphs == " ".join([f"𒈗𒆠 {u}... {u}"] * 20) + " 𒃲"


@pytest.mark.parametrize("frequent", [0, 2, 10**6])
def test_frequency_join_by_placed_keys(spark, monkeypatch, frequent):
    """Any border between frequent and other keys gives the same rows, nulls and repeats included."""
    monkeypatch.setattr(R, "FREQUENT", frequent)
    rows = [(i % 40, None if i % 11 == 0 else f"k{min(i % 97, i % 13)}") for i in range(2000)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = left.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    out = R.join_by_frequency(left, right, "k", ["id"])
    assert out.columns == ["id", "k", "v"]
    want = sorted((i, k or "", "" if k in (None, "k3") else k.upper()) for i, k in rows)
    assert sorted((r.id, r.k or "", r.v or "") for r in out.collect()) == want
    often, seldom = R.split_by_frequency(right)
    assert often.count() <= frequent and often.count() + seldom.count() == right.count()
    if frequent == 2:
        assert often.agg(F.min("n")).first()[0] > seldom.agg(F.max("n")).first()[0]


def test_large_lookups_are_not_repeated(spark):
    """Lookups pass through the join once: what is repeated for salts is only what shared keys hit."""
    readings = spark.createDataFrame([(f"r{i}", ["A"]) for i in range(2000)], "reading string, names array<string>")
    glyphs = spark.createDataFrame([("A", "𒀀")], "name string, glyph string")
    lookups = L.SignLookups.of(readings, glyphs, limit=0)
    df = spark.createDataFrame([("r7",), ("r8(A)",), ("r8(B)",), ("q",)], "morpheme string")
    hits = R._looked_up_large(df.selectExpr(
        "morpheme", "morpheme AS _m", "morpheme AS _plain", "lower(morpheme) AS _lower", "split(morpheme, '[(]')[0] AS _base",
        "'A' AS _name", "contains(morpheme, '(') AS _paren"), lookups)
    got = {r.morpheme: (r._plain_names, r._base_names) for r in hits.collect()}
    assert got == {"r7": (["A"], None), "r8(A)": (None, ["A"]), "r8(B)": (None, ["A"]), "q": (None, None)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    salted = [i for i, line in enumerate(plan) if "Generate explode" in line and "[salt" in line]
    assert salted and all("Join Inner" in "".join(plan[i + 1:i + 4]) for i in salted)  # behind the join with the lookups
