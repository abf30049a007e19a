import random
import time

import pytest
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions import cleaning as C
from parcorp.functions.text import is_upper, replace_in_order, strip

M = K.MISSING


def stages(spark, steps, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.t for r in sorted(C.run_stages(df, "t", steps).collect())]


@pytest.mark.parametrize("steps, before, after", [
    ([C.DOUBLE_ANGLE_BRACKETS], "<<lugal>> e", "lugal e"),
    ([C.UPPER_BRACKETS], "⸢a⸣-b", "a-b"),
    ([C.GLOSSES_IN_LINE, C.GLOSSES_FROM_LINE_START], "a {{b c}} d\ne f}} g", "a  d\n g"),
    (C.COLLAPSE, "a - \n - b  c--d", "a\nb c-d"),
    (C.COLLAPSE, f"a {M} - {M}\n{M}\n{M}\nb", f"a{M}\n{M}\nb"),
    ([C.VERTICAL_BARS], "|A.B|gu", "|A.B|-gu"),
    ([C.VERTICAL_BARS], "|A.B|gu |a|", "|A.B|-gu |a|"),
    (C.ENCLOSURES, "([x)x]", "[(x)x]"),
    (C.ENCLOSURES, "[a(b])", "[a(b)]"),
    (C.ENCLOSURES, "{[a}b]", "[{a}b]"),
    (C.ENCLOSURES, "[a{b]}", "[a{b}]"),
    (C.ENCLOSURES, "<a{b>}", "<a{b}>"),
    (C.ENCLOSURES, "{<a}", "<{a}"),
    (C.ANGLE_BRACKETS, "a <b> c", "a  c"),
    (C.ANGLE_BRACKETS, "a <b c\nd\ne f> g", f"a {M}\nd\n{M} g"),
    (C.PARENTHESES, "(c)d (-a--)", "(c)-d (a)-"),
    (C.SQUARE_BRACKETS, "[lugal [x] kur] e", f"{M} e"),
    (C.SQUARE_BRACKETS, "a [b\nc] d", f"a {M}\n{M} d"),
    ([C.ILLEGIBLE_ALONE], " x x-n lugal", f" {M} {M}-{M} lugal"),
    ([C.ILLEGIBLE_IN_CONTEXT], "a(x) b-o-c", f"a{M} b {M} c"),
    ([C.ILLEGIBLE_IN_CONTEXT], f"{M}x a x{M} n$", f"{M}a{M}{M}"),
    ([C.DAMAGE_NOTES], "a ($erasure$) $ traces $ $AN", f"a {M} {M} {M}"),
    ([C.ELLIPSES], "a...b", f"a{M}b"),
    ([C.STANDALONE_PARENS], "(a) b-(c)-d(e)", " b--d(e)"),
    (C.MISSING_IN_ENCLOSURE, f"{{ {M}- }} ({M})", f"{M} {M}"),
    ([C.EMPTY_ENCLOSURES], "a{}b()", "ab"),
    ([C.SPECIAL_TOKENS], f"{M} #SURFACE#", "... <SURFACE>"),
])
def test_stage(spark, steps, before, after):
    assert stages(spark, steps, [before]) == [after]


def test_repeated_markup_takes_one_replacement(spark):
    # each of these matches was once replaced over the whole text: minutes for this one
    n = 40_000
    text = " ".join(["([x x) x] a", "[a(b]) {{is}}", "[a{b]} <a{b>}"] * n)
    start = time.perf_counter()
    got = stages(spark, [C.GLOSSES_IN_LINE, *(C.ENCLOSURES[i] for i in (0, 1, 3, 4))], [text])
    assert time.perf_counter() - start < 20
    assert got == [" ".join(["[(x x) x] a", "[a(b)] ", "[a{b}] <a{b}>"] * n)]


@pytest.mark.parametrize("steps, before, after", [
    # a removal or repair inside another match, or one that makes a new match
    ([C.GLOSSES_IN_LINE], "{{a}} {{{b}} {{b{{a}}", "  {{b"),
    (C.ENCLOSURES, "[a{b]}} [a{b}]}", "[a{b}}] [a{b}}]"),
    # markers that share a "#" are one marker and a word
    (C.COLLAPSE, f"{M}MISSING# a", f"{M}MISSING# a"),
    # a sign that only comes into a context through another one
    ([C.ILLEGIBLE_IN_CONTEXT], "(x)o a", f"{M}a"),
    ([C.ILLEGIBLE_IN_CONTEXT], "-x$o- a", f"{M} a"),
])
def test_corner_cases_of_one_pass_stages(spark, steps, before, after):
    assert stages(spark, steps, [before]) == [after]


def test_rounds_stop_at_texts_left_alone(spark):
    # a second round still finds what the first one brought about
    rows = [("P467714", "a x) b"), ("p", "a"), ("q", "b -x-o- x-n"), ("r", None)]
    df = spark.createDataFrame(rows, "id string, transliteration string")
    out = {r.id: r.transliteration_clean for r in C.clean(df).collect()}
    assert out == {"P467714": "a...) b", "p": "a", "q": "b...", "r": None}


def test_long_runs_need_no_stack(spark):
    runs = ["a" + " -" * 40_000 + "\n" * 40_000 + "b", "a" + f"{M} " * 20_000 + "b",
            "a" + f"\n{M}" * 20_000 + "\nb"]
    assert stages(spark, C.COLLAPSE, runs) == ["a\nb", f"a{M}b", f"a\n{M}\nb"]


def test_chain(spark):
    rows = [
        ("P1", "[lugal] e₂ <gal>\n|A.B|gu x x"), ("P2", "[x x x]"), ("P3", "#SURFACE#\n..."),
        ("P467714", "a (x x)"), ("P4", "x x\n[x]\n(x)\nmu"),
    ]
    df = spark.createDataFrame(rows, "id string, transliteration string")
    out = {r.id: r for r in C.clean(df, report="left", drop_empty=True).collect()}
    assert set(out) == {"P1", "P467714", "P4"}
    assert out["P1"].transliteration_clean == "...e₂\n|A.B|-gu..."
    assert out["P4"].transliteration_clean == "x...\n...\nmu"
    assert out["P1"].transliteration == rows[0][1]
    assert [tuple(x) for x in out["P4"].left] == []


def test_check_points_report_what_is_left(spark):
    df = spark.createDataFrame([("a", "b >> c\n{{d"), ("e", "f $ g [h")], "id string, transliteration string")
    out = C.clean(df, report="left").select("id", F.inline("left")).collect()
    assert {(r.id, r.check, r.marker) for r in out} >= {("a", "easy", "{{"), ("e", "missing", "$")}


def test_random_markup_leaves_no_finished_marker(spark):
    rng = random.Random(5)
    parts = ["a", "lu", " ", "-", "\n", "[", "]", "(", ")", "{", "}", "<", ">", "|", "x", "...", "$AN", ";"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, transliteration string")
    for row in C.clean(df).collect():
        assert not any(m in row.transliteration_clean for m in ["<<", "  ", M, " \n", "\n "])


def test_a_filter_on_the_result_stays_above_the_chain(spark):
    df = spark.createDataFrame([("a", "lugal")], "id string, transliteration string")
    out = C.clean(df).where("transliteration_clean <> ''")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert out.count() == 1


def test_content(apply):
    assert apply(C.has_content, ["...\n<SURFACE>", "... ...", "a", ""]) == [False, True, True, False]


def test_unmatched_brackets(apply):
    lines = ["a [b] c", "[a [b] c", "a] [b", "[" * 500 + "]" * 499, ""]
    assert apply(C.unmatched_brackets, lines) == ["", "[", "][", "[", ""]


def test_ordered_replacements_see_earlier_output(apply):
    assert apply(lambda t: replace_in_order(t, [("a", "b"), ("bb", "c")]), ["ab", "bb", "aab"]) == ["c", "c", "cb"]


def test_sign_replacements(apply):
    got = apply(lambda t: replace_in_order(t, K.SIGN_REPLACEMENTS), ["KWU147-BAD₃ kuₓ(KU₄)", "1/2(aš) +..."])
    assert got == ["LIL-|EZEN×BAD| ku₄", "1/2 ..."]
    assert len(K.SIGN_REPLACEMENTS) == 87 and len(K.NUMBER_READINGS) == 33


def test_strip_and_is_upper(apply):
    values = [" \x1c a b \n", "", " \n", "x"]
    assert apply(strip, values) == [v.strip() for v in values]
    names = ["SANGAₓ", "|ŠU₂.3xAN|", "AN@g", "UŠ₂", "1(DIŠ)", "LAK449", "a", "", "ǅ", "A", "Ⅷ", "Ⓐ", "ⓐ"]
    assert apply(is_upper, names) == [n.isupper() for n in names]
