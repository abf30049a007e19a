"""Every cleaning stage against plain regular expressions on random markup."""

import random
import re

import pytest

from parcorp import constants as K
from parcorp.functions import cleaning as C

M = K.MISSING


def each_match(pattern, new, group=0, old=lambda m: m):
    def run(t):
        for found in [m.group(group) for m in re.finditer(pattern, t)]:
            t = t.replace(old(found), new(found))
        return t

    return run


def regexes(*pairs):
    def run(t):
        for pattern, repl in pairs:
            t = re.sub(pattern, repl, t)
        return t

    return run


def literals(pairs):
    def run(t):
        for a, b in pairs:
            t = t.replace(a, b)
        return t

    return run


def chain(*steps):
    def run(t):
        for step in steps:
            t = step(t)
        return t

    return run


HYPHENS = regexes((r"-+", "-"))
PLAIN = {
    "gloss": ([C.GLOSSES_IN_LINE, C.GLOSSES_FROM_LINE_START],
              chain(each_match(r"\{\{[^\n]*?\}\}", lambda m: ""), each_match(r"\n[^\n]*?\}\}", lambda m: "\n"))),
    "collapse": (C.COLLAPSE, regexes(
        (r"([ -]*\n[ -]*)+", "\n"), (r"(-* -*)+", " "), (r"-+", "-"),
        (rf"([ -]*{M}[ -]*)+", M), (rf"(\n{M}(?=\n))+", "\n" + M))),
    "enclosures": (C.ENCLOSURES, chain(
        each_match(r"\(\[[- x]*?\)[- x]*?\]", lambda m: m.replace("([", "[(")),
        each_match(r"\[[^\n(\]]*?\([^\n)\]]*?\]\)", lambda m: m.replace("])", ")]")),
        each_match(r"\{\[[^\n}\]]*?\}[^\n\]]*?\]", lambda m: m.replace("{[", "[{")),
        each_match(r"\[[^\n{\]]*?\{[^\n\]]*?\]\}", lambda m: m.replace("]}", "}]")),
        each_match(r"<[^\n{>]*?\{[^\n}>]*?>\}", lambda m: m.replace(">}", "}>")),
        each_match(r"\{<[^\n}>]*?\}", lambda m: m.replace("{<", "<{")))),
    "angle": (C.ANGLE_BRACKETS, regexes(
        (r"<[^\n]*?>", ""), (r"<[^\n>]*?(\n|$)", M + "\n"), (r"(\n|^)[^\n<]*?>", "\n" + M))),
    # repeated rewriting only lengthens hyphen runs
    "bars": ([C.VERTICAL_BARS, C.COLLAPSE[2]], chain(each_match(
        r"\|[^|a-z]*?\|", lambda m: m.replace("-", "") + "-", old=lambda m: m.replace("-", "")), HYPHENS)),
    "parens": (C.PARENTHESES, regexes((r"-+\)", ")-"), (r"\)([a-zA-Z])", r")-\1"), (r"\(-", "("))),
    "square": (C.SQUARE_BRACKETS, regexes(
        (r"\[[^\[\]\n]*?\]", M), (r"\[[^\[\]\n]*?\]", M), (r"\[[^\[\]\n]*?\n", M + "\n"),
        (r"\n[^\[\]\n]*?\]", "\n" + M))),
    "illegible": ([C.ILLEGIBLE_ALONE, C.ILLEGIBLE_IN_CONTEXT], chain(
        regexes((r"([ \n-])[xXnNo](?=[ \n-]|$)", r"\1" + M)), literals(C.illegible_pairs()))),
    "standalone": ([C.STANDALONE_PARENS], each_match(
        r"(?:^|\n| |-)(\([^\n)]+\))(?:$|\n| |-)", lambda m: "", group=1)),
    "missing": (C.MISSING_IN_ENCLOSURE, regexes((rf"\([ -]*{M}[ -]*\)", M), (rf"\{{[ -]*{M}[ -]*\}}", M))),
}
PARTS = ["a", "lu", "A", " ", "  ", "-", "--", "\n", "[", "]", "(", ")", "{", "}", "{{", "}}", "<", ">", "|",
         "x", "o", "N", M, "$", " ", "\u0085", "𒀭", "(x)", " x ", "[x", "x]"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)]


@pytest.mark.parametrize("name", list(PLAIN))
def test_stage_equals_plain_expressions(spark, texts, name):
    stages, plain = PLAIN[name]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.t for r in sorted(C.run_stages(df, "t", stages).collect())]
    want = [plain(t) for t in texts]
    different = [(t, w, g) for t, w, g in zip(texts, want, got) if w != g]
    assert not different, different[:3]
    assert sum(t != w for t, w in zip(texts, want)) > 10
