"""Editorial-markup cleaning as an ordered list of column rewrites.

Patterns use possessive quantifiers and run-start look-behinds where that matches the
same text: a long run of blanks, hyphens or markers then costs linear time and no
stack, however long the document is. Each stage names literals without which it cannot
change a text, so clean texts skip the regular expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import (
    remove_all, replace_in_order, replace_pairs, rewrite_matches,
)

M = K.MISSING


@dataclass(frozen=True)
class Stage:
    """A rewrite that leaves alone every text holding none of `needs`."""

    name: str
    rewrite: Callable[[Column], Column]
    needs: tuple[str, ...] = ()

    def __call__(self, t: Column) -> Column:
        if not self.needs:
            return self.rewrite(t)
        found = F.contains(t, F.lit(self.needs[0]))
        for literal in self.needs[1:]:
            found = found | F.contains(t, F.lit(literal))
        return F.when(found, self.rewrite(t)).otherwise(t)


def regex_stage(name: str, pattern: str, repl: str, *needs: str) -> Stage:
    return Stage(name, lambda t: F.regexp_replace(t, pattern, repl), needs)


def pairs_stage(name: str, pairs: list[tuple[str, str]], *needs: str) -> Stage:
    return Stage(name, lambda t: replace_in_order(t, pairs), needs)


def short_runs_first(name: str, pattern: str, repl: str, *needs: str, rounds: int = 1) -> Stage:
    """Collapse runs to `repl`. All but long runs are gone once each of `needs` has been
    replaced by `repl` in turn; only texts that still hold one then run the pattern."""
    rest = regex_stage(name, pattern, repl, *needs)
    pairs = [(n, repl) for n in needs] * rounds
    return Stage(name, lambda t: replace_in_order(t, pairs, finish=rest), needs)


# ---- easy wins -----------------------------------------------------------------------
DOUBLE_ANGLE_BRACKETS = pairs_stage("double_angle_brackets", [("<<", ""), (">>", "")])
UPPER_BRACKETS = pairs_stage("upper_brackets", [("⸢", ""), ("⸣", "")])


def _glosses_in_line(t: Column) -> Column:
    """One pass takes out the glosses without braces in them. If that leaves no "{{", and no
    text "{{{" was there, these were all glosses; other texts go match by match."""
    nested = rewrite_matches(t, r"\{\{[^\n]*?\}\}", lambda m: F.lit(""))
    plain = F.array(F.regexp_replace(t, r"\{\{[^\n{}]*+\}\}", ""))
    return F.when(F.contains(t, F.lit("{{{")), nested).otherwise(
        F.transform(plain, lambda p: F.when(F.contains(p, F.lit("{{")), nested).otherwise(p))[0]
    )


GLOSSES_IN_LINE = Stage("glosses_in_line", _glosses_in_line, ("{{",))
GLOSSES_FROM_LINE_START = Stage(
    "glosses_from_line_start",
    lambda t: rewrite_matches(t, r"\n[^\n]*?\}\}", lambda m: F.lit("\n")), ("}}",),
)
# One newline, blank, hyphen or missing-marker where there was a run of them.
COLLAPSE = [
    short_runs_first("newlines", r"(?<![ -])[ -]*+\n[ \n-]*+", "\n",
                     " \n", "-\n", "\n ", "\n-", "\n\n"),
    short_runs_first("blanks", r" [ -]++|-(?<!--)-*+ [ -]*+", " ", "- ", " -", "  ", rounds=2),
    short_runs_first("hyphens", r"-{2,}+", "-", "--", rounds=2),
    # not by literals: two markers may share a "#"
    regex_stage("missing_runs", rf"(?:{M}|[ -](?=[ #-])(?<![ -][ -])[ -]*+{M})(?:[ -]|{M})*+", M,
                M + " ", M + "-", M + M, " " + M, "-" + M),
    regex_stage("missing_lines", rf"(?:\n{M}(?=\n))++", "\n" + M, f"\n{M}\n{M}\n"),
]

# ---- enclosures out of order: pattern, misplaced pair, pair in order --------------------
ENCLOSURE_REPAIRS = [
    (r"\(\[[- x]*+\)[- x]*+\]", "([", "[("),
    (r"\[[^\n(\]]*+\([^\n)\]]*+\]\)", "])", ")]"),
    (r"\{\[[^\n}\]]*+\}[^\n\]]*+\]", "{[", "[{"),
    (r"\[[^\n{\]]*+\{[^\n\]]*+\]\}", "]}", "}]"),
    (r"<[^\n{>]*+\{[^\n}>]*+>\}", ">}", "}>"),
    (r"\{<[^\n}>]*+\}", "{<", "<{"),
]


# The same in one pass, and the text that a second repair might need: in all other texts,
# every place that reads like a match is one, or ends with one, and no repair makes another.
ENCLOSURE_PASSES = {
    "([": (r"\(\[([- x]*+\)[- x]*+\])", "[($1", None),
    "])": (r"(\[[^\n(\]]*+\([^\n)\]]*+)\]\)", "$1)]", None),
    "]}": (r"(\[[^\n{\]]*+\{[^\n\]]*+)\]\}", "$1}]", "]}}"),
    ">}": (r"(<[^\n{>]*+\{[^\n}>]*+)>\}", "$1}>", None),
}


def enclosure_repair(pattern: str, wrong: str, right: str) -> Stage:
    def each_match(t: Column) -> Column:
        return rewrite_matches(t, pattern, lambda m: F.replace(m, F.lit(wrong), F.lit(right)))

    def one_pass(t: Column) -> Column:
        once, repl, twice = ENCLOSURE_PASSES[wrong]
        out = F.regexp_replace(t, once, repl)
        return out if twice is None else F.when(F.contains(t, F.lit(twice)), each_match(t)).otherwise(out)

    return Stage(f"enclosure {wrong}", one_pass if wrong in ENCLOSURE_PASSES else each_match, (wrong,))


ENCLOSURES = [enclosure_repair(*repair) for repair in ENCLOSURE_REPAIRS]

# ---- other elements -------------------------------------------------------------------
ANGLE_BRACKETS = [
    regex_stage("angle_pair", r"<[^\n>]*+>", "", "<"),
    regex_stage("angle_open", r"<[^\n>]*+(?:\n|\z)", M + "\n", "<"),
    regex_stage("angle_close", r"(?:\n|\A)[^\n<>]*+>", "\n" + M, ">"),
]
SEMICOLONS = pairs_stage("semicolons", [(";", "\n")])
CURLY_BRACES = pairs_stage("curly_braces", [("{-", "{"), ("-}", "}")])


def _bars(t: Column) -> Column:
    """A hyphen after each |SIGN|, none inside it.

    Each distinct sign is rewritten once. Rewriting per occurrence would only lengthen
    the hyphen runs (quadratically in a long text); `COLLAPSE` follows and removes them.
    """
    return rewrite_matches(
        t, r"\|[^|a-z]*+\|",
        rewrite=lambda m: F.concat(F.replace(m, F.lit("-"), F.lit("")), F.lit("-")),
        find=lambda m: F.replace(m, F.lit("-"), F.lit("")),
        distinct=True,
    )


VERTICAL_BARS = Stage("vertical_bars", _bars, ("|",))
PARENTHESES = [
    regex_stage("hyphen_in_paren", r"-(?<!--)-*+\)", ")-", "-)"),
    regex_stage("letter_after_paren", r"\)([a-zA-Z])", ")-$1", ")"),
    pairs_stage("hyphen_after_paren", [("(-", "(")]),
]

# ---- missing text -----------------------------------------------------------------------
SQUARE_BRACKETS = [
    regex_stage("square_pair", r"\[[^\[\]\n]*+\]", M, "["),
    regex_stage("square_pair_outer", r"\[[^\[\]\n]*+\]", M, "["),
    regex_stage("square_open", r"\[[^\[\]\n]*+\n", M + "\n", "["),
    regex_stage("square_close", r"\n[^\[\]\n]*+\]", "\n" + M, "]"),
]
ILLEGIBLE_ALONE = regex_stage(
    "illegible_alone", r"(?d)[xXnNo](?=[ \n-]|$)(?<=[ \n-][xXnNo])", M
)


# --- Fixed values: contexts of an illegible sign {c} and what the missing-marker {m} makes of them
ILLEGIBLE_CONTEXTS = [
    ("({c})", "{m}"), ("[{c}]", "{m}"),
    ("-{c}-", " {m} "), (" {c}-", " {m} "), ("-{c} ", " {m} "), (" {c} ", " {m} "),
    ("\n{c} ", "\n{m} "), (" {c}\n", " {m}\n"), (" {c}$", "{m}"), ("-{c}$", "{m}"),
    ("{m}{c} ", "{m}"), ("{m}{c}-", "{m}"), (" {c}{m}", "{m}"), ("-{c}{m}", "{m}"),
]


def illegible_pairs() -> list[tuple[str, str]]:
    """Literal contexts of an illegible sign, in order; `$` is a plain character here."""
    return [
        (find.format(c=c, m=M), repl.format(c=c, m=M))
        for c in K.ILLEGIBLE for find, repl in ILLEGIBLE_CONTEXTS
    ]


def _illegible_in_context(t: Column) -> Column:
    """The literal list runs only for the signs that the text holds near a context at all.

    Near: in brackets of its own (found with the closing one), or between two characters that
    other contexts or their replacements end and begin with. Only such neighbours of a sign
    ever change, and none into a bracket, so no replacement brings in another sign.
    """
    near = (
        r"[xonXON](?:(?=[ \n$#(\[-])(?<=[ \n$#)\]-][xonXON])"
        r"|\)(?<=\([xonXON]\))|\](?<=\[[xonXON]\]))"
    )
    by_sign: dict[str, list[dict[str, str]]] = {}
    for i, (find, repl) in enumerate(illegible_pairs()):
        sign = K.ILLEGIBLE[i // len(ILLEGIBLE_CONTEXTS)]
        key = find[1:] if find in (f"({sign})", f"[{sign}]") else sign
        by_sign.setdefault(key, []).append({"find": find, "repl": repl})
    pairs = F.from_json(
        F.lit(json.dumps(by_sign)), "map<string,array<struct<find:string,repl:string>>>"
    )
    found = F.array_intersect(
        F.array(*[F.lit(key) for key in by_sign]),
        F.regexp_extract_all(t, F.lit(near), F.lit(0)),
    )
    return replace_pairs(t, F.flatten(F.transform(found, lambda key: pairs[key])))


ILLEGIBLE_IN_CONTEXT = Stage("illegible_in_context", _illegible_in_context)
DAMAGE_NOTES = pairs_stage("damage_notes", [(note, M) for note in K.DAMAGE_NOTES], "$")
ELLIPSES = pairs_stage("ellipses", [("...", M)])
STANDALONE_PARENS = Stage(
    "standalone_parens",
    lambda t: rewrite_matches(
        t, r"(?d)(?:[\n -]|\A)(\([^\n)]++\))(?:[\n -]|$)", lambda m: F.lit(""), group=1
    ),
    ("(",),
)

# ---- enclosures left over -----------------------------------------------------------------
MISSING_IN_ENCLOSURE = [
    regex_stage("missing_in_parens", rf"\([ -]*+{M}[ -]*+\)", M, "("),
    regex_stage("missing_in_braces", rf"\{{[ -]*+{M}[ -]*+\}}", M, "{"),
]
EMPTY_ENCLOSURES = pairs_stage("empty_enclosures", [("{}", ""), ("()", "")])
SPECIAL_TOKENS = pairs_stage("special_tokens", K.MARKER_TO_TOKEN, "#")


# ---- the whole chain -------------------------------------------------------------------
@dataclass(frozen=True)
class Check:
    """A point where none of the named markers should be left."""

    name: str


@dataclass(frozen=True)
class Fix:
    """A point where the curated corrections of a step go in."""

    step: str


@dataclass(frozen=True)
class Rounds:
    """Steps to be run so many times. A text that a round left as it was needs no other."""

    steps: tuple[Stage | Fix, ...]
    times: int


EASY = [DOUBLE_ANGLE_BRACKETS, UPPER_BRACKETS, GLOSSES_IN_LINE, GLOSSES_FROM_LINE_START]
ILLEGIBLE = Rounds((ILLEGIBLE_ALONE, ILLEGIBLE_IN_CONTEXT, Fix("illegible")), 3)
CHAIN: list[Stage | Check | Fix | Rounds] = [
    *EASY, *COLLAPSE, Check("easy"),
    Fix("unmatched"), *ENCLOSURES, Fix("enclosure"),
    *ANGLE_BRACKETS, SEMICOLONS, CURLY_BRACES, VERTICAL_BARS, *PARENTHESES,
    *COLLAPSE, Check("enclosure"),
    *SQUARE_BRACKETS, ILLEGIBLE, DAMAGE_NOTES, ELLIPSES,
    STANDALONE_PARENS, *COLLAPSE, Check("missing"),
    *MISSING_IN_ENCLOSURE, EMPTY_ENCLOSURES, *COLLAPSE, Check("final"),
    SPECIAL_TOKENS,
]


def markers_left(text: Column, markers: list[str]) -> Column:
    """Those of the markers that the text still holds."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def _checked(text: Column, check: str) -> Column:
    return F.transform(
        markers_left(text, K.DISALLOWED[check]),
        lambda m: F.struct(F.lit(check).alias("check"), m.alias("marker")),
    )


def fixed_text(text: Column, row_id: Column, step: str) -> Column:
    """Apply the curated corrections of one step to the texts they name."""
    out = text
    for fix_step, fix_id, find, repl in K.TEXT_FIXES:
        if fix_step == step:  # ids are distinct within a step
            out = F.when(row_id == fix_id, F.replace(text, F.lit(find), F.lit(repl))).otherwise(out)
    return out


def run_stages(df: DataFrame, column: str, stages: Sequence[Stage]) -> DataFrame:
    """Rewrite a column stage by stage.

    One projection per stage: an expression that reads its input more than once would
    otherwise multiply with every stage nested on top of it.
    """
    for stage in stages:
        df = df.withColumn(column, stage(F.col(column)))
    return df


def clean(
    df: DataFrame, text: str = "transliteration", out: str = "transliteration_clean",
    row_id: str = "id", report: str | None = None, drop_empty: bool = False,
) -> DataFrame:
    """Run the chain on `text` into `out`, in one narrow pass over the rows.

    `report` names a column of (check, marker) structs for the markers left at each
    check point. `drop_empty` drops the texts that have no content left.

    The result leaves through a one-element `explode`. Without it the optimizer would
    push a later filter on `out` below all stages, copying their expressions into it.
    """
    def rewritten(step: Stage | Fix) -> Column:
        if isinstance(step, Stage):
            return step(F.col(out))
        return fixed_text(F.col(out), F.col(row_id).cast("string"), step.step)

    columns = df.columns
    df = df.withColumn(out, F.col(text))
    reports: list[str] = []
    for step in CHAIN:
        if isinstance(step, Stage | Fix):
            df = df.withColumn(out, rewritten(step))
        elif isinstance(step, Rounds):
            df = df.withColumn("_settled", F.lit(False))
            for _ in range(step.times):
                df = df.withColumn("_before", F.col(out))
                for part in step.steps:
                    df = df.withColumn(
                        out, F.when(F.col("_settled"), F.col(out)).otherwise(rewritten(part))
                    )
                df = df.withColumn("_settled", F.col(out).eqNullSafe(F.col("_before")))
        elif report is not None:
            reports.append(f"_{step.name}")
            df = df.withColumn(reports[-1], _checked(F.col(out), step.name))
    fields = [F.col(out).alias("text")]
    if report is not None:
        fields.append(F.flatten(F.array(*[F.col(r) for r in reports])).alias("report"))
    result = F.array(F.struct(*fields))
    if drop_empty:
        result = F.filter(result, lambda r: has_content(r["text"]))
    df = df.select(*[c for c in columns if c != out], F.explode(result).alias("_r"))
    df = df.withColumn(out, F.col("_r.text"))
    if report is not None:
        df = df.withColumn(report, F.col("_r.report"))
    return df.drop("_r")


def has_content(text: Column) -> Column:
    """Something is left besides special tokens (a newline is one, a blank is not)."""
    return remove_all(text, K.CLEAN_TOKENS) != ""


def unmatched_brackets(line: Column) -> Column:
    """What is left of a line's square brackets once all pairs are taken out."""

    def state(close: Column, open_: Column) -> Column:
        return F.struct(close.alias("close"), open_.alias("open"))

    return F.aggregate(
        F.regexp_extract_all(line, F.lit(r"[\[\]]"), F.lit(0)),
        state(F.lit(0), F.lit(0)),
        lambda s, b: F.when(b == "[", state(s["close"], s["open"] + 1))
        .when(s["open"] > 0, state(s["close"], s["open"] - 1))
        .otherwise(state(s["close"] + 1, s["open"])),
        lambda s: F.concat(F.repeat(F.lit("]"), s["close"]), F.repeat(F.lit("["), s["open"])),
    )
