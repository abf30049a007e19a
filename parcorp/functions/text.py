"""Text expressions shared by the operators. All are native columns, no Python UDFs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_literal(pairs: Iterable[tuple[str, str]]) -> Column:
    """A constant array of (find, repl); the optimizer folds it into one literal."""
    rows = json.dumps([{"find": a, "repl": b} for a, b in pairs])
    return F.from_json(F.lit(rows), "array<struct<find:string,repl:string>>")


def replace_in_order(
    text: Column, pairs: Iterable[tuple[str, str]],
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """Literal replacements, each one seeing the output of those before it, `finish` the last.

    Folding over a constant array keeps the plan one level deep however long the list
    is; nesting `replace` hundreds of times would hit the generated-method size limit.
    Most texts lack most literals, and `contains` rules them out several times faster
    than `replace` does.
    """
    return replace_pairs(text, pairs_literal(pairs), finish)


def replace_pairs(
    text: Column, pairs: Column, finish: Callable[[Column], Column] | None = None
) -> Column:
    """The same for an array column of (find, repl)."""
    return F.aggregate(
        pairs, text, lambda acc, p: _replace_held(acc, p["find"], p["repl"]), finish
    )


def _replace_held(text: Column, find: Column, repl: Column) -> Column:
    return F.when(F.contains(text, find), F.replace(text, find, repl)).otherwise(text)


def remove_all(text: Column, tokens: Iterable[str]) -> Column:
    return replace_in_order(text, [(t, "") for t in tokens])


def rewrite_matches(
    text: Column, pattern: str, rewrite: Callable[[Column], Column], group: int = 0,
    find: Callable[[Column], Column] = lambda m: m, distinct: bool = False,
) -> Column:
    """Find the matches once, then replace every literal occurrence of each of them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if distinct:
        found = F.array_distinct(found)
    return F.aggregate(found, text, lambda acc, m: _replace_held(acc, find(m), rewrite(m)))


# The characters that count as white space at the ends of a text
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Cut white space at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_upper(text: Column) -> Column:
    """At least one upper-case character and no lower- or title-case one."""
    return text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")


def chars(text: Column) -> Column:
    """Code points as an array."""
    return F.array_remove(F.split(text, ""), "")


def seeded_md5(seed: int, *keys: Column) -> Column:
    """Reproducible pseudo-random hex key: the same on any cluster size."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_fraction(digest: Column, start: int) -> Column:
    """Eight hex digits of a digest (1-based start) as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def exploded(df: DataFrame, keep: Sequence[str], array: Column, *names: str, pos: str = "") -> DataFrame:
    """One row per element of an array expression, next to the `keep` columns.

    The array becomes a column first: inside the generator it would be interpreted, not
    compiled. The outer form keeps the optimizer from adding a not-empty filter, which
    it would push below that column and so evaluate the expression twice.
    """
    df = df.select(*keep, array.alias("_a"))
    if pos:
        df = df.select(*keep, F.posexplode_outer("_a").alias(pos, *names))
    else:
        df = df.select(*keep, F.explode_outer("_a").alias(*names))
    return df.where(F.col(names[0]).isNotNull())
