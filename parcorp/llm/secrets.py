"""Secrets in texts: fixed patterns, and character Markov models of token-like strings."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, in the order in which kinds are listed
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
# Equal to the greedy pattern followed by the length test: runs are maximal, so a
# shorter run that fails cannot hide a longer one.
SEARCHED = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MIN_VALUE = 6  # characters of an assigned value

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SYMBOLS = len(ALPHABET) + 1  # 0: any other character
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LLR_MILLI = 8000  # log-likelihood ratio in thousandths that a reported token reaches
CHUNK = 512


def _prefix_sums(a: Column) -> Column:
    """Sums of all elements before each one, in two levels, so that long arrays stay linear."""
    zero = F.array(F.lit(0).cast("bigint"))

    def grow(xs: Column, value) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))

    last = F.floor((F.size(a) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, lambda ch: grow(ch, lambda x: x.cast("bigint")))
    offsets = grow(inner, lambda x: F.element_at(x, -1))
    sums = F.zip_with(
        inner, F.slice(offsets, 1, F.size(offsets) - 1),
        lambda part, off: F.transform(F.slice(part, 1, F.size(part) - 1), lambda v: v + off),
    )
    return F.when(F.size(a) > 0, F.flatten(sums)).otherwise(F.slice(zero, 1, 0))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, match), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    starts = F.zip_with(_prefix_sums(steps), gaps, lambda p, g: p + F.length(g))
    return F.zip_with(
        F.slice(starts, 1, F.size(found)), found,
        lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")),
    )


def _found(text: Column, kind: str, pattern: str) -> Column:
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)")
    gate = text.rlike(pattern)
    if kind == "assign":
        gate = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & gate
    hits = matches(text, pattern)
    if kind == "assign":
        value = lambda m: F.regexp_extract(m["match"], pattern, 2)
        hits = F.filter(hits, lambda m: F.length(value(m)) >= MIN_VALUE)
    return F.when(gate, hits).otherwise(none)


def _codes(token: Column) -> Column:
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))


def bigrams(token: Column) -> Column:
    """Index (first symbol * SYMBOLS + second) of every pair of neighbouring characters."""
    codes = _codes(token)
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: a * SYMBOLS + b,
    )


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios of character pairs, in thousandths, from (token, random).

    First-order Markov models of both classes with add-one smoothing. What reaches the
    driver is one row per pair of symbols at most (4,624), however many samples there are.
    """
    pairs = samples.where("token IS NOT NULL AND random IS NOT NULL").select(
        "random", F.explode(bigrams(F.col("token"))).alias("pair")
    )
    counts = pairs.groupBy("pair").agg(
        F.sum(F.col("random").cast("bigint")).alias("r"),
        F.sum((~F.col("random")).cast("bigint")).alias("o"),
    )
    first = F.floor(F.col("pair") / SYMBOLS)
    totals = counts.groupBy(first.alias("f")).agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    grid = counts.sparkSession.range(SYMBOLS * SYMBOLS).withColumnRenamed("id", "pair")
    ratio = F.log(F.coalesce("r", F.lit(0)) + 1) - F.log(F.coalesce("rt", F.lit(0)) + SYMBOLS) \
        - F.log(F.coalesce("o", F.lit(0)) + 1) + F.log(F.coalesce("ot", F.lit(0)) + SYMBOLS)
    table = (
        grid.join(counts, "pair", "left").join(totals, first == F.col("f"), "left")
        .select("pair", F.round(ratio * 1000).cast("int").alias("llr"))
    )
    return [r.llr for r in sorted(table.collect())]


def llr(token: Column, model: list[int]) -> Column:
    """Sum of the model's ratios over a token, in thousandths."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    return F.aggregate(
        bigrams(token), F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.element_at(weights, (p + 1).cast("int")),
    )


def find(texts: DataFrame, model: list[int], text: str = "text", threshold: int = LLR_MILLI) -> DataFrame:
    """(row, assign, access, hex, markov) for every row: `row` holds all columns of `texts`,
    the others are arrays of (start, end, match), ends exclusive, positions in code points.

    Runs of 16 or more token characters are reported as `markov` when the model of random
    strings explains them better than that of ordinary identifiers by the threshold; they
    may cover spans of the fixed patterns, which always stay. Null texts count as empty
    and hold nothing; whole texts are searched, however long.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cols = {kind: _found(body, kind, pattern) for kind, pattern in SEARCHED.items()}
    tokens = _found(body, "markov", TOKEN)
    cols["markov"] = F.filter(tokens, lambda m: llr(m["match"], model) >= threshold)
    return texts.select(F.struct("*").alias("row"), *[c.alias(kind) for kind, c in cols.items()])


def listed(kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def tagged(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(
            m["start"].alias("start"), F.lit(i).alias("k"), m["end"].alias("end"),
            F.lit(kind).alias("kind")))

    parts = [tagged(i, kind) for i, kind in enumerate(kinds)]
    ordered = F.array_sort(F.concat(*parts))
    return F.array_join(
        F.transform(ordered, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ","
    )


FIT_DOCS = 2000
FIT_RANDOM = 2000


def labelled_samples(docs: DataFrame, row_id: str = "doc_id", text: str = "text",
                     fit_docs: int = FIT_DOCS, fit_random: int = FIT_RANDOM) -> DataFrame:
    """(token, random): random strings in the usual encodings, and as ordinary ones
    numbers and identifiers made of the words of about `fit_docs` texts (a bounded sample,
    chosen by a digest of the id)."""
    n = max(docs.count(), 1)
    bound = f"{min(fit_docs * 16**6 // n, 16**6):07x}"
    chosen = F.concat(F.lit("0"), F.substring(F.md5(F.col(row_id).cast("string")), 1, 6)) < F.lit(bound)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0))
    plain = docs.where(chosen).select(F.posexplode(words).alias("i", "w"))
    ordinary = plain.select(
        F.when(F.col("i") % 4 == 0, F.concat(F.lower("w"), F.lit("_"), F.lower("w")))
        .when(F.col("i") % 4 == 1, F.concat(F.lower("w"), F.initcap("w"), (F.col("i") % 10).cast("string")))
        .when(F.col("i") % 4 == 2, F.concat(F.upper("w"), F.lit("-"), F.lower("w")))
        .otherwise(F.col("w")).alias("token"),
        F.lit(False).alias("random"),
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = docs.sparkSession.range(fit_random).select(
        F.when(F.col("id") % 4 == 0, digest)
        .when(F.col("id") % 4 == 1, F.translate(F.base64(F.unhex(digest)), "\r\n", ""))
        .when(F.col("id") % 4 == 2, F.upper(F.translate(F.base64(F.unhex(digest)), "+/=\r\n", "")))
        .otherwise(F.translate(F.base64(F.unhex(digest)), "+/=\r\n", "-_"))
        .alias("token"),
        F.lit(True).alias("random"),
    )
    numbers = docs.sparkSession.range(fit_random).select(
        F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).alias("token"),
        F.lit(False).alias("random"),
    )
    return ordinary.unionByName(numbers).unionByName(random)
