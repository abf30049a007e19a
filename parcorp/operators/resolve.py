"""Morphemes to sign names and glyphs, and back to parallel strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp import constants as K
from parcorp.functions.text import is_upper, replace_in_order, strip
from parcorp.functions.tokens import distinct_morphemes, tokens
from parcorp.operators.lookups import SignLookups
from parcorp.session import BROADCAST_BYTES, fits_broadcast, materialised, row_bytes, size_in_bytes, stored

# What counts as a number
NUMERIC = r"(?dU)^\d+(/\d+)?(\.\d+)?(\s*\([^)]+\))?$"
UNK = K.UNK
FREQUENT = 300_000  # rows of the frequent part, which BROADCAST_BYTES bounds as well
SALTS = 16
PLACE = "_place"
PLACE_BYTES = 4 << 20  # of texts in one place; their morphemes' rows take many times the room
KEY = "array<struct<use:string,kind:string,key:string,salt:int>>"


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _first_hit(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def _looked_up_small(df: DataFrame, lookups: SignLookups) -> DataFrame:
    """The lookup results as columns, by broadcast joins."""
    for key in ("_plain", "_lower", "_base"):
        side = lookups.readings.select(F.col("reading").alias(key), F.col("names").alias(f"{key}_names"))
        df = df.join(F.broadcast(side), key, "left")
    only = lookups.only.select(F.col("name").alias("_name"), F.col("reading").alias("_only"))
    df = df.join(F.broadcast(only), "_name", "left")
    own = lookups.glyphs.select(F.col("name").alias("_m"), F.lit(True).alias("_is_name"))
    return df.join(F.broadcast(own), "_m", "left")


def asked_keys(df: DataFrame) -> DataFrame:
    """(_k, use, kind, key, salt): the keys that the rules of each morpheme can need.

    Keys that stand for the morpheme itself are as distinct as the morphemes; the base and
    the name in parentheses, which many morphemes may share, go only where there are any,
    and with a salt that what the lookups hold for them is repeated for.
    """
    salt = F.pmod(F.xxhash64("morpheme"), F.lit(SALTS)).cast("int")

    def key(use: str, kind: str, value: str, shared: bool = False) -> Column:
        return F.struct(F.lit(use).alias("use"), F.lit(kind).alias("kind"), F.col(value).alias("key"),
                        (salt if shared else F.lit(0)).alias("salt"))

    keys = F.concat(
        F.array(key("_plain", "reading", "_plain"), key("_is_name", "name", "_m")),
        F.when(F.col("_lower") != F.col("_plain"), F.array(key("_lower", "reading", "_lower"))).otherwise(F.array().cast(KEY)),
        F.when(F.col("_paren"), F.array(key("_base", "reading", "_base", True), key("_only", "only", "_name", True))).otherwise(
            F.array().cast(KEY)),
    )
    return df.select(F.col("morpheme").alias("_k"), F.explode(keys).alias("_q")).select("_k", "_q.*")


def _looked_up_large(df: DataFrame, lookups: SignLookups) -> DataFrame:
    """The same by one shuffle join for a table of distinct morphemes, whose keys go through
    it as rows and bring the hits (five at most) back by one aggregate."""
    asked, entries = asked_keys(df), lookups.entries()
    shared = F.col("use").isin("_base", "_only")
    # only entries that shared keys hit are repeated for their salts, not the lookups
    held = asked.where(shared).select("kind", "key").distinct().join(entries, ["kind", "key"])
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.where(~shared).join(entries, ["kind", "key"]).unionByName(
        asked.where(shared).join(held, ["kind", "key", "salt"]))

    def names(use: str) -> Column:
        return F.max(F.when(F.col("use") == use, F.col("names")))

    found = hits.groupBy("_k").agg(
        names("_plain").alias("_plain_names"), names("_lower").alias("_own_lower"), names("_base").alias("_base_names"),
        F.max(F.when(F.col("use") == "_only", F.col("only"))).alias("_only"),
        F.max(F.when(F.col("use") == "_is_name", F.lit(True))).alias("_is_name"))
    df = df.join(found, F.col("morpheme") == F.col("_k"), "left")
    same = F.col("_lower") == F.col("_plain")
    df = df.withColumn("_lower_names", F.when(same, F.col("_plain_names")).otherwise(F.col("_own_lower")))
    return df.drop("_k", "_own_lower")


def sign_names(df: DataFrame, lookups: SignLookups) -> DataFrame:
    """Add (value, names, reason) to a table with a `morpheme` column."""
    m = F.when(F.col("morpheme") == "geš₂", "ŋeš₂").otherwise(F.col("morpheme"))
    df = df.withColumn("_m", m)
    m = F.col("_m")
    parts = F.split(m, r"\(")
    # tests used by several rules are columns, so that they run once per row
    df = df.withColumns({
        "_paren": F.contains(m, F.lit("(")) & F.contains(m, F.lit(")")),
        "_numeric": m.rlike(NUMERIC), "_upper": is_upper(m),
        "_plain": F.translate(m, "{}", ""), "_lower": F.lower(m),
    })
    paren, numeric, upper = F.col("_paren"), F.col("_numeric"), F.col("_upper")
    df = df.withColumns({
        "_base": F.when(paren, F.get(parts, F.lit(0))).otherwise(m),
        "_name": F.when(paren, F.replace(F.get(parts, F.lit(1)), F.lit(")"), F.lit(""))).otherwise(m),
    })
    df = (_looked_up_small if lookups.small else _looked_up_large)(df, lookups)

    plain, lower, base = (F.col(f"{k}_names") for k in ("_plain", "_lower", "_base"))
    is_name = F.col("_is_name").isNotNull()

    def hit(value: Column, names: Column, reason: str | None = None) -> Column:
        return F.struct(
            value.alias("value"), names.alias("names"),
            F.lit(reason).cast("string").alias("reason"),
        )

    unk, ellipsis = m if lookups.keep_named else F.lit(UNK), F.lit(K.ELLIPSIS)
    name = F.col("_name")
    found = _first_hit([
        (m.isin("x", "n", "X", "N"), hit(ellipsis, F.array(ellipsis))),
        (numeric & plain.isNotNull(), hit(m, plain)),
        (numeric & lower.isNotNull(), hit(F.col("_lower"), lower)),
        (numeric & is_name, hit(m, F.array(m))),
        (numeric, hit(m, _no_names(), "number")),
        (is_name, hit(unk, F.array(m))),
        (plain.isNotNull(), hit(m, plain)),
        (upper & lower.isNotNull(), hit(unk, lower)),
        (upper, hit(unk, _no_names(), "sign_name")),
        (paren & (F.size(base) == 1), hit(F.col("_base"), base)),
        (paren & F.array_contains(base, name), hit(F.col("_base"), F.array(name))),
        (paren & F.col("_only").isNotNull(), hit(F.col("_only"), F.array(name))),
    ], hit(m, _no_names(), "other"))
    helpers = ["_m", "_paren", "_numeric", "_upper", "_plain", "_lower", "_base", "_name", "_plain_names", "_lower_names",
               "_base_names", "_only", "_is_name", "_found"]
    return (
        df.withColumn("_found", found)
        .withColumns({f: F.col(f"_found.{f}") for f in ("value", "names", "reason")})
        .drop(*helpers)
    )


def chosen_name(names: Column) -> Column:
    """Only a single candidate is accepted."""
    return F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.lit(UNK))


def named_keys(df: DataFrame) -> DataFrame:
    """Add the key (_key, _salt) that a name is looked up by: names are salted, and rows
    without a name, whose glyph does not matter, get a key of their own."""
    salt = F.pmod(F.xxhash64("morpheme"), F.lit(SALTS)).cast("int")
    own = F.concat(F.lit("\u0000"), "morpheme")
    return df.withColumn("_salt", salt).withColumn(
        "_key", F.when(F.col("_name") != UNK, F.col("_name")).otherwise(own))


def add_glyph(df: DataFrame, lookups: SignLookups) -> DataFrame:
    """From (value, names, reason) to (reading, glyph_name, glyph, dropped, …).

    `reason` says why no name was found, `name_status` what became of the name.
    """
    df = df.withColumn("_chosen", chosen_name(F.col("names")))
    chosen = F.col("_chosen")
    swapped = chosen
    for old, new in K.NAME_SWAPS:
        swapped = F.when(chosen == old, new).otherwise(swapped)
    df = df.withColumns({
        "converted": chosen != UNK,
        "reason": F.when(chosen == UNK, F.coalesce(
            "reason", F.when(F.size("names") > 1, "ambiguous").otherwise("no_name")
        )),
        "dropped": chosen == "N",
        "_reading": F.when(chosen == UNK, UNK).otherwise(F.col("value")),
        "_name": swapped,
    })
    side = lookups.glyphs.select(F.col("name").alias("_name"), F.col("glyph").alias("_glyph"))
    if lookups.small:
        df = df.join(F.broadcast(side), "_name", "left")
    else:
        side = side.select(F.col("_name").alias("_key"), "_glyph", F.explode(
            F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        df = named_keys(df).join(side, ["_key", "_salt"], "left").drop("_key", "_salt")
    name, glyph = F.col("_name"), F.col("_glyph")
    status = (
        F.when((F.col("_reading") == UNK) | F.col("dropped"), F.lit(None).cast("string"))
        .when(name.isin(K.PASS_THROUGH), "token")
        .when(glyph.isNull(), "not_in_map").when(glyph == "", "no_unicode").otherwise("found")
    )
    df = df.withColumn("name_status", status)
    sign = F.when(F.col("name_status") == "token", name).otherwise(glyph)
    known = (
        F.col("name_status").isin("token", "found") & (sign != UNK)
        & ~F.contains(sign, F.lit("X"))
    )
    unk = F.lit(UNK)
    return df.withColumns({
        "reading": F.when(known, F.col("_reading")).otherwise(unk),
        "glyph_name": F.when(known, name).otherwise(unk),
        "glyph": F.when(known, sign).otherwise(unk),
    }).drop("_chosen", "_reading", "_name", "_glyph", "value", "names")


RESULT = ["reading", "glyph_name", "glyph", "dropped", "converted", "reason", "name_status"]


def resolve(df: DataFrame, lookups: SignLookups) -> DataFrame:
    """Add the result columns to every row of a table with a `morpheme` column."""
    return add_glyph(sign_names(df, lookups), lookups)


def known_morphemes(lookups: SignLookups) -> DataFrame:
    """The results for all morphemes that stand in the lookups themselves."""
    return materialised(resolve(lookups.morphemes(), lookups).select("morpheme", *RESULT))


def resolve_small(df: DataFrame, lookups: SignLookups, known: DataFrame) -> DataFrame:
    """Resolve with broadcast lookups: nearly all rows by one join with `known`.

    The rules run for the others only. Rows already resolved carry a null into the rule
    lookups, which a broadcast join skips.
    """
    side = known.select(F.col("morpheme").alias("_key"), F.struct(*RESULT).alias("_known"))
    df = df.withColumnRenamed("morpheme", "_key").join(F.broadcast(side), "_key", "left")
    df = df.withColumn("morpheme", F.when(F.col("_known").isNull(), F.col("_key")))
    df = resolve(df, lookups)
    hit = F.col("_known").isNotNull()
    merged = {c: F.when(hit, F.col(f"_known.{c}")).otherwise(F.col(c)) for c in RESULT}
    return df.withColumns({**merged, "morpheme": F.col("_key")}).drop("_key", "_known")


def place_of(by: Sequence[str], places: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(places)).cast("int")


def _least_places(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_by_frequency(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest `n`, as many as FREQUENT and BROADCAST_BYTES allow, and the
    rest. The border is found from sums by size class of `n`: no rows are sorted."""
    level = F.floor(F.log2("n") * 16)
    sums = counted.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.sum(row_bytes(counted)).alias("b"))
    rows = size = 0
    border = None
    for r in sums.orderBy(F.desc("level")).collect():  # (some hundred classes at most)
        rows, size = rows + r.c, size + r.b
        if rows > FREQUENT or size > BROADCAST_BYTES:
            break
        border = r.level
    frequent = F.lit(False) if border is None else F.coalesce(level >= border, F.lit(False))
    return counted.where(frequent), counted.where(~frequent)


def join_by_frequency(
    left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], places: int = 0, asking: DataFrame | None = None
) -> DataFrame:
    """Left join with a table unique on `key` that counts the key's rows in `n`.

    The most frequent keys are joined by broadcast. For the others the rows of `left` stay
    in the places that `spread` deals them to: each place asks once for each key it holds,
    and the answers come to it. So what is shuffled are keys and answers, never the rows,
    and no key is left that holds more than a small share. Where the rows lie in their
    `places` already, by the column PLACE, `asking` has the same rows as they lay before.
    """
    kept = left.columns
    if asking is None:
        places = _least_places(left)
        asking = left.withColumn(PLACE, place_of(spread, places))
        left = asking.repartitionById(places, F.col(PLACE))
    columns = [c for c in right.columns if c not in (key, "n")]
    often, seldom = split_by_frequency(right)

    def named(side: DataFrame, prefix: str) -> DataFrame:
        return side.select(F.col(key).alias(f"_{prefix}_key"), F.lit(True).alias(f"_{prefix}_hit"),
                           *[F.col(c).alias(f"_{prefix}_{c}") for c in columns])

    frequent = F.broadcast(named(often, "f"))
    known = F.col(key) == F.col("_f_key")
    # keys go to one place per key, each of them once, whatever their order in the places
    asked = asking.select(F.col(PLACE).alias("_at"), key).where(F.col(key).isNotNull())
    asked = asked.join(frequent, known, "left_anti").repartition(max(_least_places(left), places // 16), key).distinct()
    answers = asked.join(named(seldom, "r"), F.col(key) == F.col("_r_key")).drop(key)
    answers = answers.repartitionById(places, F.col("_at")).hint("shuffle_hash")
    df = left.join(frequent, known, "left")
    df = df.join(answers, (F.col(PLACE) == F.col("_at")) & (F.col(key) == F.col("_r_key")), "left")
    for c in columns:
        df = df.withColumn(c, F.when(F.col("_f_hit"), F.col(f"_f_{c}")).otherwise(F.col(f"_r_{c}")))
    return df.select(*kept, *columns)


def pass_special(df: DataFrame) -> DataFrame:
    """Special wordforms stand for themselves in all three strings."""
    special = F.col("special")
    return df.withColumns({
        **{c: F.when(special, F.col("morpheme")).otherwise(F.col(c))
           for c in ("reading", "glyph_name", "glyph")},
        "dropped": F.when(special, False).otherwise(F.col("dropped")),
        **{c: F.when(~special, F.col(c)) for c in ("converted", "reason", "name_status")},
    })


def resolved_tokens(
    docs: DataFrame, lookups: SignLookups, text: str, keep: Sequence[str], row_id: str = "id"
) -> DataFrame:
    """One row per morpheme of each text, with its sign name and glyph.

    The texts are written once and placed by id while they are compact, in as many places
    as their size needs; the rows of a place are never shuffled after that, and few enough
    to be put together in memory. With large lookups, or large results for what stands in
    them, each distinct morpheme is resolved once and joined back by frequency.
    """
    docs = stored(docs.select(*dict.fromkeys([*keep, row_id, text])), "texts")
    places = max(_least_places(docs), -(-size_in_bytes(docs.select(text)) // PLACE_BYTES))
    known = known_morphemes(lookups) if lookups.small else None
    if known is not None and fits_broadcast(known):
        toks = tokens(docs.repartition(places, row_id), text, list(keep))
        out = resolve_small(toks, lookups, known)
    else:
        resolved = materialised(resolved_counts(docs, lookups, text))  # read several times below
        docs = docs.withColumn(PLACE, place_of([row_id], places))
        toks = tokens(docs.repartitionById(places, F.col(PLACE)), text, [*keep, PLACE])
        asking = tokens(docs, text, [PLACE])
        out = join_by_frequency(toks, resolved, "morpheme", [row_id], places, asking)
    return pass_special(out)


def rebuilt(toks: DataFrame, keep: Sequence[str], row_id: str = "id") -> DataFrame:
    """Three parallel strings per text: transliteration, glyph_names, glyphs.

    A dropped morpheme leaves nothing, a wordform with none left an extra blank. One
    group is one text, so a group is never larger than a row of the input was. Rows that
    lie in places are put together there: a row id is in one place only.
    """
    by = [PLACE] if PLACE in toks.columns and row_id in keep else []
    part = F.struct("wpos", "mpos", "reading", "glyph_name", "glyph")
    kept = F.when(F.col("morpheme").isNotNull() & ~F.col("dropped"), part)
    # (collect_list leaves out the nulls)
    parts = toks.groupBy(*by, *keep).agg(F.sort_array(F.collect_list(kept)).alias("_p"))
    p = F.col("_p")

    def joined(field: str, within: str) -> Column:
        def piece(x: Column, i: Column) -> Column:
            gap = x["wpos"] - F.get(p, i - 1)["wpos"]
            return F.concat(
                F.when(i == 0, "").when(gap == 0, within).otherwise(F.repeat(F.lit(" "), gap)),
                x[field],
            )

        return strip(F.array_join(F.transform(p, piece), ""))

    return parts.select(
        *keep, joined("reading", "-").alias("transliteration"),
        joined("glyph_name", " ").alias("glyph_names"), joined("glyph", "").alias("glyphs"),
    )


def _one_ellipsis(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<! ) *+\.{3,}+(?: *+\.{3,}+)*+ *+", "...")


def postprocessed(df: DataFrame) -> DataFrame:
    """Tidy the rebuilt strings around newlines, braces, unknowns and ellipses."""
    t = F.regexp_replace("transliteration", r"(?<! ) ++\n *+|\n *+", "\n")
    t = replace_in_order(
        t, [("-{", "{"), ("}-", "}"), ("<unk>-", "<unk> "), ("-<unk>", " <unk>")]
    )
    return df.withColumns({
        "transliteration": _one_ellipsis(t),
        "glyph_names": _one_ellipsis(F.col("glyph_names")),
        "glyphs": F.replace(_one_ellipsis(F.col("glyphs")), F.lit(" "), F.lit("")),
    })


def standard_signs(df: DataFrame, text: str) -> DataFrame:
    """Replace non-standard sign names and readings, list by list."""
    return df.withColumn(text, replace_in_order(F.col(text), K.SIGN_REPLACEMENTS))


# ---- reports ---------------------------------------------------------------------------------
def morpheme_counts(docs: DataFrame, text: str) -> DataFrame:
    """(morpheme, n): the distinct morphemes of all texts, special wordforms left out."""
    return distinct_morphemes(docs, text, [])


def resolved_counts(docs: DataFrame, lookups: SignLookups, text: str) -> DataFrame:
    """Every distinct morpheme with its count and result: what all reports are made from."""
    counts = morpheme_counts(docs, text)
    # (with large lookups read several times, for the keys they ask and for the hits)
    return resolve(counts if lookups.small else materialised(counts), lookups)


def conversion_stats(counts: DataFrame) -> DataFrame:
    """(step, outcome, n, percent): how many morphemes and names were converted."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    row = counts.agg(
        total(F.col("converted")).alias("m1"), total(~F.col("converted")).alias("m0"),
        total(F.col("name_status") == "found").alias("n1"),
        total(F.col("name_status").isin("not_in_map", "no_unicode")).alias("n0"),
    )
    outcomes = [("morpheme", "converted", "m1", "m0"), ("morpheme", "not_converted", "m0", "m1"),
                ("name", "converted", "n1", "n0"), ("name", "not_converted", "n0", "n1")]
    lines = [
        F.struct(
            F.lit(step).alias("step"), F.lit(outcome).alias("outcome"), F.col(n).alias("n"),
            F.try_divide(F.col(n) * 100.0, F.col(n) + F.col(other)).cast("double").alias("_pct"),
        )
        for step, outcome, n, other in outcomes
    ]
    out = row.select(F.inline(F.array(*lines)))
    return out.select("step", "outcome", "n", F.bround("_pct", 2).alias("percent"))


def failure_counts(counts: DataFrame) -> DataFrame:
    """(reason, morpheme, n) of what could not be converted, by cause."""
    failed_name = F.col("name_status").isin("not_in_map", "no_unicode")
    reason = F.coalesce("reason", F.when(failed_name, F.col("name_status")))
    return counts.select(reason.alias("reason"), "morpheme", "n").where("reason IS NOT NULL")


def failure_totals(counts: DataFrame) -> DataFrame:
    """(reason, morphemes, n): distinct morphemes and occurrences of each cause."""
    return failure_counts(counts).groupBy("reason").agg(
        F.count("*").alias("morphemes"), F.sum("n").alias("n"))


def top_failures(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent failures of each cause (ties by morpheme), with their rank.

    The optimizer prunes each task's rows to k per cause before they are shuffled.
    """
    by_cause = W.partitionBy("reason").orderBy(F.desc("n"), "morpheme")
    ranked = failure_counts(counts).withColumn("rank", F.row_number().over(by_cause))
    return ranked.where(F.col("rank") <= k)


def observed_readings(counts: DataFrame) -> DataFrame:
    """(glyph, reading, n): how often a glyph stands for a reading."""
    seen = counts.where(~F.col("dropped") & ~F.col("reading").isin(K.PASS_THROUGH))
    return seen.groupBy("glyph", "reading").agg(F.sum("n").alias("n"))
