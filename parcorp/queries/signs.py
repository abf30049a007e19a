"""Wordforms, morphemes, lookups and parallel strings on the given documents.

Common words are turned into the notations the sign lookup knows. The lookups come from
the labelled documents: a reading is a morpheme, its names are the language and source
pairs it occurs in, and a name's glyph is made of two signs. Benchmark ids override.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import replace_in_order
from parcorp.functions.tokens import distinct_morphemes, tokens, wordforms
from parcorp.operators import lookups as L
from parcorp.operators import resolve as R
from parcorp.operators.observe import StageCounts
from parcorp.plans import corpus
from parcorp.queries.registry import q, query, sql_regex, sql_replace, table
from parcorp.session import BROADCAST_BYTES, materialised

NOTATION = [
    (" de ", "{de}-"), (" the ", " the(EN.SRC1) "), (" is ", " 7-bi "), (" it ", " 12 "),
    (" en ", " x "), (" von ", " EN.SRC3 "), (" to ", " ... "), (" und ", "\n"),
    (" la ", " LA(a-b)-la "), (" in ", " IN "), (" le ", " <RULING> "),
    (" et ", " et(FR.SRC8) "), (" for ", " N "), (" on ", " on-N-on "), (" el ", " | "),
    (" der ", " 5/6(diš)-der "), (" of ", " zzz(EN.SRC5)-{of}of "), (" are ", " geš₂ "),
    (" was ", " 2(diš) "), (" die ", " {die "), (" as ", " ERIM-(a-b)c-d "),
]
SIGNS = "𒀀𒀁𒀂𒀃𒀄𒀅𒀆𒀇𒀈𒀉𒀊𒀋𒀌𒀍𒀎𒀏𒀐𒀑𒀒𒀓"
LANG_SIGNS = {"en": "𒁀", "fr": "𒁁", "de": "𒁂", "es": "𒁃"}


def noted(spark, sf_dir, docs=None):
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    df = docs.select(
        F.col("doc_id").alias("id"), replace_in_order(F.col("text"), NOTATION).alias("text"),
        F.col("lang").alias("period"), F.col("source").alias("genre"),
    )
    return R.standard_signs(df, "text")


def sign_name():
    return F.concat(F.upper("period"), F.lit("."), F.upper("genre"))


def name_glyph_pairs(spark, sf_dir):
    """(name, glyph): src2 names have no glyph, src4 names none at all, src6 an X sign."""
    no = F.expr("int(substring(source, 4))")
    glyph = F.concat(F.expr(f"substring('{SIGNS}', int(substring(source, 4)) + 1, 1)"),
                     _lang_sign(F.col("lang")))
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return pairs.where(no != 4).select(
        F.concat(F.upper("lang"), F.lit("."), F.upper("source")).alias("name"),
        F.when(no == 2, "").when(no == 6, F.concat(F.lit("X"), glyph)).otherwise(glyph).alias("glyph"),
    )


def _lang_sign(lang):
    out = F.lit("")
    for code, sign in LANG_SIGNS.items():
        out = F.when(lang == code, sign).otherwise(out)
    return out


def edges(spark, sf_dir):
    # only labelled texts are rewritten, and only distinct wordforms split
    labelled = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    toks = distinct_morphemes(noted(spark, sf_dir, labelled), "text", ["period", "genre"])
    m = F.col("morpheme")
    return toks.where((m == F.lower(m)) & ~m.rlike(r"[(){}0-9]")).select(
        m.alias("reading"), sign_name().alias("name")
    )


def index(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(i.cast("string"), F.lit("(diš)")).alias("reading"),
        F.when(i == 2, "N").otherwise(F.concat(F.lit("EN.SRC"), (i % 20).cast("string"))).alias("name"),
    )


def sign_readings(spark, sf_dir):
    return L.override(L.reading_names(edges(spark, sf_dir)), index(spark, sf_dir))


def sign_lookups(spark, sf_dir, limit=BROADCAST_BYTES):
    """The lookups as written tables, so that their sizes are known when joined."""
    readings = materialised(sign_readings(spark, sf_dir))
    glyphs = materialised(L.name_glyph(L.name_glyphs(name_glyph_pairs(spark, sf_dir))))
    return L.SignLookups.of(readings, glyphs, limit=limit)


# ---- the same in SQL ----------------------------------------------------------------------
IS_SPECIAL = "IN (" + ", ".join(q(t) for t in K.PASS_THROUGH) + ")"
NUMBERS_VALUES = ", ".join(f"({q(k)}, {q(v)})" for k, v in K.NUMBER_READINGS.items())
PROTECT = (  # hyphens inside parentheses become chr(2): those after the last '(' before a ')'
    "array_to_string(list_transform(string_split(p, ')'), lambda s, i: CASE WHEN i < len(string_split(p, ')'))"
    " THEN left(s, length(s) - length(regexp_extract(s, '[^(]*$')))"
    " || replace(regexp_extract(s, '[^(]*$'), '-', chr(2)) ELSE s END), ')')"
)
TOKENS_SQL = f"""
inj AS MATERIALIZED (SELECT doc_id AS id, lang AS period, source AS genre,
  {sql_replace(sql_replace('text', NOTATION), K.SIGN_REPLACEMENTS)} AS t FROM documents),
nums(k, v) AS (VALUES {NUMBERS_VALUES}),
wl AS (SELECT id, list_filter(string_split({sql_replace('t', [(chr(10), ' ' + chr(10) + ' '), ('...', ' ... ')])}, ' '),
  lambda w: w NOT IN ('', '|', '.|')) AS ws FROM inj),
wf AS (SELECT id, unnest(range(0, len(ws))) AS wpos, unnest(ws) AS w FROM wl),
ex AS (SELECT id, wpos, w, w {IS_SPECIAL} AS special,
  CASE WHEN a.k IS NOT NULL THEN a.v WHEN b.k IS NOT NULL THEN b.v || substr(w, length(b.k) + 1)
    ELSE w END AS x
  FROM wf LEFT JOIN nums a ON w = a.k LEFT JOIN nums b ON string_split(w, '-')[1] = b.k),
pieces AS (SELECT *, CASE WHEN special THEN [w] ELSE
  list_filter(string_split(replace({sql_regex('x', '(' + chr(92) + '{[^}]*' + chr(92) + '})', chr(1) + chr(92) + '1' + chr(1))}, ' ', chr(1)), chr(1)),
    lambda p: p <> '') END AS ps FROM ex),
parts AS (SELECT id, wpos, special, w, CASE WHEN special THEN [w] ELSE list_filter(flatten(list_transform(
  ps, lambda p: string_split({PROTECT}, '-'))), lambda p: p <> '') END AS ms FROM pieces),
tok AS MATERIALIZED (SELECT id, wpos, unnest(range(0, len(ms))) AS mpos, special,
  replace(unnest(ms), chr(2), '-') AS m FROM parts)
"""
LOOKUP_SQL = f"""
edges AS (SELECT DISTINCT m AS reading, upper(period) || '.' || upper(genre) AS name
  FROM tok JOIN inj USING (id) WHERE NOT special AND m = lower(m)
    AND NOT regexp_matches(m, '[(){{}}0-9]') AND id IN (SELECT doc_id FROM labels)),
base AS (SELECT reading, list_sort(list(name)) AS names FROM edges GROUP BY reading),
idx AS (SELECT item_id || '(diš)' AS reading,
  CASE item_id WHEN 2 THEN 'N' ELSE 'EN.SRC' || (item_id % 20) END AS name FROM benchmark),
readings AS MATERIALIZED (SELECT coalesce(i.reading, b.reading) AS reading,
  CASE WHEN i.name IS NOT NULL THEN [i.name] ELSE b.names END AS names
  FROM base b FULL JOIN idx i ON b.reading = i.reading),
glyphs AS MATERIALIZED (SELECT name, CASE WHEN no = 2 THEN '' WHEN no = 6 THEN 'X' || g ELSE g END AS glyph FROM (
  SELECT DISTINCT upper(lang) || '.' || upper(source) AS name, CAST(substr(source, 4) AS INTEGER) AS no,
    substr('{SIGNS}', CAST(substr(source, 4) AS INTEGER) + 1, 1) ||
    CASE lang {' '.join(f"WHEN '{c}' THEN '{s}'" for c, s in LANG_SIGNS.items())} ELSE '' END AS g
  FROM documents) WHERE no <> 4),
inv AS (SELECT DISTINCT unnest(names) AS name, reading FROM readings),
only_reading AS (SELECT name, min(reading) AS reading FROM inv GROUP BY name HAVING count(*) = 1)
"""
SWAP_SQL = "CASE chosen " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.NAME_SWAPS) + " ELSE chosen END"
# is upper in the sense of the lookup: an upper-case letter and none in lower case
UPPER_SQL = "(regexp_matches(m, '\\p{Lu}') AND NOT regexp_matches(m, '[\\p{Ll}\\p{Lt}ₓ]'))"
RESOLVE_SQL = f"""
d0 AS (SELECT CASE m WHEN 'geš₂' THEN 'ŋeš₂' ELSE m END AS m, m AS morpheme, count(*) AS n
  FROM tok WHERE NOT special GROUP BY ALL),
d1 AS (SELECT *, contains(m, '(') AND contains(m, ')') AS paren,
  regexp_matches(m, '^\\d+(/\\d+)?(\\.\\d+)?(\\s*\\([^)]+\\))?$') AS numeric,
  string_split(m, '(')[1] AS b, replace(string_split(m, '(')[2], ')', '') AS pn FROM d0),
d2 AS (SELECT d1.*, rp.names AS plain, rl.names AS low, rb.names AS base, g.name AS own, o.reading AS onl
  FROM d1 LEFT JOIN readings rp ON rp.reading = replace(replace(m, '{{', ''), '}}', '')
  LEFT JOIN readings rl ON rl.reading = lower(m)
  LEFT JOIN readings rb ON paren AND rb.reading = b
  LEFT JOIN glyphs g ON g.name = m LEFT JOIN only_reading o ON paren AND o.name = pn),
d3 AS (SELECT *, CASE
    WHEN m IN ('x', 'n', 'X', 'N') THEN 1
    WHEN numeric AND plain IS NOT NULL THEN 2 WHEN numeric AND low IS NOT NULL THEN 3
    WHEN numeric AND own IS NOT NULL THEN 4 WHEN numeric THEN 5
    WHEN own IS NOT NULL THEN 6 WHEN plain IS NOT NULL THEN 7
    WHEN {UPPER_SQL} AND low IS NOT NULL THEN 8 WHEN {UPPER_SQL} THEN 9
    WHEN paren AND len(base) = 1 THEN 10 WHEN paren AND list_contains(base, pn) THEN 11
    WHEN paren AND onl IS NOT NULL THEN 12 ELSE 13 END AS rule FROM d2),
d4 AS (SELECT *, CASE rule WHEN 1 THEN '...' WHEN 3 THEN lower(m) WHEN 6 THEN '<unk>' WHEN 8 THEN '<unk>'
    WHEN 9 THEN '<unk>' WHEN 10 THEN b WHEN 11 THEN b WHEN 12 THEN onl ELSE m END AS value,
  CASE rule WHEN 1 THEN ['...'] WHEN 2 THEN plain WHEN 3 THEN low WHEN 4 THEN [m] WHEN 6 THEN [m]
    WHEN 7 THEN plain WHEN 8 THEN low WHEN 10 THEN base WHEN 11 THEN [pn] WHEN 12 THEN [pn]
    ELSE [] END AS names FROM d3),
d5 AS (SELECT *, CASE WHEN len(names) = 1 THEN names[1] ELSE '<unk>' END AS chosen FROM d4),
d6 AS (SELECT *, chosen <> '<unk>' AS converted, chosen = 'N' AS dropped, {SWAP_SQL} AS name,
  CASE WHEN chosen = '<unk>' THEN CASE rule WHEN 5 THEN 'number' WHEN 9 THEN 'sign_name' WHEN 13 THEN 'other'
    ELSE CASE WHEN len(names) > 1 THEN 'ambiguous' ELSE 'no_name' END END END AS reason,
  CASE WHEN chosen = '<unk>' THEN '<unk>' ELSE value END AS rd FROM d5),
d7 AS (SELECT d6.*, glyphs.glyph AS g, CASE WHEN rd = '<unk>' OR dropped THEN NULL
    WHEN d6.name {IS_SPECIAL} THEN 'token' WHEN glyphs.glyph IS NULL THEN 'not_in_map'
    WHEN glyphs.glyph = '' THEN 'no_unicode' ELSE 'found' END AS name_status
  FROM d6 LEFT JOIN glyphs ON glyphs.name = d6.name),
d8 AS (SELECT *, coalesce(name_status = 'token' OR (name_status = 'found' AND NOT contains(g, 'X')), false) AS ok FROM d7),
res AS MATERIALIZED (SELECT morpheme, n, converted, dropped, reason, name_status,
  CASE WHEN ok THEN rd ELSE '<unk>' END AS reading, CASE WHEN ok THEN name ELSE '<unk>' END AS glyph_name,
  CASE WHEN ok THEN CASE name_status WHEN 'token' THEN name ELSE g END ELSE '<unk>' END AS glyph FROM d8),
rtok AS MATERIALIZED (SELECT id, wpos, mpos, special, m AS morpheme, CASE WHEN special THEN m ELSE reading END AS reading,
  CASE WHEN special THEN m ELSE glyph_name END AS glyph_name, CASE WHEN special THEN m ELSE glyph END AS glyph,
  CASE WHEN special THEN false ELSE dropped END AS dropped, converted, reason, name_status
  FROM tok LEFT JOIN res ON NOT special AND m = res.morpheme)
"""
STRIP = "'^[\\s]+|[\\s]+$', '', 'g')"
REBUILD_SQL = f"""
words AS (SELECT id, wpos, string_agg(CASE WHEN NOT dropped THEN reading END, '-' ORDER BY mpos) AS a,
  string_agg(CASE WHEN NOT dropped THEN glyph_name END, ' ' ORDER BY mpos) AS b,
  string_agg(CASE WHEN NOT dropped THEN glyph END, '' ORDER BY mpos) AS c FROM rtok GROUP BY id, wpos),
allw AS (SELECT wf.id, wf.wpos, coalesce(a, '') AS a, coalesce(b, '') AS b, coalesce(c, '') AS c
  FROM wf LEFT JOIN words ON wf.id = words.id AND wf.wpos = words.wpos),
built AS MATERIALIZED (SELECT inj.id, inj.period, inj.genre,
  regexp_replace(coalesce(string_agg(a, ' ' ORDER BY wpos), ''), {STRIP} AS transliteration,
  regexp_replace(coalesce(string_agg(b, ' ' ORDER BY wpos), ''), {STRIP} AS glyph_names,
  regexp_replace(coalesce(string_agg(c, ' ' ORDER BY wpos), ''), {STRIP} AS glyphs
  FROM inj LEFT JOIN allw ON inj.id = allw.id GROUP BY inj.id, inj.period, inj.genre)
"""
TRANSLIT_SQL = sql_replace(
    sql_regex("transliteration", " *\\n *", "\n"),
    [("-{", "{"), ("}-", "}"), ("<unk>-", "<unk> "), ("-<unk>", " <unk>")],
)


def _dots(e):
    return sql_regex(e, "( *\\.{3,} *)+", "...")


POST_SQL = f"""
post AS MATERIALIZED (SELECT id, period, genre, {_dots(TRANSLIT_SQL)} AS transliteration,
  {_dots('glyph_names')} AS glyph_names, replace({_dots('glyphs')}, ' ', '') AS glyphs FROM built)
"""
ALL_SQL = ",".join([TOKENS_SQL, LOOKUP_SQL, RESOLVE_SQL, REBUILD_SQL, POST_SQL])


# ---- queries -------------------------------------------------------------------------------
@query("q_dict_replace", f"""
SELECT doc_id AS id, {sql_replace(sql_replace('text', NOTATION), K.SIGN_REPLACEMENTS)} AS text FROM documents
""")
def q_dict_replace(spark, sf_dir):
    return noted(spark, sf_dir).select("id", "text")


@query("q_wordforms", f"""
WITH {TOKENS_SQL} SELECT id, len(ws) AS n, array_to_string(ws, '¦') AS wordforms FROM wl
""")
def q_wordforms(spark, sf_dir):
    return noted(spark, sf_dir).select("id", wordforms(F.col("text")).alias("ws")).select(
        "id", F.size("ws").cast("bigint").alias("n"), F.array_join("ws", "¦").alias("wordforms")
    )


@query("q_morphemes", f"""
WITH {TOKENS_SQL}
SELECT id, wpos, CAST(mpos AS BIGINT) AS mpos, m AS morpheme FROM tok
""")
def q_morphemes(spark, sf_dir):
    toks = tokens(noted(spark, sf_dir), "text", ["id"]).where("morpheme IS NOT NULL")
    return toks.select(
        "id", F.col("wpos").cast("bigint").alias("wpos"), F.col("mpos").cast("bigint").alias("mpos"),
        "morpheme",
    )


@query("q_lookup_build", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL} SELECT reading, array_to_string(names, ',') AS names FROM base
""")
def q_lookup_build(spark, sf_dir):
    return L.reading_names(edges(spark, sf_dir)).select(
        "reading", F.array_join("names", ",").alias("names")
    )


@query("q_lookup_override", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL} SELECT reading, array_to_string(names, ',') AS names FROM readings
""")
def q_lookup_override(spark, sf_dir):
    return sign_readings(spark, sf_dir).select("reading", F.array_join("names", ",").alias("names"))


@query("q_lookup_ambiguous", """
WITH e AS (SELECT lang AS name, source AS glyph FROM documents
  UNION ALL SELECT source, CASE lang WHEN 'es' THEN '' ELSE lang END FROM documents),
s AS (SELECT name, list_sort(list(DISTINCT glyph)) AS glyphs FROM e WHERE glyph <> '' GROUP BY name)
SELECT name, array_to_string(glyphs, ',') AS glyphs, glyphs[1] AS glyph FROM s WHERE len(glyphs) > 1
""")
def q_lookup_ambiguous(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("lang").alias("name"), F.col("source").alias("glyph"))
    more = docs.select(
        F.col("source").alias("name"),
        F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("glyph"),
    )
    found = L.ambiguous(L.name_glyphs(pairs.unionByName(more)))
    one = L.name_glyph(found)
    return found.join(one, "name").select("name", F.array_join("glyphs", ",").alias("glyphs"), "glyph")


@query("q_inverted_lookup", f"WITH {TOKENS_SQL}, {LOOKUP_SQL} SELECT name, reading FROM inv")
def q_inverted_lookup(spark, sf_dir):
    return L.inverted(sign_readings(spark, sf_dir))


@query("q_only_readings", f"WITH {TOKENS_SQL}, {LOOKUP_SQL} SELECT name, reading FROM only_reading")
def q_only_readings(spark, sf_dir):
    return L.only_readings(sign_readings(spark, sf_dir))


def resolved_morphemes(spark, sf_dir):
    return R.resolved_counts(noted(spark, sf_dir), sign_lookups(spark, sf_dir), "text")


@query("q_resolve", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT morpheme, n, converted, dropped, reason FROM res
""")
def q_resolve(spark, sf_dir):
    return resolved_morphemes(spark, sf_dir).select("morpheme", "n", "converted", "dropped", "reason")


@query("q_name_to_glyph", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT morpheme, reading, glyph_name, glyph, name_status FROM res
""")
def q_name_to_glyph(spark, sf_dir):
    return resolved_morphemes(spark, sf_dir).select(
        "morpheme", "reading", "glyph_name", "glyph", "name_status"
    )


@query("q_resolve_large", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT morpheme, n, converted, dropped, reason, reading, glyph_name, glyph, name_status FROM res
""")
def q_resolve_large(spark, sf_dir):
    """The same without any broadcast, as for lookups that grew with a corpus."""
    lookups = sign_lookups(spark, sf_dir, limit=0)
    return R.resolved_counts(noted(spark, sf_dir), lookups, "text").select(
        "morpheme", "n", "converted", "dropped", "reason", "reading", "glyph_name", "glyph", "name_status"
    )


@query("q_numbers", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT morpheme, n, reading, glyph_name, reason FROM res WHERE regexp_matches(morpheme, '^\\d')
""")
def q_numbers(spark, sf_dir):
    return resolved_morphemes(spark, sf_dir).where(F.col("morpheme").rlike(r"^\d")).select(
        "morpheme", "n", "reading", "glyph_name", "reason"
    )


def sign_tokens(spark, sf_dir):
    return R.resolved_tokens(
        noted(spark, sf_dir), sign_lookups(spark, sf_dir), "text", ["id", "period", "genre"]
    )


@query("q_rebuild_parallel", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}, {REBUILD_SQL}
SELECT id, transliteration, glyph_names, glyphs FROM built
""")
def q_rebuild_parallel(spark, sf_dir):
    return R.rebuilt(sign_tokens(spark, sf_dir), ["id"])


@query("q_rebuild_large", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}, {REBUILD_SQL}
SELECT id, transliteration, glyph_names, glyphs FROM built
""")
def q_rebuild_large(spark, sf_dir):
    lookups = sign_lookups(spark, sf_dir, limit=0)
    toks = R.resolved_tokens(noted(spark, sf_dir), lookups, "text", ["id"])
    return R.rebuilt(toks, ["id"])


@query("q_postprocess", f"WITH {ALL_SQL} SELECT id, transliteration, glyph_names, glyphs FROM post")
def q_postprocess(spark, sf_dir):
    return R.postprocessed(R.rebuilt(sign_tokens(spark, sf_dir), ["id"]))


@query("q_conversion_stats", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL},
c AS (SELECT count(*) FILTER (converted) AS m1, count(*) FILTER (NOT converted) AS m0,
  count(*) FILTER (name_status = 'found') AS n1,
  count(*) FILTER (name_status IN ('not_in_map', 'no_unicode')) AS n0 FROM rtok WHERE NOT special)
SELECT 'morpheme' AS step, 'converted' AS outcome, m1 AS n, round_even(100.0 * m1 / (m1 + m0), 2) AS percent FROM c
UNION ALL SELECT 'morpheme', 'not_converted', m0, round_even(100.0 * m0 / (m1 + m0), 2) FROM c
UNION ALL SELECT 'name', 'converted', n1, round_even(100.0 * n1 / (n1 + n0), 2) FROM c
UNION ALL SELECT 'name', 'not_converted', n0, round_even(100.0 * n0 / (n1 + n0), 2) FROM c
""")
def q_conversion_stats(spark, sf_dir):
    return R.conversion_stats(resolved_morphemes(spark, sf_dir))


@query("q_failure_counts", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT coalesce(reason, name_status) AS reason, morpheme, count(*) AS n FROM rtok
WHERE NOT special AND (reason IS NOT NULL OR name_status IN ('not_in_map', 'no_unicode')) GROUP BY ALL
""")
def q_failure_counts(spark, sf_dir):
    return R.failure_counts(resolved_morphemes(spark, sf_dir))


@query("q_top_failures", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL},
f AS (SELECT coalesce(reason, name_status) AS reason, morpheme, n FROM res
  WHERE reason IS NOT NULL OR name_status IN ('not_in_map', 'no_unicode')),
r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, morpheme) AS rank FROM f)
SELECT reason, morpheme, n, rank FROM r WHERE rank <= 20
""")
def q_top_failures(spark, sf_dir):
    out = R.top_failures(resolved_morphemes(spark, sf_dir))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("q_observed_readings", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL}
SELECT glyph, reading, count(*) AS n FROM rtok
WHERE NOT dropped AND NOT reading {IS_SPECIAL} GROUP BY glyph, reading
""")
def q_observed_readings(spark, sf_dir):
    return R.observed_readings(resolved_morphemes(spark, sf_dir))


@query("q_failure_totals", f"""
WITH {TOKENS_SQL}, {LOOKUP_SQL}, {RESOLVE_SQL},
f AS (SELECT coalesce(reason, name_status) AS reason, n FROM res
  WHERE reason IS NOT NULL OR name_status IN ('not_in_map', 'no_unicode'))
SELECT reason, count(*) AS morphemes, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY reason
""")
def q_failure_totals(spark, sf_dir):
    return R.failure_totals(resolved_morphemes(spark, sf_dir))


# the rows' own order is the reverse of the ids
CHAIN_SQL = """
t1 AS (SELECT *, row_number() OVER (PARTITION BY transliteration ORDER BY id DESC) AS r1 FROM post),
t2 AS (SELECT *, row_number() OVER (PARTITION BY glyphs ORDER BY id DESC) AS r2 FROM t1 WHERE r1 = 1)
"""


def built_texts(spark, sf_dir):
    texts = noted(spark, sf_dir).withColumnRenamed("text", "transliteration")
    return corpus.parallel_texts(
        texts.withColumn("row_ord", -F.col("id")), sign_lookups(spark, sf_dir), ["row_ord"])


@query("q_corpus_build", f"""
WITH {ALL_SQL}, {CHAIN_SQL}
SELECT id, period, genre, transliteration, glyph_names, glyphs FROM t2 WHERE r2 = 1
""")
def q_corpus_build(spark, sf_dir):
    """Documents to the final parallel corpus, end to end."""
    return corpus.without_repeats(built_texts(spark, sf_dir), ["row_ord"])


@query("q_pipeline_counts", f"""
WITH {ALL_SQL}, {CHAIN_SQL}
SELECT 'with_glyphs' AS stage, count(*) AS n FROM post
UNION ALL SELECT 'distinct_texts', count(*) FROM t1 WHERE r1 = 1
UNION ALL SELECT 'distinct_glyphs', count(*) FROM t2 WHERE r2 = 1
""")
def q_pipeline_counts(spark, sf_dir):
    """Counted while the rows pass through the chain, which runs once."""
    seen = StageCounts()
    chain = corpus.without_repeats(built_texts(spark, sf_dir), ["row_ord"], seen)
    chain.write.format("noop").mode("overwrite").save()
    return seen.table(spark)
