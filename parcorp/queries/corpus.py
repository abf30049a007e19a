"""Collation, names, counts, de-duplication, sampling on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.operators import collate as col
from parcorp.operators import sample, stats
from parcorp.operators.dedup import keep_first, keep_first_chain
from parcorp.queries.registry import q, query, sql_regex, sql_replace, table


# ---- corpora with the reference shape ------------------------------------------------------
def corpora(spark, sf_dir):
    """Documents and benchmark items as two corpora with different columns."""
    docs = table(spark, sf_dir, "documents")
    a = docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("transliteration"),
        F.when(F.col("lang") == "en", "Sumerian").when(F.col("lang") == "fr", "")
        .when(F.col("lang") == "de", "Sumerian").otherwise("Akkadian").alias("language"),
        F.when(F.col("source") == "src2", "sux akk").otherwise("sux").alias("langs"),
        F.when(F.col("source") == "src4", "Ebla").when(F.col("source") == "src6", "")
        .when(F.col("source") == "src8", "Uncertain").otherwise(F.col("lang")).alias("period"),
        _genre(F.col("source")).alias("genre"), "n_chars", F.col("doc_id").alias("row_ord"),
    )
    bench = table(spark, sf_dir, "benchmark")
    b = bench.select(
        F.col("item_id").alias("id"),
        F.when(F.col("item_id") == 7, "").otherwise(F.col("text")).alias("transliteration"),
        F.lit(None).cast("string").alias("language"), F.lit("sux").alias("langs"),
        F.lit("Uncertain").alias("period"), F.lit("Ritual").alias("genre"),
        F.lit("item").alias("kind"), F.col("item_id").alias("row_ord"),
    )
    return [b, a]


GENRES = {
    "src0": "", "src1": "uncertain", "src3": "Royal/Monumental", "src5": "Lexical; School",
    "src7": "Ritual", "src9": "Hymn-Prayer", "src10": "Mathematical", "src11": "Astronomical",
    "src12": "fake (modern)", "src13": "Lexical", "src14": "Administrative",
}


def _genre(source):
    out = source
    for s, g in GENRES.items():
        out = F.when(source == s, g).otherwise(out)
    return out


GENRE_CASE = "CASE source " + " ".join(f"WHEN {q(s)} THEN {q(g)}" for s, g in GENRES.items()) \
    + " ELSE source END"
CORPORA_SQL = f"""
a AS (SELECT doc_id AS id, text AS t,
  CASE lang WHEN 'en' THEN 'Sumerian' WHEN 'fr' THEN '' WHEN 'de' THEN 'Sumerian'
    ELSE 'Akkadian' END AS language,
  CASE source WHEN 'src2' THEN 'sux akk' ELSE 'sux' END AS langs,
  CASE source WHEN 'src4' THEN 'Ebla' WHEN 'src6' THEN '' WHEN 'src8' THEN 'Uncertain'
    ELSE lang END AS period,
  {GENRE_CASE} AS genre, 1 AS corpus_ord, doc_id AS row_ord FROM documents),
b AS (SELECT item_id AS id, CASE item_id WHEN 7 THEN '' ELSE text END AS t, '' AS language,
  'sux' AS langs, 'Uncertain' AS period, 'Ritual' AS genre, 0 AS corpus_ord, item_id AS row_ord
  FROM benchmark),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
"""
PERIOD_SQL = "CASE WHEN period IN ('', 'Uncertain') THEN 'Unknown' ELSE period END"
GENRE_SQL = "CASE " + " ".join(
    f"WHEN genre = {q(old)} THEN {q(new)}" for old, new in K.GENRE_NAMES
) + " ELSE genre END"
def _listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


LANGUAGE_SQL = f"""(language IN {_listed(K.KEPT_LANGUAGES)} AND NOT contains(langs, {q(K.DROPPED_LANG_MARK)})
  AND period NOT IN {_listed(K.DROPPED_PERIODS)} AND genre NOT IN {_listed(K.DROPPED_GENRES)})"""


@query("q_collate", f"""
WITH {CORPORA_SQL},
f AS (SELECT * FROM u WHERE {LANGUAGE_SQL} AND t <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY corpus_ord, row_ord) AS rn FROM f)
SELECT id, t AS transliteration, {PERIOD_SQL} AS period, {GENRE_SQL} AS genre FROM r WHERE rn = 1
""")
def q_collate(spark, sf_dir):
    return col.collate(corpora(spark, sf_dir), "row_ord")


@query("q_normalise", f"""
WITH {CORPORA_SQL}
SELECT id, {PERIOD_SQL} AS period, {GENRE_SQL} AS genre, length(t) AS n FROM a
""")
def q_normalise(spark, sf_dir):
    docs = corpora(spark, sf_dir)[1]
    return col.normalise(docs).select(
        "id", "period", "genre", F.length("transliteration").cast("bigint").alias("n")
    )


@query("q_value_counts", f"""
WITH {CORPORA_SQL}, n AS (SELECT {PERIOD_SQL} AS period, {GENRE_SQL} AS genre FROM u)
SELECT 'period' AS "column", period AS value, count(*) AS n FROM n GROUP BY period
UNION ALL SELECT 'genre', genre, count(*) FROM n GROUP BY genre
""")
def q_value_counts(spark, sf_dir):
    df = col.normalise(col.union_common([c.na.fill("") for c in corpora(spark, sf_dir)]))
    return stats.value_counts(df, ["period", "genre"])


@query("q_stage_counts", f"""
WITH {CORPORA_SQL}, f AS (SELECT *, {LANGUAGE_SQL} AS lang_ok, t <> '' AS text_ok FROM u)
SELECT 'union' AS stage, count(*) AS n FROM f
UNION ALL SELECT 'language', count(*) FROM f WHERE lang_ok
UNION ALL SELECT 'text', count(*) FROM f WHERE lang_ok AND text_ok
UNION ALL SELECT 'distinct_ids', count(DISTINCT id) FROM f WHERE lang_ok AND text_ok
""")
def q_stage_counts(spark, sf_dir):
    df = col.union_common([c.na.fill("") for c in corpora(spark, sf_dir)])
    stages = [("union", F.lit(True)), ("language", col.wanted_language()), ("text", col.has_text())]
    return col.stage_counts(df, stages)


# ---- de-duplication -----------------------------------------------------------------------
@query("q_dedup_id", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn = 1
""")
def q_dedup_id(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("last_first", -F.col("turn"))
    return keep_first(conv, ["conv_id"], ["last_first"]).drop("last_first")


@query("q_dedup_text", """
SELECT doc_id, text, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def q_dedup_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return keep_first(docs, ["text"], ["doc_id"])


# the second text is the document's capital letters, so that more texts meet


@query("q_dedup_chain", f"""
WITH d AS (SELECT doc_id, text, {sql_regex('text', '[^A-Z]', '')} AS glyphs FROM documents),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM d)
  WHERE rn = 1),
b AS (SELECT * FROM (
  SELECT doc_id, text, glyphs, row_number() OVER (PARTITION BY glyphs ORDER BY doc_id) AS rn FROM a)
  WHERE rn = 1)
SELECT doc_id, glyphs, length(text) AS n FROM b
""")
def q_dedup_chain(spark, sf_dir):
    capitals = F.regexp_replace("text", "[^A-Z]", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", capitals.alias("glyphs"))
    out = keep_first_chain(docs, [["text"], ["glyphs"]], ["doc_id"])
    return out.select("doc_id", "glyphs", F.length("text").cast("bigint").alias("n"))


# ---- sampling ------------------------------------------------------------------------------
def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("transliteration"),
        F.col("lang").alias("period"), F.col("source").alias("genre"),
    )


SPLIT_SQL = """
k AS (SELECT doc_id AS id, lang AS period, source AS genre, source = 'src3' AS held,
  md5('42|' || doc_id) AS key FROM documents),
s AS (SELECT period, count(*) AS n FROM k WHERE NOT held GROUP BY period),
s1 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM s),
s2 AS (SELECT *, (total + 19) // 20 AS draws FROM s1),
s3 AS (SELECT *, n * draws // total AS base, n * draws % total AS rem FROM s2),
s4 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, period)
  <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM s3),
v1 AS (SELECT period, n_test, n - n_test AS n, total - draws AS total, (total - draws + 18) // 19 AS draws
  FROM s4),
v2 AS (SELECT *, n * draws // total AS base, n * draws % total AS rem FROM v1),
v3 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, period)
  <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS n_val FROM v2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY key, id) AS rk
  FROM k WHERE NOT held),
split AS (
  SELECT id, ranked.period, genre, CASE WHEN rk <= n_test THEN 'test'
    WHEN rk <= n_test + n_val THEN 'validation' ELSE 'train' END AS split
  FROM ranked JOIN v3 USING (period)
  UNION ALL SELECT id, period, genre, 'train' FROM k WHERE held)
"""


def split_texts(spark, sf_dir):
    return sample.stratified_split(texts(spark, sf_dir), held_out=F.col("genre") == "src3")


@query("q_split", f"WITH {SPLIT_SQL} SELECT id, period, genre, split FROM split")
def q_split(spark, sf_dir):
    return split_texts(spark, sf_dir).select("id", "period", "genre", "split")


@query("q_split_counts", f"""
WITH {SPLIT_SQL}
SELECT split, 'period' AS "column", period AS value, count(*) AS n FROM split GROUP BY split, period
UNION ALL SELECT split, 'genre', genre, count(*) FROM split GROUP BY split, genre
""")
def q_split_counts(spark, sf_dir):
    return stats.value_counts(split_texts(spark, sf_dir), ["period", "genre"], by=["split"])


@query("q_oversample", """
SELECT doc_id AS id, source AS genre, CAST(copy AS BIGINT) AS copy FROM (
  SELECT doc_id, source, unnest(range(1, CASE source WHEN 'src14' THEN 2 ELSE 11 END)) AS copy
  FROM documents)
""")
def q_oversample(spark, sf_dir):
    out = sample.oversample(texts(spark, sf_dir), F.col("genre") == "src14")
    return out.select("id", "genre", F.col("copy").cast("bigint").alias("copy"))


@query("q_shuffle", """
SELECT doc_id AS id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS position
FROM documents
""")
def q_shuffle(spark, sf_dir):
    return sample.shuffled_positions(texts(spark, sf_dir), 7).select("id", "position")


# ---- counts and distributions ----------------------------------------------------------------
WORDS_SQL = "SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents"


@query("q_topk", f"""
WITH w AS ({WORDS_SQL}), c AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY w)
SELECT w AS value, n FROM (SELECT * FROM c ORDER BY n DESC, w LIMIT 20)
UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT) FROM c
""")
def q_topk(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")
    )
    return stats.top_k(words.where("w <> ''"), "w", 20)


GLYPH_SQL = sql_replace("text", [(t, "") for t in [*K.PASS_THROUGH, " "]])


@query("q_glyph_total", f"SELECT CAST(sum(length({GLYPH_SQL})) AS BIGINT) AS total_glyphs FROM documents")
def q_glyph_total(spark, sf_dir):
    return stats.glyph_total(table(spark, sf_dir, "documents"), "text")


PLAIN_SQL = sql_replace("text", [(t, "") for t in K.VOCAB_SPECIALS])
ALPHABET_SQL = f"""
SELECT char, count(*) AS n_texts FROM (
  SELECT unnest(list_distinct(string_split({PLAIN_SQL}, ''))) AS char FROM documents)
WHERE char <> '' GROUP BY char
"""


@query("q_alphabet", ALPHABET_SQL)
def q_alphabet(spark, sf_dir):
    return stats.alphabet(table(spark, sf_dir, "documents"), "text")


@query("q_len_hist", f"""
WITH l AS (SELECT length({PLAIN_SQL}) AS n FROM documents
  UNION ALL SELECT length({PLAIN_SQL}) FROM conversations)
SELECT CASE WHEN n <= 64 THEN '0-64' WHEN n <= 128 THEN '64-128' WHEN n <= 256 THEN '128-256'
  ELSE 'mt256' END AS bucket, count(*) AS n FROM l GROUP BY 1
""")
def q_len_hist(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("text").unionByName(
        table(spark, sf_dir, "conversations").select("text")
    )
    return stats.length_histogram(both, "text")


TOKENS_SQL = (
    "list_filter(string_split(regexp_replace("
    + sql_replace("text", [(t, "") for t in K.PASS_THROUGH])
    + ", '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
)


@query("q_token_freq", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY token
""")
def q_token_freq(spark, sf_dir):
    return stats.token_frequencies(table(spark, sf_dir, "documents"), "text")


@query("q_token_summary", f"""
SELECT count(*) AS n_texts, CAST(sum(len({TOKENS_SQL})) AS BIGINT) AS total_tokens,
  round(avg(len({TOKENS_SQL})), 6) AS mean_tokens FROM documents
""")
def q_token_summary(spark, sf_dir):
    return stats.token_summary(table(spark, sf_dir, "documents"), "text")
