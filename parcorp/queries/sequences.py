"""Training sequences and metrics on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions import sequences as S
from parcorp.functions.text import replace_in_order
from parcorp.operators import metrics
from parcorp.operators import sequences as Q
from parcorp.operators.stats import alphabet
from parcorp.queries.registry import q, query, sql_replace, table

# special tokens for texts that have none
TOKENS = [(" la ", "<SURFACE>"), (" der ", "<SURFACE>"), (" de ", "..."), (" und ", "<unk>"),
          (" et ", "<RULING>"), (" the ", "<SURFACE>"), (" of ", "<COLUMN>")]
TOKEN_RE = "(?s)" + "|".join(t.replace(".", "\\.") for t in K.VOCAB_SPECIALS) + "|."


def split_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(TOKEN_RE)})"


def turns(spark, sf_dir):
    """Conversation turns with a text id, special tokens put in."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "role",
        replace_in_order(F.col("text"), TOKENS).alias("text"),
    )


def pairs(spark, sf_dir):
    """A user turn with the assistant turn that follows it."""
    conv = turns(spark, sf_dir)
    user = conv.where("role = 'user'").select("id", "conv_id", "turn", F.col("text").alias("source"))
    answer = conv.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return user.join(answer, ["conv_id", "turn"]).select("id", "source", "target")


def vocab(spark, sf_dir):
    """From the benchmark, so that other languages have unknown characters."""
    return Q.vocabulary(table(spark, sf_dir, "benchmark"), "text")


TURNS_SQL = f"""
turns AS MATERIALIZED (SELECT conv_id || '-' || turn AS id, conv_id, turn, role, {sql_replace('text', TOKENS)} AS text
  FROM conversations)
"""
PAIRS_SQL = f"""{TURNS_SQL},
pairs AS MATERIALIZED (SELECT u.id, u.text AS source, a.text AS target FROM turns u JOIN turns a
  ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' AND a.role = 'assistant')
"""
SPECIALS_VALUES = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(K.VOCAB_SPECIALS))


def vocab_sql(source: str) -> str:
    plain = sql_replace("text", [(t, "") for t in K.VOCAB_SPECIALS])
    return f"""
specials(token_id, token) AS (VALUES {SPECIALS_VALUES}),
letters AS (SELECT DISTINCT c FROM (SELECT unnest(string_split({plain}, '')) AS c FROM {source}) WHERE c <> ''),
vocab AS MATERIALIZED (SELECT token, CAST(token_id AS BIGINT) AS token_id FROM specials
  UNION ALL SELECT c, row_number() OVER (ORDER BY c) + 10 FROM letters)
"""


def encode_sql(name: str, source: str, column: str) -> str:
    return f"""
{name}_t AS (SELECT id, unnest({split_sql(column)}) AS token, generate_subscripts({split_sql(column)}, 1) AS pos FROM {source}),
{name} AS MATERIALIZED (SELECT s.id, list_concat(list_concat([0], coalesce(e.ids, [])), [2]) AS ids
  FROM {source} s LEFT JOIN (SELECT id, list(CAST(coalesce(token_id, 3) AS INTEGER) ORDER BY pos) AS ids
    FROM {name}_t LEFT JOIN vocab USING (token) GROUP BY id) e ON s.id = e.id)
"""


VOCAB_SQL = vocab_sql("benchmark")
ENCODED_SQL = f"{TURNS_SQL}, {VOCAB_SQL}, {encode_sql('enc', 'turns', 'text')}"
JOIN_IDS = "array_to_string(ids, ' ')"


def encoded(spark, sf_dir):
    df = turns(spark, sf_dir).select("id", "text")
    return Q.encode(df, vocab(spark, sf_dir), "text")


def text_of(ids):
    return F.array_join(ids, " ")


@query("q_vocab", f"WITH {vocab_sql('documents')} SELECT token, token_id FROM vocab")
def q_vocab(spark, sf_dir):
    return Q.vocabulary(table(spark, sf_dir, "documents"), "text")


@query("q_vocab_diff", f"""
WITH {vocab_sql('documents')},
seen AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark)
SELECT 'not_in_alphabet' AS kind, token FROM vocab WHERE length(token) = 1 AND token NOT IN (SELECT c FROM seen WHERE c <> chr(10))
UNION ALL SELECT 'multi', token FROM vocab WHERE length(token) <> 1
""")
def q_vocab_diff(spark, sf_dir):
    return Q.vocabulary_diff(
        q_vocab(spark, sf_dir), alphabet(table(spark, sf_dir, "benchmark"), "text")
    )


@query("q_vocab_lookup", f"""
WITH {VOCAB_SQL}, t AS (SELECT DISTINCT unnest(list_concat(string_split(text, ''), string_split(text, ' '))) AS token
  FROM conversations)
SELECT token, coalesce(CAST(token_id AS VARCHAR), 'Token not found in vocabulary') AS token_id
FROM t LEFT JOIN vocab USING (token) WHERE token <> ''
""")
def q_vocab_lookup(spark, sf_dir):
    both = F.concat(F.split("text", ""), F.split("text", " "))
    toks = table(spark, sf_dir, "conversations").select(
        F.explode(F.array_distinct(both)).alias("token")
    ).where("token <> ''").distinct()
    return Q.token_ids(toks, vocab(spark, sf_dir))


@query("q_encode", f"""
WITH {ENCODED_SQL}
SELECT id, {JOIN_IDS} AS ids,
  array_to_string(list_transform(ids, lambda i: CASE WHEN i < 11 THEN 1 ELSE 0 END), ' ') AS mask FROM enc
""")
def q_encode(spark, sf_dir):
    ids = F.col("input_ids")
    return encoded(spark, sf_dir).select("id", text_of(ids).alias("ids"), text_of(S.special_mask(ids)).alias("mask"))


@query("q_chunk", f"""
WITH {ENCODED_SQL},
n AS (SELECT id, ids, len(ids) AS n FROM enc),
w AS (SELECT id, unnest(CASE WHEN n <= 64 THEN [ids] WHEN n <= 128 THEN [ids[1:64], ids[n - 63:n]]
    ELSE list_concat(list_transform(range(0, n - 63, 54), lambda s: ids[s + 1:s + 64]), [ids[n - 63:n]]) END) AS c,
  generate_subscripts(CASE WHEN n <= 64 THEN [ids] WHEN n <= 128 THEN [ids[1:64], ids[n - 63:n]]
    ELSE list_concat(list_transform(range(0, n - 63, 54), lambda s: ids[s + 1:s + 64]), [ids[n - 63:n]]) END, 1) AS k FROM n)
SELECT id, CAST(k - 1 AS BIGINT) AS chunk, array_to_string(c, ' ') AS ids,
  CAST(len(list_filter(c, lambda i: i < 11)) AS BIGINT) AS n_special FROM w
""")
def q_chunk(spark, sf_dir):
    df = encoded(spark, sf_dir).withColumn("mask", S.special_mask(F.col("input_ids")))
    out = Q.chunked(df, ["input_ids", "mask"], ["id"])
    n_special = F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("bigint")
    return out.select(
        "id", F.col("chunk").cast("bigint").alias("chunk"), text_of("input_ids").alias("ids"),
        n_special.alias("n_special"),
    )


PAIR_ENCODED_SQL = f"""{PAIRS_SQL}, {VOCAB_SQL},
{encode_sql('src', 'pairs', 'source')}, {encode_sql('tgt', 'pairs', 'target')}
"""


@query("q_pair_encode", f"""
WITH {PAIR_ENCODED_SQL}
SELECT src.id, array_to_string(src.ids, ' ') AS input_ids, array_to_string(tgt.ids, ' ') AS labels
FROM src JOIN tgt USING (id)
""")
def q_pair_encode(spark, sf_dir):
    v = vocab(spark, sf_dir)
    df = Q.encode_columns(pairs(spark, sf_dir), v, {"source": "input_ids", "target": "labels"})
    return df.select("id", text_of("input_ids").alias("input_ids"), text_of("labels").alias("labels"))


@query("q_len_gate", f"""
WITH {PAIRS_SQL}
SELECT id, CAST(len({split_sql('source')}) + 2 AS BIGINT) AS n_source, CAST(len({split_sql('target')}) + 2 AS BIGINT) AS n_target,
  greatest(len({split_sql('source')}), len({split_sql('target')})) + 2 <= 256 AS fits FROM pairs
""")
def q_len_gate(spark, sf_dir):
    df = pairs(spark, sf_dir).select(
        "id", S.encoded_length(F.col("source")).cast("bigint").alias("n_source"),
        S.encoded_length(F.col("target")).cast("bigint").alias("n_target"),
    )
    return df.withColumn("fits", Q.fits(F.col("n_source"), F.col("n_target")))


SURFACED = [(" the ", "<SURFACE>"), (" de ", "<SURFACE>"), (" der ", "<SURFACE>")]
SKELETON = [(c, "") for c in "aeiou"]


def _side_sql(column: str) -> str:
    return (f"list_transform(list_filter(string_split({column}, '<SURFACE>'), lambda s: s <> ''), "
            "lambda s: '<SURFACE>' || s)")


@query("q_long_example_split", f"""
WITH d AS (SELECT doc_id AS id, {sql_replace(sql_replace('text', SURFACED), SKELETON)} AS glyphs,
  {sql_replace('text', SURFACED + [(' zu ', '<SURFACE>')])} AS translit FROM documents),
e AS (SELECT *, greatest(len({split_sql('glyphs')}), len({split_sql('translit')})) + 2 <= 256 AS ok,
  {_side_sql('glyphs')} AS l, {_side_sql('translit')} AS r FROM d),
p AS (SELECT id, 0 AS piece, glyphs, translit, CASE WHEN ok THEN 'ok' ELSE 'rejected' END AS status
  FROM e WHERE ok OR len(l) <> len(r)
  UNION ALL SELECT id, generate_subscripts(l, 1), unnest(l), unnest(r), NULL FROM e WHERE NOT ok AND len(l) = len(r))
SELECT id, CAST(piece AS BIGINT) AS piece, glyphs, translit, coalesce(status, CASE WHEN
  greatest(len({split_sql('glyphs')}), len({split_sql('translit')})) + 2 <= 256 THEN 'fixed' ELSE 'too_long' END) AS status
FROM p
""")
def q_long_example_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        replace_in_order(F.col("text"), SURFACED + SKELETON).alias("glyphs"),
        replace_in_order(F.col("text"), SURFACED + [(" zu ", "<SURFACE>")]).alias("translit"),
    )
    out = Q.split_long_pairs(docs, "glyphs", "translit", ["id"])
    return out.withColumn("piece", F.col("piece").cast("bigint"))


@query("q_pad_truncate", f"""
WITH {ENCODED_SQL}
SELECT id, array_to_string(list_concat(ids, list_transform(range(128), lambda i: 1))[1:128], ' ') AS ids FROM enc
""")
def q_pad_truncate(spark, sf_dir):
    return encoded(spark, sf_dir).select("id", text_of(S.padded_or_cut(F.col("input_ids"))).alias("ids"))


@query("q_pad_bucket", f"""
WITH {ENCODED_SQL},
b AS (SELECT id, ids, (row_number() OVER (ORDER BY md5('42|' || id), id) - 1) // 16 AS batch FROM enc),
m AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch) / 128.0) * 128 AS BIGINT) AS size FROM b)
SELECT id, batch, array_to_string(list_concat(ids, list_transform(range(size - len(ids)), lambda i: 1)), ' ') AS ids FROM m
""")
def q_pad_bucket(spark, sf_dir):
    out = Q.padded_batches(encoded(spark, sf_dir).select("id", "input_ids"), "input_ids", 16)
    return out.select("id", "batch", text_of("padded").alias("ids"))


def _fraction(digest: str, start: int) -> str:
    return f"(CAST('0x' || substr({digest}, {start}, 8) AS BIGINT) / 4294967296.0)"


MASK_DIGEST = "md5('11|' || id || '|' || ((p - 1) // 4))"
MASK_BELOW = f"{math.ceil(0.15 * 16**8):08x}"
OWN_DIGEST = "md5('11|' || id || '|' || (p - 1) || '|new')"


@query("q_mlm_mask", f"""
WITH {ENCODED_SQL},
t AS (SELECT id, unnest(ids) AS i, generate_subscripts(ids, 1) AS p FROM enc),
h AS (SELECT *, {MASK_DIGEST} AS g, {OWN_DIGEST} AS d FROM t),
c AS (SELECT *, i >= 11 AND substr(g, (p - 1) % 4 * 8 + 1, 8) < '{MASK_BELOW}' AS chosen FROM h),
o AS (SELECT id, p, CASE WHEN NOT chosen THEN i WHEN {_fraction('d', 1)} < 0.8 THEN 4
    WHEN {_fraction('d', 1)} < 0.9 THEN CAST(floor({_fraction('d', 9)} * (SELECT count(*) FROM vocab)) AS INTEGER) ELSE i END AS nid,
  CASE WHEN chosen THEN i ELSE -100 END AS label FROM c)
SELECT id, string_agg(nid, ' ' ORDER BY p) AS ids, string_agg(label, ' ' ORDER BY p) AS labels FROM o GROUP BY id
""")
def q_mlm_mask(spark, sf_dir):
    size = vocab(spark, sf_dir).count()  # at most Unicode's characters and the special tokens
    pair = S.masked(F.col("input_ids"), F.col("id"), F.lit(size), 0.15, 11)
    df = encoded(spark, sf_dir).withColumn("_m", pair)
    return df.select("id", text_of(F.col("_m.id")).alias("ids"), text_of(F.col("_m.label")).alias("labels"))


@query("q_decode", f"""
WITH {ENCODED_SQL},
t AS (SELECT id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS p FROM enc)
SELECT enc.id, coalesce(x.text, '') AS text FROM enc LEFT JOIN (
  SELECT id, string_agg(token, '' ORDER BY p) AS text FROM t JOIN vocab USING (token_id)
  WHERE token_id >= 11 GROUP BY id) x ON enc.id = x.id
""")
def q_decode(spark, sf_dir):
    df = encoded(spark, sf_dir).select("id", "input_ids")
    return Q.decode(df, vocab(spark, sf_dir), "input_ids").select("id", "text")


# ---- metrics ---------------------------------------------------------------------------------
@query("q_masked_accuracy", """
WITH v AS (SELECT list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS p,
  list_transform(embedding, lambda x, i: CASE WHEN x > 0.1 THEN -100 WHEN (i + label) % 3 = 0 THEN 1 ELSE 0 END) AS l
  FROM embeddings),
e AS (SELECT unnest(p) AS p, unnest(l) AS l FROM v)
SELECT count(*) AS positions, round(avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e WHERE l <> -100
""")
def q_masked_accuracy(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    tenth = F.lit(0.1)
    label = F.transform("embedding", lambda x, i: F.when(x.cast("double") > tenth, -100).when(
        (i + 1 + F.col("label")) % 3 == 0, 1).otherwise(0))
    df = emb.select(
        F.transform("embedding", lambda x: (x > 0).cast("int")).alias("pred"), label.alias("label")
    )
    return metrics.masked_accuracy(df)


@query("q_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings
""")
def q_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.argmax(F.col("embedding")).cast("bigint").alias("best"))


@query("q_gen_len", f"""
WITH {ENCODED_SQL}
SELECT round(avg(len(list_filter(list_concat(ids, list_transform(range(greatest(128 - len(ids), 0)), lambda i: 1)), lambda i: i <> 1))), 4)
  AS gen_len FROM enc
""")
def q_gen_len(spark, sf_dir):
    df = encoded(spark, sf_dir).select(S.padded(F.col("input_ids"), F.lit(K.PAD_LEN)).alias("ids"))
    return metrics.mean_length(df, "ids")


def _grams_sql(column: str, rows: str) -> str:
    toks = f"list_filter(string_split(regexp_replace({column}, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
    return " UNION ALL ".join(
        f"SELECT id, {n} AS n, unnest(list_transform(range(1, len(t) - {n - 2}), "
        f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS gram FROM (SELECT id, {toks} AS t FROM {rows}) WHERE len(t) >= {n}"
        for n in range(1, 5)
    )


def bleu_sql(pairs_sql: str, rows: str = "pairs") -> str:
    return f"""
WITH {pairs_sql},
h AS (SELECT id, n, gram, count(*) AS c FROM ({_grams_sql('source', rows)}) GROUP BY ALL),
r AS (SELECT id, n, gram, count(*) AS c FROM ({_grams_sql('target', rows)}) GROUP BY ALL),
m AS (SELECT h.n, sum(h.c) AS total, sum(least(h.c, coalesce(r.c, 0))) AS matches FROM h LEFT JOIN r USING (id, n, gram) GROUP BY h.n),
rl AS (SELECT coalesce(sum(c), 0) AS ref_len FROM r WHERE n = 1),
z AS (SELECT *, sum(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM m),
s AS (SELECT exp(sum(ln(CASE WHEN matches > 0 THEN 100.0 * matches / total ELSE 100.0 / (pow(2, zeros) * total) END)) / 4) AS g,
  max(CASE WHEN n = 1 THEN total END) AS sys_len, sum(matches) AS found FROM z)
SELECT round(CASE WHEN found = 0 THEN 0.0 ELSE CASE WHEN sys_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / sys_len) END * g END, 4) AS bleu,
  CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len FROM s, rl
"""


@query("q_bleu", bleu_sql(PAIRS_SQL))
def q_bleu(spark, sf_dir):
    return metrics.corpus_bleu(pairs(spark, sf_dir), "source", "target")


# the second side's words all begin with a mark that the first side does not have
DISJOINT_SQL = PAIRS_SQL + """,
apart AS (SELECT id, source, '~' || replace(replace(target, ' ', ' ~'), chr(10), ' ~') AS target FROM pairs)
"""


@query("q_bleu_disjoint", bleu_sql(DISJOINT_SQL, "apart"))
def q_bleu_disjoint(spark, sf_dir):
    target = F.replace(F.replace("target", F.lit(" "), F.lit(" ~")), F.lit("\n"), F.lit(" ~"))
    apart = pairs(spark, sf_dir).select("id", "source", F.concat(F.lit("~"), target).alias("target"))
    return metrics.corpus_bleu(apart, "source", "target")


def spaced_13a_sql(expr: str) -> str:
    expr = f"' ' || {sql_replace(expr, metrics.MARKUP_13A + metrics.ENTITIES_13A)} || ' '"
    for pattern, new in metrics.RULES_13A:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(new)}, 'g')"
    return expr


SPACED_SQL = PAIRS_SQL + f""",
spaced AS (SELECT id, {spaced_13a_sql('source')} AS source, {spaced_13a_sql('target')} AS target FROM pairs)
"""


@query("q_bleu_13a", bleu_sql(SPACED_SQL, "spaced"))
def q_bleu_13a(spark, sf_dir):
    return metrics.corpus_bleu(pairs(spark, sf_dir), "source", "target", tokenise="13a")
