"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.llm import (
    centroids, chat, exact_dedup, langid, licences, mixing, packing, pq_dedup, secrets, simhash, spelling, suffixes, warc,
)
from parcorp.llm.common import at_least, with_package, written
from parcorp.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    with_package(spark)
    return at_least(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# ---- 6: exact de-duplication -------------------------------------------------------------
@query("op6_exact_dedup", """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.exact_groups(docs)
    return out.select(
        "row.doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


# ---- 3: secret scans ---------------------------------------------------------------------
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    kinds = [(i, kind, p) for i, (kind, p) in enumerate([*secrets.SEARCHED.items(), ("markov", secrets.TOKEN)])]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, {_q(p)}, 0)) AS m, "
        f"unnest(string_split_regex(t, {_q(p)})[1:len(regexp_extract_all(t, {_q(p)}, 0))]) AS gap, "
        f"generate_subscripts(regexp_extract_all(t, {_q(p)}, 0), 1) AS i FROM d"
        for i, kind, p in kinds)
    code = f"strpos('{secrets.ALPHABET}', %s)"
    pair = f"{code % 'token[p]'} * {secrets.SYMBOLS} + {code % 'token[p + 1]'}"
    n = secrets.SYMBOLS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lim AS (SELECT format('{{:07x}}', least(CAST({secrets.FIT_DOCS} AS BIGINT) * 16777216 // greatest(count(*), 1), 16777216)) AS b FROM d),
w AS (SELECT unnest(regexp_extract_all(t, '[A-Za-z]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(t, '[A-Za-z]{{3,}}'), 1) - 1 AS i
  FROM d, lim WHERE '0' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) < b),
ids AS (SELECT unnest(range({secrets.FIT_RANDOM})) AS id),
b64 AS (SELECT id, sha256(CAST(id AS VARCHAR)) AS h, to_base64(unhex(sha256(CAST(id AS VARCHAR)))) AS b FROM ids),
samples AS (
  SELECT CASE i % 4 WHEN 0 THEN lower(w) || '_' || lower(w) WHEN 1 THEN lower(w) || upper(w[1]) || lower(w[2:]) || (i % 10)
    WHEN 2 THEN upper(w) || '-' || lower(w) ELSE w END AS token, 0 AS r FROM w
  UNION ALL SELECT CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS VARCHAR), 0 FROM ids
  UNION ALL SELECT CASE id % 4 WHEN 0 THEN h WHEN 1 THEN b WHEN 2 THEN upper(translate(b, '+/=', ''))
    ELSE translate(b, '+/=', '-_') END, 1 FROM b64),
sp AS (SELECT token, r, unnest(range(1, length(token))) AS p FROM samples),
cnt AS (SELECT {pair} AS pair, sum(r) AS r, sum(1 - r) AS o FROM sp GROUP BY 1),
tot AS (SELECT pair // {n} AS f, sum(r) AS rt, sum(o) AS ot FROM cnt GROUP BY 1),
model AS (SELECT g.pair, CAST(round(1000 * (ln(coalesce(r, 0) + 1) - ln(coalesce(rt, 0) + {n}) - ln(coalesce(o, 0) + 1)
    + ln(coalesce(ot, 0) + {n}))) AS BIGINT) AS llr
  FROM (SELECT unnest(range({n * n})) AS pair) g LEFT JOIN cnt USING (pair) LEFT JOIN tot ON f = g.pair // {n}),
found AS ({found}),
placed AS (SELECT doc_id, k, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM found),
score AS (SELECT token, sum(llr) AS s FROM (SELECT token, {pair} AS pair FROM (SELECT token, unnest(range(1, length(token))) AS p
  FROM (SELECT DISTINCT m AS token FROM placed WHERE kind = 'markov'))) JOIN model USING (pair) GROUP BY token),
spans AS (SELECT doc_id, k, kind, e - length(m) AS b, e FROM placed LEFT JOIN score ON m = token AND kind = 'markov'
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, {_q(secrets.SEARCHED['assign'])}, 2)) >= {secrets.MIN_VALUE}
    WHEN 'markov' THEN s >= {secrets.LLR_MILLI} ELSE true END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (kind <> 'markov'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k), '') AS spans, count(*) FILTER (kind = 'markov') AS n_markov
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


@query("op3_secret_scan", _secret_sql())
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_samples(docs))
    base = list(secrets.PATTERNS)
    out = secrets.find(docs, model)
    return out.select(
        "row.doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed([*base, "markov"]).alias("spans"),
        F.size("markov").cast("bigint").alias("n_markov"),
    )


# ---- 2: mixing sources to target weights ---------------------------------------------------
@query("op2_pfair_mix", """
WITH RECURSIVE
ids AS (SELECT doc_id, coalesce(source, '') AS s,
               md5('42|' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
cnt AS (SELECT s, count(*) AS rows_, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n,
               row_number() OVER (ORDER BY s) AS j FROM ids GROUP BY s),
src AS (SELECT *, CAST(greatest(1, round(50 * pow(rows_ / (SELECT max(rows_) FROM cnt), 0.7))) AS BIGINT) AS w FROM cnt),
rounds AS (SELECT unnest(range(0, (SELECT CAST(max(ceil(n / w)) AS BIGINT) FROM src))) AS r),
seg AS (SELECT r, CAST(sum(least(n, w * r)) AS BIGINT) AS f0,
               list(greatest(least(w, n - w * r), 0) ORDER BY j) AS q, list(w * r ORDER BY j) AS base,
               CAST(sum(greatest(least(w, n - w * r), 0)) AS BIGINT) AS len FROM rounds, src GROUP BY r),
run AS (
  SELECT r, CAST(0 AS BIGINT) AS t, f0, len, q, base, list_transform(q, lambda c: CAST(0 AS BIGINT)) AS cnt,
         CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS block FROM seg
  UNION ALL
  SELECT r, t + 1, f0, len, q, base, list_transform(cnt, lambda c, i: CASE WHEN i = best THEN c + 1 ELSE c END),
         best, base[best] + cnt[best]
  FROM (SELECT *, list_min(list_filter(list_transform(cnt, lambda c, i:
               CASE WHEN c < q[i] AND c * len // greatest(q[i], 1) <= t
                    THEN {'due': ((c + 1) * len + q[i] - 1) // q[i], 'j': i} END), lambda z: z IS NOT NULL)).j AS best
        FROM run WHERE t < len)),
plan AS (SELECT f0 + t - 1 AS slot, j, block FROM run WHERE j IS NOT NULL),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY key, doc_id) - 1 AS rank_ FROM ids),
placed AS (SELECT doc_id, s, rank_, rank_ // 16 AS block, slot
           FROM ranked JOIN src USING (s) JOIN plan ON plan.j = src.j AND plan.block = rank_ // 16)
SELECT doc_id, s AS source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, rank_) - 1 AS BIGINT) AS position
FROM placed
""")
def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


# ---- 1: WARC -------------------------------------------------------------------------------
@query("op1_warc_salvage", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
""")
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.planned(pages), path)
    records = warc.read(spark, path, payload=False)
    # these archives are sound: a gap in them would be a lost page
    lost = F.raise_error(F.concat_ws(" ", F.lit("unreadable bytes in"), "path", "offset", "length", "reason"))
    return records.select(
        F.when(F.col("status") == "record", warc.page_of("record_id")).otherwise(lost.cast("bigint")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.col("payload_digest"), F.col("type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"),
    )


# ---- 7: SimHash near-duplicates ------------------------------------------------------------
@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_groups(docs)
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


# ---- 5: language identification --------------------------------------------------------------
@query("op5_language_spans")
def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identified(docs)
    runs = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["lang"]))
    return out.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("bigint").alias("n_spans"), F.array_join(runs, ",").alias("spans"),
    )


# ---- 10: embedding near-duplicates -------------------------------------------------------------
@query("op10_pq_near_dedup", """
WITH RECURSIVE
u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN cnt USING (vec_id)
""")
def op10_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


# ---- 9: chat formatting ------------------------------------------------------------------------
_LOOKS_LIKE = r"([<\[])(\\*)(/?s>|\|endoftext\|>|/?INST\]|/?SYS\]|/?ROLE\])"


@query("op9_chat_format", r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '%(p)s', '\1\\\2\3', 'g')) AS chars,
             length(regexp_replace(role, '%(p)s', '\1\\\2\3', 'g')) AS role_chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
                            ELSE 17 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""" % {"p": _LOOKS_LIKE})
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(written(chat.formatted(turns.unionByName(odd)), "chat"))


# ---- 8: repeated passages ------------------------------------------------------------------------
@query("op8_suffix_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS k FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1 AS first,
             count(*) OVER (PARTITION BY k) AS n FROM h QUALIFY n > 1),
s AS (SELECT doc_id, pos, kind,
             CASE WHEN pos - lag(pos) OVER o <= 50 THEN 0 ELSE 1 END AS new
      FROM (SELECT doc_id, pos, 'every' AS kind FROM r UNION ALL SELECT doc_id, pos, 'later' FROM r WHERE NOT first)
      WINDOW o AS (PARTITION BY kind, doc_id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY kind, doc_id ORDER BY pos) AS span FROM s),
j AS (SELECT kind, doc_id, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY kind, doc_id, span),
t AS (SELECT kind, doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS n,
             count(*) AS c FROM j GROUP BY kind, doc_id)
SELECT d.doc_id, coalesce(e.c, 0) AS n_spans, coalesce(e.spans, '') AS spans, coalesce(e.n, 0) AS repeated_words,
       coalesce(l.spans, '') AS later_spans, coalesce(l.n, 0) AS later_words
FROM d LEFT JOIN t e ON e.doc_id = d.doc_id AND e.kind = 'every'
       LEFT JOIN t l ON l.doc_id = d.doc_id AND l.kind = 'later'
""")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    return out.select(
        "doc_id", F.size("spans").cast("bigint").alias("n_spans"), listed("spans").alias("spans"),
        F.col("n_words").alias("repeated_words"), listed("later").alias("later_spans"),
        F.col("n_later").alias("later_words"))


# ---- 4: best-fit packing ---------------------------------------------------------------------------
@query("op4_best_fit_pack")
def op4_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


# ---- 11: centroid clustering -------------------------------------------------------------------------
def _centroid_sql() -> str:
    def nearest(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (
  SELECT rid, vec_id, q, m.c, m.d FROM (
    SELECT rid, vec_id, v.q, min({{'d': CAST(list_sum(list_transform(list_zip(v.q, k.q),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': k.c}}) AS m
    FROM v, c{i} k GROUP BY ALL))"""

    def move(i: int) -> str:
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.q, k.q) AS q FROM c{i} k LEFT JOIN (
    SELECT c, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY p) AS q
    FROM (SELECT c, p, sum(x) AS s, count(*) AS n
          FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c) m USING (c))"""

    steps = ",".join(s for i in range(centroids.ROUNDS) for s in (nearest(i), move(i)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x:
    CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {centroids.DIM}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q
  FROM v QUALIFY c < {centroids.CENTROIDS}),{steps},{nearest(centroids.ROUNDS)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} k USING (c)
"""


@query("op11_centroid_clusters", _centroid_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.grouped(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# ---- 12: spelling variants -----------------------------------------------------------------------------
@query("op12_spelling_variants", """
WITH RECURSIVE
step AS (SELECT b AS v, b, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, b, k + 1 FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
o AS MATERIALIZED (SELECT id, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(
          regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
        lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM o, tab),
cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w FROM h),
word AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
del AS MATERIALIZED (SELECT w, n, i, w[:i] || w[i + 2:] AS rest FROM (SELECT w, n, unnest(range(length(w))) AS i FROM word)),
link AS (SELECT a.w, b.w AS o, b.n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
  UNION SELECT d.w, x.w, x.n FROM del d JOIN word x ON x.w = d.rest
  UNION SELECT x.w, d.w, d.n FROM del d JOIN word x ON x.w = d.rest),
near AS MATERIALIZED (SELECT w, count(*) AS n_near, min({'n': -n, 'o': o}) AS best FROM link GROUP BY w),
f AS MATERIALIZED (SELECT word.w, word.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.n >= 2 * word.n THEN best.o END AS form, CASE WHEN -best.n >= 2 * word.n THEN -best.n END AS form_n
  FROM word LEFT JOIN near USING (w)),
walk AS (SELECT w, w AS here, form AS next FROM f
  UNION ALL SELECT walk.w, f.w, f.form FROM walk JOIN f ON f.w = walk.next)
SELECT w AS word, form, here AS root, n, n_near, form_n FROM f JOIN walk USING (w) WHERE next IS NULL
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- 13: licences ----------------------------------------------------------------------------------------
def _licence_sql() -> str:
    texts = [licences.words_of(t.text) for t in licences.TEMPLATES]
    body = ", ".join(f"({t}, {q}, '{w}')" for t, ws in enumerate(texts) for q, w in enumerate(ws))
    labels = ", ".join(f"({i}, '{t.label}', {len(ws)})" for i, (t, ws) in enumerate(zip(licences.TEMPLATES, texts)))
    keys = []
    for t, (template, ws) in enumerate(zip(licences.TEMPLATES, texts)):
        for key in template.keys:
            k = key.split()
            keys.append(f"({t}, {next(q for q in range(len(ws)) if ws[q:q + len(k)] == k)}, {k})")
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licences.PHRASES.items())
    return f"""
WITH body(t, q, w) AS (VALUES {body}), label(t, label, len) AS (VALUES {labels}),
key(t, q, k) AS (VALUES {', '.join(keys)}), phrase(k, label) AS (VALUES {phrases}),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licences.WORD}') AS ws FROM documents),
x AS MATERIALIZED (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
base AS (SELECT rid, i, label FROM phrase JOIN x ON x.w = k[1] JOIN d USING (rid) WHERE ws[i + 1:i + len(k)] = k),
hit AS MATERIALIZED (SELECT * FROM x WHERE w IN (SELECT w FROM body)),
df AS (SELECT w, count(DISTINCT rid) AS df FROM hit GROUP BY w),
dead AS (SELECT DISTINCT t FROM (SELECT t, unnest(k) AS w FROM key) LEFT JOIN df USING (w) WHERE df IS NULL),
rare AS (SELECT DISTINCT t, w, df FROM body JOIN df USING (w) WHERE t NOT IN (SELECT t FROM dead)),
post AS (SELECT t, w, df FROM rare QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, w) <= {licences.TEMPLATE_WORDS}),
mine AS (SELECT rid, w FROM (SELECT DISTINCT rid, w, df FROM hit JOIN (SELECT DISTINCT w, df FROM post) USING (w))
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY df, w) <= {licences.FILE_WORDS}),
cand AS (SELECT rid, t, i - q AS s FROM hit JOIN mine USING (rid, w) JOIN post USING (w) JOIN body USING (t, w)
  GROUP BY ALL HAVING count(DISTINCT w) >= {licences.ALIGNED}),
good AS (SELECT rid, t, s FROM cand JOIN key USING (t) JOIN d USING (rid) GROUP BY ALL
  HAVING bool_and(s + q >= 0 AND ws[s + q + 1:s + q + len(k)] = k)),
note AS (SELECT rid, t, s, label, count(*) FILTER (x.w = body.w) / any_value(len) AS share
  FROM good JOIN label USING (t) JOIN body USING (t) JOIN x USING (rid) WHERE i = s + q GROUP BY ALL),
b AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY rid),
n AS (SELECT rid, max(share) AS score FROM note GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM note) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(b.l, '') AS base_labels, coalesce(al.l, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN n USING (rid) LEFT JOIN al USING (rid)
"""


@query("op13_licence_scan", _licence_sql())
def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(*labels) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")

    starts = F.transform("base", lambda b: b["start"].cast("bigint"))
    base, more = F.transform("base", lambda b: b["label"]), F.transform("notices", lambda b: b["label"])
    return out.select(
        "row.doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(base, more).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda b: b["share"])), F.lit(0.0)).alias("score"))
