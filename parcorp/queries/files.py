"""Readers and writers: given tables written below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcorp import schemas
from parcorp.operators import joins
from parcorp.operators import lookups as L
from parcorp.operators import sequences as Q
from parcorp.operators.atf import parsed
from parcorp.operators.sample import stratified_split
from parcorp.queries.corpus import SPLIT_SQL, texts
from parcorp.queries.registry import query, table
from parcorp.queries.sequences import ENCODED_SQL, encoded, vocab
from parcorp.session import shared_dir
from parcorp.sources import readers, sinks


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- CSV --------------------------------------------------------------------------------------
@query("q_csv_source", """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE source WHEN 'src3' THEN '' ELSE text END AS transliteration,
  CASE lang WHEN 'fr' THEN '' ELSE lang END AS period, source AS genre FROM documents
""")
def q_csv_source(spark, sf_dir):
    """Columns in another order, one more than the schema has, null words and nulls."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("genre"), F.col("n_chars").alias("length"),
        F.when(F.col("source") != "src3", F.col("text")).alias("transliteration"),
        F.when(F.col("lang") == "fr", "NaN").otherwise(F.col("lang")).alias("period"),
        F.col("doc_id").alias("id"),
    )
    path = folder(spark, "csv")
    sinks.table_csv(docs, path)
    return readers.corpus_csv(spark, path)


@query("q_keyed_csv_source", """
SELECT CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderkey END AS artifact_id,
  CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_orderpriority END AS artifact_type FROM orders
""")
def q_keyed_csv_source(spark, sf_dir):
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select(
        F.when(status == "F", "n/a").otherwise(F.col("o_orderpriority")).alias("artifact_type"),
        F.col("o_custkey").alias("owner"), F.when(status != "P", F.col("o_orderkey")).alias("artifact_id"),
    )
    path = folder(spark, "keyed")
    sinks.table_csv(orders, path)
    return readers.keyed_csv(spark, path, schemas.ARTIFACTS)


# ---- JSON -------------------------------------------------------------------------------------
@query("q_sign_list", """
WITH s AS (SELECT doc_id, 'S&' || source || '.' || doc_id % 7 AS n,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '*' END AS glyph,
    CASE WHEN doc_id % 3 = 0 THEN ['A&' || lang, 'B' || doc_id] ELSE [] END AS aka,
    CASE WHEN doc_id % 4 = 0 THEN [] ELSE [lang || doc_id, source] END AS vals FROM documents),
f AS (SELECT 'F' || n AS n, 'f' || glyph AS glyph, CAST([] AS VARCHAR[]) AS aka, ['v' || doc_id] AS vals FROM s WHERE doc_id % 2 = 0),
e AS (SELECT n, glyph, aka, vals FROM s UNION ALL SELECT * FROM f)
SELECT 'reading' AS kind, unnest(vals) AS key, n AS value FROM e
UNION ALL SELECT 'glyph', unnest(list_prepend(n, aka)), glyph FROM e
""")
def q_sign_list(spark, sf_dir):
    """A nested sign list per document: aliases, forms, escaped names, absent keys."""
    record = F.struct(F.array(sign_letter()).alias("j:letters"))
    path = folder(spark, "signs")
    sinks.lookup_json(table(spark, sf_dir, "documents").select(record.alias("sl:signlist")), path)
    return sign_edges(readers.sign_list(spark, path, lines=True))


def sign_letter():
    """A letter of a sign list made of a document."""
    d = F.col("doc_id")

    def named(field: str, *values):
        items = [F.struct(F.struct(v.alias("n")).alias(field)) for v in values]
        return F.array(*items)

    text = F.concat
    n = text(F.lit("S&amp;"), F.col("source"), F.lit("."), (d % 7).cast("string"))
    glyph = F.when(d % 5 != 0, text(F.col("lang"), F.lit("*")))
    aka = F.when(d % 3 == 0, named("sl:aka", text(F.lit("A&amp;"), F.col("lang")), text(F.lit("B"), d.cast("string"))))
    values = F.when(d % 4 != 0, named("sl:v", text(F.col("lang"), d.cast("string")), F.col("source"), F.lit(None).cast("string")))
    form = F.struct(
        text(F.lit("F"), n).alias("n"), text(F.lit("f"), F.coalesce(glyph, F.lit(""))).alias("sl:ucun"),
        named("sl:v", text(F.lit("v"), d.cast("string"))).alias("j:values"))
    sign = F.struct(
        n.alias("n"), glyph.alias("sl:ucun"), aka.alias("j:aka"), values.alias("j:values"),
        F.when(d % 2 == 0, F.array(F.struct(form.alias("sl:form")))).alias("j:forms"))
    return F.struct(F.struct(F.array(F.struct(sign.alias("sl:sign"))).alias("j:signs")).alias("sl:letter"))


def sign_edges(sign_list):
    entries = L.sign_entries(sign_list)
    readings = L.reading_edges(entries).select(F.lit("reading").alias("kind"), F.col("reading").alias("key"), F.col("name").alias("value"))
    glyphs = L.glyph_edges(entries).select(F.lit("glyph").alias("kind"), F.col("name").alias("key"), F.col("glyph").alias("value"))
    return readings.unionByName(glyphs)


@query("q_index_json", """
SELECT lang || doc_id AS reading, source AS name FROM documents UNION ALL SELECT 'i' || item_id, 'bench' FROM benchmark
""")
def q_index_json(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.create_map(F.concat("lang", F.col("doc_id").cast("string")), "source").alias("index"))
    items = table(spark, sf_dir, "benchmark").select(
        F.create_map(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.lit("bench")).alias("index"))
    path = folder(spark, "index")
    sinks.lookup_json(docs.unionByName(items), path)
    return readers.index_json(spark, path, lines=True)


@query("q_atf_files", """
WITH c AS (SELECT conv_id || '-' || turn AS id, role, text FROM conversations)
SELECT id, 'Pn' AS name, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)) AS transliteration,
  role AS period, 'g, h' AS genre FROM c
""")
def q_atf_files(spark, sf_dir):
    """Two folders of annotated records, read as one table."""
    conv = table(spark, sf_dir, "conversations")
    genre = [F.struct(F.struct(F.lit(g).alias("genre")).alias("genre")) for g in ("g", "h")]
    atf = F.concat(F.lit("&Pn = x\n#atf: lang sux"), F.col("text"))
    records = conv.select(
        "role", F.concat_ws("-", "conv_id", "turn").alias("id"), F.array(*genre).alias("genres"),
        F.struct(F.col("role").alias("period")).alias("period"), F.struct(atf.alias("atf")).alias("inscription"))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    paths = [folder(spark, "user"), folder(spark, "others")]
    for part, path in zip((user, ~user), paths):
        sinks.lookup_json(records.where(part).drop("role"), path)
    found = parsed(readers.atf_records(spark, paths, lines=True))
    return found.select("id", "name", "transliteration", "period", "genre")


@query("q_record_json", """
WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS v FROM events)
SELECT count(*) FILTER (json_valid(v)) AS good, count(*) FILTER (NOT json_valid(v)) AS bad,
  CAST(sum(CASE WHEN json_valid(v) THEN CAST(json_extract(v, '$.k') AS BIGINT) END) AS BIGINT) AS k FROM e
""")
def q_record_json(spark, sf_dir):
    line = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    path = folder(spark, "records")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows = readers.record_json(spark, path, "k bigint")
    bad = F.col(readers.CORRUPT)
    return rows.agg(F.count_if(bad.isNull()).alias("good"), F.count_if(bad.isNotNull()).alias("bad"),
                    F.sum(F.when(bad.isNull(), F.col("k"))).alias("k"))


@query("q_result_records", """
SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, text AS translation, role AS genre FROM conversations
""")
def q_result_records(spark, sf_dir):
    """Results appended twice, many records per file, read back as one table."""
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("translation"), F.col("role").alias("genre"))
    path = folder(spark, "results")
    for part in (F.col("genre") == "user", F.col("genre") != "user"):
        sinks.result_records(conv.where(part), path)
    return readers.generated_json(spark, path).select("id", "translation", "genre")


# ---- partitioned tables ---------------------------------------------------------------------------
@query("q_write_by_genre", """
SELECT doc_id AS id, text AS transliteration, lang AS period, lang || source AS genre_name FROM documents
""")
def q_write_by_genre(spark, sf_dir):
    df = texts(spark, sf_dir).withColumn("genre", F.concat_ws("/", "period", "genre"))
    path = folder(spark, "genres")
    sinks.by_genre(df, f"{path}/parts", f"{path}/full")
    return spark.read.parquet(f"{path}/parts").select("id", "transliteration", "period", "genre_name")


@query("q_write_by_split", f"""
WITH {SPLIT_SQL} SELECT split.id, split.split, split.period, split.genre FROM split
""")
def q_write_by_split(spark, sf_dir):
    df = texts(spark, sf_dir)
    path = folder(spark, "splits")
    sinks.by_split(stratified_split(df, held_out=F.col("genre") == "src3"), path, "period")
    return readers.split_table(spark, path).select("id", "split", "period", "genre")


@query("q_nested_counts_json", """
SELECT lang AS glyph, source AS reading, count(*) AS n FROM documents GROUP BY ALL
""")
def q_nested_counts_json(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(
        F.col("lang").alias("glyph"), F.col("source").alias("reading")).agg(F.count("*").alias("n"))
    path = folder(spark, "nested")
    sinks.lookup_json(sinks.nested_counts(counts), path)
    read = spark.read.schema("glyph string, readings map<string, bigint>").json(path)
    return read.select("glyph", F.explode("readings").alias("reading", "n"))


@query("q_inventory", """
SELECT DISTINCT 'genre=' || source AS folder FROM documents WHERE source <> 'src7'
""")
def q_inventory(spark, sf_dir):
    """Files on disk that a manifest does not name, by their folder."""
    path = folder(spark, "files")
    texts(spark, sf_dir).select("id", "genre").write.partitionBy("genre").parquet(path)
    files = readers.file_inventory(spark, path)
    name = F.substring_index("path", "/", -2)
    known = files.where(F.contains("path", F.lit("genre=src7/"))).select(name.alias("name"))
    left = joins.missing_files(files, known, path)
    return left.select(F.split("name", "/")[0].alias("folder")).distinct()


@query("q_cached_table", "SELECT doc_id AS id, lang AS period FROM documents")
def q_cached_table(spark, sf_dir):
    """The second call reads what the first one saved, whatever it is given."""
    df = texts(spark, sf_dir).select("id", "period")
    path = folder(spark, "cache")
    sinks.cached(df, path)
    return sinks.cached(df.limit(0), path)


# ---- prediction lines -----------------------------------------------------------------------------
@query("q_line_pairs", f"""
WITH {ENCODED_SQL},
t AS (SELECT id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS p FROM enc),
x AS (SELECT t.id, coalesce(string_agg(token, '' ORDER BY p) FILTER (t.token_id >= 11), '') AS pred,
  coalesce(string_agg(token, '' ORDER BY p) FILTER (t.token_id >= 11 AND (p - 1) % 3 = 0), '') AS label
  FROM t LEFT JOIN vocab USING (token_id) GROUP BY t.id)
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(pred || chr(10) || label, chr(10))) AS line FROM x) GROUP BY line
""")
def q_line_pairs(spark, sf_dir):
    """Labels whose ignored positions (-100) become padding are decoded next to predictions."""
    df = encoded(spark, sf_dir).select("id", "input_ids")
    label = F.transform("input_ids", lambda x, i: F.when(i % 3 == 0, x).otherwise(-100))
    df = df.withColumn("label_ids", label)
    v = vocab(spark, sf_dir)
    df = Q.decode(Q.decode(df, v, "input_ids", "pred"), v, "label_ids", "label")
    path = folder(spark, "lines")
    sinks.line_pairs(df, "pred", "label", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
