"""Joins, annotated records, prompts, inventories on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcorp.functions.text import replace_in_order
from parcorp.operators import atf, augment, joins
from parcorp.queries.corpus import SPLIT_SQL, split_texts
from parcorp.queries.registry import q, query, sql_regex, sql_replace, table
from parcorp.queries.sequences import TOKEN_RE
from parcorp.schemas import ATF_RECORDS
from parcorp.sources.readers import parsed_records


# ---- photos and translations -----------------------------------------------------------------
@query("q_photo_join", """
WITH artifacts AS (SELECT CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderkey END AS artifact_id,
  o_orderpriority AS artifact_type FROM orders),
assets AS (SELECT l_orderkey AS artifact_id, l_returnflag AS image_type,
  'dl/photo/P' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '_' || l_linenumber || '.jpg' AS path,
  CASE l_linestatus WHEN 'F' THEN 'jpg' ELSE 'png' END AS file_format FROM lineitem),
photos AS (SELECT artifact_id, artifact_type, image_type, string_split(path, '/')[3] AS image,
  regexp_extract(path, '/([A-Z]\\d+)[_\\.]', 1) AS id FROM artifacts JOIN assets USING (artifact_id) WHERE file_format = 'jpg'),
t AS (SELECT 'P' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS id, text AS glyphs, lang AS period, source AS genre FROM documents)
SELECT id, glyphs, image, image_type, period, genre FROM t JOIN photos USING (id)
""")
def q_photo_join(spark, sf_dir):
    artifacts = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("artifact_id"),
        F.col("o_orderpriority").alias("artifact_type"),
    )
    path = F.concat(F.lit("dl/photo/"), _text_id("l_partkey"), F.lit("_"),
                    F.col("l_linenumber").cast("string"), F.lit(".jpg"))
    assets = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("artifact_id"), F.col("l_returnflag").alias("asset_type"),
        path.alias("path"),
        F.when(F.col("l_linestatus") == "F", "jpg").otherwise("png").alias("file_format"),
    )
    texts = table(spark, sf_dir, "documents").select(
        _text_id("doc_id").alias("id"), F.col("text").alias("glyphs"),
        F.col("lang").alias("period"), F.col("source").alias("genre"),
    )
    return joins.texts_with_photos(texts, joins.photo_index(artifacts, assets))


def _text_id(column):
    return F.concat(F.lit("P"), F.lpad(F.col(column).cast("string"), 6, "0"))


@query("q_path_extract", """
WITH p AS (SELECT page_id, replace(replace(url, '/en/', '/P'), '/fr/', '/S') || '_x.jpg' AS path FROM pages)
SELECT page_id, nullif(regexp_extract(path, '/([A-Z]\\d+)[_\\.]', 1), '') AS id, string_split(path, '/')[-1] AS image FROM p
""")
def q_path_extract(spark, sf_dir):
    path = F.concat(replace_in_order(F.col("url"), [("/en/", "/P"), ("/fr/", "/S")]), F.lit("_x.jpg"))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", joins.photo_id(F.col("path")).alias("id"),
                        joins.file_name(F.col("path")).alias("image"))


LAYOUT = [(" the ", "<SURFACE>"), (" de ", "<RULING>"), (" of ", " <COLUMN> "), (" and ", " <unk> ")]


@query("q_translation_join", f"""
WITH {SPLIT_SQL},
c AS (SELECT conv_id AS id, text AS translation, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT split.id, split.split, split.period, split.genre,
  {sql_replace(sql_replace('d.text', LAYOUT), [(t, '') for t in ('<SURFACE>', '<COLUMN>', '<BLANK_SPACE>', '<RULING>')])} AS transliteration,
  c.translation FROM split JOIN documents d ON d.doc_id = split.id JOIN c ON c.id = split.id AND c.rn = 1
""")
def q_translation_join(spark, sf_dir):
    texts = split_texts(spark, sf_dir).withColumn(
        "transliteration", replace_in_order(F.col("transliteration"), LAYOUT)
    )
    second = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), "turn", F.col("text").alias("translation")
    )
    return joins.texts_with_translations(texts, second, ["turn"])


@query("q_semi_count", """
SELECT count(*) AS n, count(*) FILTER (conv_id IN (SELECT doc_id FROM labels)) AS found FROM conversations
""")
def q_semi_count(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return joins.count_present(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# ---- nested and annotated records --------------------------------------------------------------
@query("q_nested_flatten", """
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'Unknown' WHEN k % 4 = 1 THEN event_type
    ELSE event_type || ', g' || k END AS genre,
  CASE WHEN user_id % 3 = 0 THEN 'Unknown' ELSE 'p' || (user_id % 3) END AS period FROM e
""")
def q_nested_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    genre = F.concat(F.lit('{"genre": {"genre": "'), F.col("event_type"), F.lit('"}}'))
    second = F.concat(F.lit(', {"genre": {"genre": "g'), k.cast("string"), F.lit('"}}'))
    genres = F.when(k % 4 == 0, "").when(k % 4 == 1, genre).otherwise(F.concat(genre, second))
    u = F.col("user_id") % 3
    period = F.when(u == 0, "").otherwise(
        F.concat(F.lit(', "period": {"period": "p'), u.cast("string"), F.lit('"}')))
    record = F.concat(F.lit('{"genres": ['), genres, F.lit("]"), period, F.lit("}"))
    events = table(spark, sf_dir, "events").select("event_id", record.alias("value"))
    rows = parsed_records(events, ATF_RECORDS, keep=["event_id"])
    return rows.select("event_id", atf.genre_list(F.col("genres")).alias("genre"),
                       atf.period_name(F.col("period")).alias("period"))


HEAD = "&P"


@query("q_atf_parse", """
WITH c AS (SELECT conv_id || '-' || turn AS id, '&P' || conv_id || ' = x' || chr(10) ||
    CASE role WHEN 'system' THEN '#atf: lang akk' ELSE '#atf: lang sux' END || chr(10) ||
    CASE role WHEN 'assistant' THEN '#tr.en: ' ELSE '  ' END || replace(text, '. ', '.' || chr(10) || '#tr.en:  ') AS a,
  conv_id FROM conversations),
l AS (SELECT id, conv_id, string_split(string_split(a, '#atf: lang sux')[2], chr(10)) AS ls FROM c WHERE contains(a, '#atf: lang sux'))
SELECT id, 'P' || conv_id AS name,
  array_to_string(list_transform(list_filter(ls, lambda x: NOT starts_with(x, '#tr.en: ')), lambda x: trim(x)), chr(10)) AS transliteration,
  array_to_string(list_transform(list_filter(ls, lambda x: starts_with(x, '#tr.en: ')), lambda x: trim(substr(x, 9))), chr(10)) AS translation
FROM l
""")
def q_atf_parse(spark, sf_dir):
    mark = F.when(F.col("role") == "system", "#atf: lang akk").otherwise("#atf: lang sux")
    body = F.replace("text", F.lit(". "), F.lit(".\n#tr.en:  "))
    text = F.concat(
        F.lit("&P"), F.col("conv_id").cast("string"), F.lit(" = x\n"), mark, F.lit("\n"),
        F.when(F.col("role") == "assistant", "#tr.en: ").otherwise("  "), body,
    )
    conv = table(spark, sf_dir, "conversations")
    records = conv.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.struct(text.alias("atf")).alias("inscription"),
        F.lit(None).cast("struct<period:string>").alias("period"),
        F.lit(None).cast("array<struct<genre:struct<genre:string>>>").alias("genres"),
    )
    return atf.parsed(records).select("id", "name", "transliteration", "translation")


@query("q_ingest_bad_records", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS v FROM events)
SELECT event_id, json_valid(v) AS ok, CASE WHEN json_valid(v) THEN CAST(json_extract(v, '$.k') AS BIGINT) END AS k,
  CASE WHEN NOT json_valid(v) THEN v END AS bad FROM e
""")
def q_ingest_bad_records(spark, sf_dir):
    cut = F.when(
        F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")
    ).otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select("event_id", cut.alias("value"))
    rows = parsed_records(lines, "k bigint", keep=["event_id"])
    bad = F.col("_corrupt")
    return rows.select("event_id", bad.isNull().alias("ok"), F.when(bad.isNull(), F.col("k")).alias("k"),
                       bad.alias("bad"))


# ---- augmentation and inventories ---------------------------------------------------------------
HEADER = "Translate the following lines into English.\n\n"
PROMPT = [(" the ", " <unk> "), (" de ", "<SURFACE>\n\n\n"), (" of ", " ...  "), (" la ", "<RULING> ")]
PROMPT_TEXT_SQL = (
    "regexp_replace("
    + sql_regex(
        sql_regex(
            sql_replace("text", PROMPT + [(t, "") for t in ("<SURFACE>", "<COLUMN>", "<RULING>", "<BLANK_SPACE>")]
                        + [("<unk>", "...")]),
            "\\n+", "\n"),
        " *\\.\\.\\. *", "...")
    + ", '^\\s+|\\s+$', '', 'g')"
)
TOKEN_COUNT = f"len(regexp_extract_all(t, {q(TOKEN_RE)})) + 2"


@query("q_prompt_text", f"""
WITH c AS (SELECT conv_id || '-' || turn AS id, {PROMPT_TEXT_SQL} AS t FROM conversations)
SELECT id, t AS transliteration, CAST({TOKEN_COUNT} AS BIGINT) AS n_tokens,
  CASE WHEN {TOKEN_COUNT} > 256 THEN '' ELSE '{HEADER}INPUT:\n' || t || '\n\nOUTPUT:\n' END AS prompt FROM c
""")
def q_prompt_text(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        replace_in_order(F.col("text"), PROMPT).alias("transliteration"),
    )
    return augment.prompts(conv, HEADER)


@query("q_resume_anti", """
SELECT doc_id AS id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q_resume_anti(spark, sf_dir):
    work = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return joins.still_to_do(work, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("q_running_usage", """
WITH u AS (SELECT conv_id || '-' || turn AS id, CASE WHEN length(text) + 2 > 256 THEN 0 ELSE length(text) END AS usage FROM conversations)
SELECT id, usage, CAST(sum(usage) OVER (ORDER BY md5('2|' || id), id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM u
""")
def q_running_usage(spark, sf_dir):
    n = F.length("text").cast("bigint")
    df = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(n + 2 > 256, 0).otherwise(n).alias("usage")
    )
    return augment.running_usage(df, "usage")


@query("q_collect_generated", """
WITH g AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'q' || toxic ELSE '' END AS translation FROM labels)
SELECT d.doc_id AS id, d.lang AS period, d.source AS genre, g.translation FROM documents d JOIN g ON d.doc_id = g.id WHERE g.translation <> ''
""")
def q_collect_generated(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("toxic").cast("string"))).alias("translation"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("period"), F.col("source").alias("genre")
    )
    return docs.join(augment.non_empty_translations(results), "id")


@query("q_manifest_anti", """
SELECT '/data/photos/' || source || '/doc_' || doc_id || '.jpg' AS path, source || '/doc_' || doc_id || '.jpg' AS name
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q_manifest_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    local = docs.select(F.concat(F.lit("/data/photos/"), name).alias("path"))
    present = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(name.alias("name"))
    return joins.missing_files(local, present, "/data/photos").select("path", "name")


@query("q_partition_manifest", """
SELECT replace(lang || '/' || source, '/', '') AS genre_name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents GROUP BY 1
""")
def q_partition_manifest(spark, sf_dir):
    from parcorp.sources.sinks import partition_name

    docs = table(spark, sf_dir, "documents")
    named = docs.withColumn("genre_name", partition_name(F.concat_ws("/", "lang", "source")))
    return named.groupBy("genre_name").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
