"""Cleaning stages on the marked-up documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions import cleaning as C
from parcorp.operators.overrides import apply_overrides
from parcorp.queries.markup import MARKED_SQL, marked_documents
from parcorp.queries.registry import (
    QUERIES, ORACLES, q, query, sql_regex, sql_replace, sql_rewrite, sql_steps, table,
)

M = K.MISSING

# ---- the SQL side of each stage, as steps over column t -----------------------------------
# The patterns that define the stages, in their order
COLLAPSE_SQL = [
    sql_regex("t", r"([ \-]*\n[ \-]*)+", "\n"),
    sql_regex("t", r"(-* -*)+", " "),
    sql_regex("t", r"-+", "-"),
    sql_regex("t", rf"([ \-]*{M}[ \-]*)+", M),
    # no look-ahead in RE2: take the newline after the run along
    sql_regex("t", rf"(\n{M})+\n", f"\n{M}\n"),
]
REPAIR_PATTERNS_SQL = [
    (r"\(\[[\- x]*?\)[\- x]*?\]", "([", "[("),
    (r"\[[^\n(\]]*?\([^\n)\]]*?\]\)", "])", ")]"),
    (r"\{\[[^\n}\]]*?\}[^\n\]]*?\]", "{[", "[{"),
    (r"\[[^\n{\]]*?\{[^\n\]]*?\]\}", "]}", "}]"),
    (r"<[^\n{>]*?\{[^\n}>]*?>\}", ">}", "}>"),
    (r"\{<[^\n}>]*?\}", "{<", "<{"),
]
REPAIR_SQL = [
    sql_rewrite("t", p, f"replace(acc, m, replace(m, {q(a)}, {q(b)}))")
    for p, a, b in REPAIR_PATTERNS_SQL
]
GLOSS_SQL = [
    sql_rewrite("t", r"\{\{[^\n]*?\}\}", "replace(acc, m, '')"),
    sql_rewrite("t", r"\n[^\n]*?\}\}", "replace(acc, m, chr(10))"),
]
ANGLE_SQL = [
    sql_regex("t", r"<[^\n]*?>", ""),
    sql_regex("t", r"<[^\n>]*?(\n|$)", M + "\n"),
    sql_regex("t", r"(\n|^)[^\n<]*?>", "\n" + M),
]
BARS_SQL = [
    # one fold per distinct sign, in order of first appearance
    "list_reduce(list_prepend(t, list_filter(regexp_extract_all(t, '\\|[^|a-z]*?\\|'), "
    "lambda m, i: list_position(regexp_extract_all(t, '\\|[^|a-z]*?\\|'), m) = i)), "
    "lambda acc, m: replace(acc, replace(m, '-', ''), replace(m, '-', '') || '-'))"
]
PARENS_SQL = [
    sql_regex("t", r"-+\)", ")-"), sql_regex("t", r"\)([a-zA-Z])", r")-\1"),
    sql_replace("t", [("(-", "(")]),
]
SQUARE_SQL = [
    sql_regex("t", r"\[[^\[\]\n]*?\]", M), sql_regex("t", r"\[[^\[\]\n]*?\]", M),
    sql_regex("t", r"\[[^\[\]\n]*?\n", M + "\n"), sql_regex("t", r"\n[^\[\]\n]*?\]", "\n" + M),
]
# Without look-ahead a match eats the separator that the next one needs; a second pass
# finds those.
XON_SQL = [
    sql_regex("t", r"([ \-\n])[xXnNo]([ \-\n]|$)", rf"\1{M}\2"),
    sql_regex("t", r"([ \-\n])[xXnNo]([ \-\n]|$)", rf"\1{M}\2"),
    sql_replace("t", C.illegible_pairs()),
]
STANDALONE_SQL = [
    sql_rewrite("t", r"(?:^|\n| |-)(\([^\n\)]+\))(?:$|\n| |-)", "replace(acc, m, '')", 1)
]
MISSING_SQL = [
    sql_regex("t", rf"\([ \-]*{M}[ \-]*\)", M), sql_regex("t", rf"\{{[ \-]*{M}[ \-]*\}}", M),
    sql_replace("t", [("{}", ""), ("()", "")]),
]
EASY_SQL = [sql_replace("t", [("<<", ""), (">>", ""), ("⸢", ""), ("⸣", "")])]
CURLY_SQL = [sql_replace("t", [(";", "\n"), ("{-", "{"), ("-}", "}")])]
DOLLAR_SQL = [sql_replace("t", [(n, M) for n in K.DAMAGE_NOTES] + [("...", M)])]
SPECIAL_SQL = [sql_replace("t", K.MARKER_TO_TOKEN)]

PART_EASY = EASY_SQL + GLOSS_SQL + COLLAPSE_SQL
PART_ENCLOSURE = REPAIR_SQL + ANGLE_SQL + CURLY_SQL + BARS_SQL + PARENS_SQL + COLLAPSE_SQL
PART_MISSING = SQUARE_SQL + XON_SQL * 3 + DOLLAR_SQL + STANDALONE_SQL + COLLAPSE_SQL
PART_FINAL = MISSING_SQL + COLLAPSE_SQL
FULL_SQL = PART_EASY + PART_ENCLOSURE + PART_MISSING + PART_FINAL + SPECIAL_SQL
CONTENT_SQL = sql_replace("t", [(t, "") for t in K.CLEAN_TOKENS]) + " <> ''"
OUT = "SELECT id, t AS text FROM {s}"


def _stage_query(name, stages, steps):
    """Register the marked-up documents after the given rewrites."""

    def run(spark, sf_dir):
        df = marked_documents(spark, sf_dir).select("id", F.col("transliteration").alias("text"))
        return C.run_stages(df, "text", stages)

    QUERIES[name] = run
    ORACLES[name] = sql_steps(MARKED_SQL, steps, OUT)


HYPHENS = C.COLLAPSE[2]
XON = [C.ILLEGIBLE_ALONE, C.ILLEGIBLE_IN_CONTEXT]
_stage_query(
    "q_clean_easy",
    [C.DOUBLE_ANGLE_BRACKETS, C.UPPER_BRACKETS, C.SEMICOLONS, C.CURLY_BRACES],
    EASY_SQL + CURLY_SQL,
)
_stage_query("q_clean_gloss", [C.GLOSSES_IN_LINE, C.GLOSSES_FROM_LINE_START], GLOSS_SQL)
_stage_query("q_collapse", [C.ELLIPSES, C.ILLEGIBLE_ALONE, *C.COLLAPSE],
             [sql_replace("t", [("...", M)])] + XON_SQL[:2] + COLLAPSE_SQL)
_stage_query("q_enclosure", C.ENCLOSURES, REPAIR_SQL)
_stage_query("q_clean_angle", C.ANGLE_BRACKETS, ANGLE_SQL)
_stage_query("q_clean_bars", [C.VERTICAL_BARS, HYPHENS],
             BARS_SQL + [sql_regex("t", "-+", "-")])
_stage_query("q_clean_parens", [*C.PARENTHESES, C.STANDALONE_PARENS], PARENS_SQL + STANDALONE_SQL)
_stage_query("q_clean_square", C.SQUARE_BRACKETS, SQUARE_SQL)
_stage_query("q_clean_xon", XON * 3, XON_SQL * 3)
_stage_query("q_clean_dollar", [C.DAMAGE_NOTES, C.ELLIPSES], DOLLAR_SQL)
_stage_query(
    "q_clean_missing",
    [C.ILLEGIBLE_ALONE, *C.MISSING_IN_ENCLOSURE, C.EMPTY_ENCLOSURES],
    XON_SQL[:2] + MISSING_SQL,
)
_stage_query("q_special_tokens", [C.ELLIPSES, C.SPECIAL_TOKENS],
             [sql_replace("t", [("...", M)])] + SPECIAL_SQL)


@query("q_clean_full", sql_steps(
    MARKED_SQL, FULL_SQL, f"SELECT id, t AS text FROM {{s}} WHERE {CONTENT_SQL}"
))
def q_clean_full(spark, sf_dir):
    out = C.clean(marked_documents(spark, sf_dir), drop_empty=True)
    return out.select("id", F.col("transliteration_clean").alias("text"))


def _violations_sql() -> str:
    parts = [("easy", "easy", PART_EASY), ("enclosure", "enclosure", PART_ENCLOSURE),
             ("missing", "missing", PART_MISSING), ("final", "final", PART_FINAL)]
    ctes, n, selects = [f"s0 AS MATERIALIZED ({MARKED_SQL})"], 0, []
    for check, key, steps in parts:
        for step in steps:
            ctes.append(f"s{n + 1} AS MATERIALIZED (SELECT id, {step} AS t FROM s{n})")
            n += 1
        markers = ", ".join(q(m) for m in K.DISALLOWED[key])
        selects.append(
            f"SELECT id, '{check}' AS check_point, marker FROM "
            f"(SELECT id, t, unnest([{markers}]) AS marker FROM s{n}) WHERE contains(t, marker)"
        )
        ctes[0] = f"s0 AS MATERIALIZED (SELECT id, t FROM ({MARKED_SQL}))"
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


@query("q_sanity_violations", _violations_sql())
def q_sanity_violations(spark, sf_dir):
    out = C.clean(marked_documents(spark, sf_dir), report="violations")
    return out.select("id", F.explode("violations").alias("v")).select(
        "id", F.col("v.check").alias("check_point"), F.col("v.marker").alias("marker")
    )


@query("q_unmatched", f"""
WITH d AS ({MARKED_SQL}),
parts AS (SELECT id, string_split(t, chr(10)) AS ls FROM d),
lines AS (SELECT id, unnest(range(1, len(ls) + 1)) AS line_no, ls FROM parts),
marks AS (SELECT id, line_no, regexp_extract_all(ls[line_no], '[\\[\\]]') AS b FROM lines),
steps AS (
  SELECT id, line_no, i, sum(CASE WHEN b[i] = '[' THEN 1 ELSE -1 END)
    OVER (PARTITION BY id, line_no ORDER BY i) AS depth, len(b) AS n
  FROM (SELECT id, line_no, b, unnest(range(1, len(b) + 1)) AS i FROM marks)),
ends AS (
  SELECT id, line_no, greatest(-min(depth), 0) AS closes,
    max(CASE WHEN i = n THEN depth END) + greatest(-min(depth), 0) AS opens
  FROM steps GROUP BY id, line_no)
SELECT id, CAST(line_no AS BIGINT) AS line_no,
  repeat(']', CAST(closes AS INTEGER)) || repeat('[', CAST(opens AS INTEGER)) AS unpaired
FROM ends WHERE closes + opens > 0
""")
def q_unmatched(spark, sf_dir):
    lines = marked_documents(spark, sf_dir).select(
        "id", F.posexplode(F.split("transliteration", "\n")).alias("pos", "line")
    )
    return lines.select(
        "id", (F.col("pos") + 1).cast("bigint").alias("line_no"),
        C.unmatched_brackets(F.col("line")).alias("unpaired"),
    ).where("unpaired <> ''")


@query("q_row_overrides", f"""
WITH d AS ({MARKED_SQL}),
o AS (SELECT item_id, string_split(text, ' ')[2] AS find FROM benchmark)
SELECT d.id, CASE WHEN o.find IS NULL THEN d.t ELSE replace(d.t, o.find, '{M}') END AS text
FROM d LEFT JOIN o ON d.id = o.item_id
""")
def q_row_overrides(spark, sf_dir):
    overrides = table(spark, sf_dir, "benchmark").select(
        F.lit("illegible").alias("step"), F.col("item_id").alias("id"),
        F.get(F.split("text", " "), F.lit(1)).alias("find"), F.lit(M).alias("repl"),
    )
    docs = marked_documents(spark, sf_dir)
    return apply_overrides(docs, overrides, "illegible", "transliteration").select(
        "id", F.col("transliteration").alias("text")
    )


@query("q_nonempty_content", f"""
WITH d AS (SELECT doc_id AS id, CASE source WHEN 'src3' THEN '...' || chr(10) || '<SURFACE>'
  WHEN 'src5' THEN '... ...' WHEN 'src7' THEN '<RULING>' || text ELSE text END AS t
  FROM documents)
SELECT id, t AS text FROM d WHERE {CONTENT_SQL}
""")
def q_nonempty_content(spark, sf_dir):
    text = (
        F.when(F.col("source") == "src3", F.lit("...\n<SURFACE>"))
        .when(F.col("source") == "src5", F.lit("... ..."))
        .when(F.col("source") == "src7", F.concat(F.lit("<RULING>"), F.col("text")))
        .otherwise(F.col("text"))
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))
    return docs.where(C.has_content(F.col("text")))
