"""The given documents hold no editorial markup, so common words are turned into it.

The same literal replacements run in Spark and in SQL, over every text as a whole.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.functions.text import replace_in_order
from parcorp.queries.registry import sql_replace, table

MARKUP = [
    (" the ", " [the] "), (" of ", " ([x x) x] "), (" and ", " <and> "),
    (" to ", " <<to>> "), (" in ", " ⸢in⸣ "), (" is ", " {{is}} "),
    (" that ", " [a(that]) "), (" it ", " {[it}a] "), (" for ", " [a{for]} "),
    (" on ", " <a{on>} "), (" was ", " {<was} "), (" with ", " x "), (" be ", " (n) "),
    (" as ", " $erasure$ "), (" by ", " ... "), (" are ", " (are) "),
    (" this ", "-(this-)a "), (" at ", " |AT.K-A|"), (" de ", "{-de-}-"), (" la ", "; "),
    (" der ", " <der\n"), (" die ", "\ndie> "), (" que ", " [que\n"), (" le ", "\nle] "),
    (" und ", " x x "), (" et ", "-o-"), (" un ", " #SURFACE# "), (" el ", " { x } "),
    (" von ", " {} "), (" les ", " $AN "), (" des ", "\ndes}} "), (" en ", " -- n -"),
    (" an ", " N) [x] "), (" den ", " <den{{x}} "),
]


def marked_up(text: Column) -> Column:
    return replace_in_order(text, MARKUP)


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), marked_up(F.col("text")).alias("transliteration"),
        F.col("lang").alias("period"), F.col("source").alias("genre"),
    )


MARKED_SQL = (
    f"SELECT doc_id AS id, {sql_replace('text', MARKUP)} AS t, lang AS period, source AS genre "
    "FROM documents"
)
