"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.sequences import ngrams
from parcorp.functions.text import exploded, strip
from parcorp.session import materialised, size_in_bytes

ORDER = 4
PLACE_BYTES = 4 << 20


def masked_accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Share of right predictions over all positions whose label counts."""
    pairs = F.zip_with(pred, label, lambda p, l: F.struct(p.alias("p"), l.alias("l")))
    counted = F.filter(pairs, lambda x: x["l"] != K.IGNORE_LABEL)
    right = F.filter(counted, lambda x: x["p"] == x["l"])
    df = df.select(F.size(counted).cast("bigint").alias("n"), F.size(right).cast("bigint").alias("r"))
    return df.agg(
        F.sum("n").alias("positions"),
        F.round(F.try_divide(F.sum("r"), F.sum("n")), 6).alias("accuracy"),
    )


def mean_length(df: DataFrame, ids: str, pad: int = K.PAD_ID) -> DataFrame:
    n = F.size(F.filter(F.col(ids), lambda x: x != pad))
    return df.agg(F.round(F.avg(n), 4).alias("gen_len"))


# The rules of the 13a tokeniser, in their order
MARKUP_13A = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES_13A = [
    (r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "),  # punctuation stands alone,
    (r"([^0-9])([\.,])", r"\1 \2 "),  # periods and commas unless a digit stands before
    (r"([\.,])([^0-9])", r" \1 \2"),  # or behind them,
    (r"([0-9])(-)", r"\1 \2 "),  # and dashes behind digits
]


def spaced_13a(text: Column) -> Column:
    """The text with white space between its 13a tokens, as published scores count them."""
    for old, new in MARKUP_13A + ENTITIES_13A:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, new in RULES_13A:
        text = F.regexp_replace(text, pattern, new.replace("\\", "$"))
    return text


def ngram_matches(df: DataFrame, pred: str, label: str, row_id: str = "id") -> DataFrame:
    """(n, matches, total, ref_total): clipped n-gram matches over all rows.

    Rows are placed by id first, while their texts are compact. Both sides' n-grams then
    come from one row and go through one aggregate by (row, n-gram) that shuffles nothing.
    A task's n-grams take many times the room of its texts, so the texts decide how many
    tasks there are: each gets about PLACE_BYTES of them.
    """
    df = materialised(df.select(row_id, F.col(pred).alias("_pred"), F.col(label).alias("_label")))
    # (never fewer than the session would make)
    places = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_in_bytes(df) // PLACE_BYTES))

    def side(number: int, column: str) -> Column:
        tokens = F.array_remove(F.split(strip(F.col(column)), r"(?U)\s+"), "")
        return F.struct(F.lit(number).alias("_side"), tokens.alias("_t"))

    sides = df.repartition(places, row_id).select(row_id, F.inline(F.array(side(0, "_pred"), side(1, "_label"))))
    both = exploded(sides, [row_id, "_side"], ngrams(F.col("_t"), ORDER), "_g").select(row_id, "_side", "_g.*")
    per_row = both.groupBy(row_id, "n", "gram").agg(
        F.count_if(F.col("_side") == 0).alias("p"), F.count_if(F.col("_side") == 1).alias("l")
    )
    return per_row.groupBy("n").agg(
        F.sum(F.least("p", "l")).alias("matches"), F.sum("p").alias("total"),
        F.sum("l").alias("ref_total"),
    )


def corpus_bleu(df: DataFrame, pred: str, label: str, row_id: str = "id", tokenise: str = "space") -> DataFrame:
    """Corpus BLEU on white-space tokens, or those of `tokenise` "13a": clipped 1-4-grams,
    brevity penalty, x 100.

    An order without matches is smoothed by halving its precision once more for every
    such order so far; an order without any n-gram, or no match at all, makes the score 0.
    """
    if tokenise == "13a":
        df = df.withColumns({c: spaced_13a(F.col(c)) for c in {pred, label}})
    elif tokenise != "space":
        raise ValueError(f"no tokeniser {tokenise}")
    per_n = ngram_matches(df, pred, label, row_id)
    sums = []
    for n in range(1, ORDER + 1):
        for c in ("matches", "total"):
            sums.append(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}"))
    sums.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("ref_total"))), F.lit(0)).alias("ref_len"))
    row = per_n.agg(*sums)
    logs, zeros, any_empty, found = F.lit(0.0), F.lit(0), F.lit(False), F.lit(0)
    for n in range(1, ORDER + 1):
        matches, total = F.col(f"matches_{n}"), F.col(f"total_{n}")
        zeros = zeros + (matches == 0).cast("int")
        precision = F.when(matches > 0, F.try_divide(matches * 100.0, total)).otherwise(
            F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), zeros) * total)
        )
        logs = logs + F.log(precision)
        any_empty = any_empty | (total == 0)
        found = found + matches
    sys_len, ref_len = F.col("total_1"), F.col("ref_len")
    penalty = F.when(sys_len >= ref_len, 1.0).otherwise(F.exp(1.0 - F.try_divide(ref_len, sys_len)))
    score = F.when(any_empty | (found == 0), 0.0).otherwise(penalty * F.exp(logs / ORDER))
    return row.select(
        F.round(score, 4).alias("bleu"), sys_len.alias("sys_len"), ref_len,
    )
