"""Spelling variants: words one edit apart, found by sorted rotations (permuterm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.llm.common import written
from parcorp.llm.exact_dedup import normalised
from parcorp.operators.ranking import ranked_over_tasks

GAP = "[^a-zÀ-ÿ]++"  # between words, after A-Z became lower case
END = "$"  # marks the end of a word; no letter
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2  # a form is at least so many times as frequent
NOISE = 97
WRITTEN_OUT = 64  # code points up to which rotations are written out


def occurrences(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                noise: int = NOISE) -> DataFrame:
    """(word) for every run of letters of every whole text, A-Z lower-cased. Runs whose
    checksum with the id is divisible by `noise` lose one letter. Shorter runs are left out."""
    run = F.col("run")
    rows = docs.select(F.coalesce(F.col(row_id).cast("string"), F.lit("")).alias("id"), F.explode(
        F.split(normalised(F.col(text)), GAP, -1)).alias("run"))
    rows = rows.where(F.char_length(run) >= min_length).withColumn(
        "h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(run)
    return rows.select(word.alias("word"))


def word_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): words of enough letters and occurrences; every task first counts its own."""
    found = occurrences(docs, row_id, text, min_length, noise).groupBy("word").agg(F.count("*").alias("n"))
    # one condition, so that the length is tested once per word and not pushed below the checksums
    return found.where(F.when(F.char_length("word") >= min_length, F.col("n") >= min_count).otherwise(False))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, rank, n, kind) of all rotations of `word$` for (rank, word, n).

    A rotation that ends in letter i of its word reads `word[i+1:] $ word[:i]`, and then that
    letter. `prefix` is what stands before it (kind `edit`, or `again` where the letter
    equals the one before, so that dropping either gives the same word). Kind `whole` has
    the rotation up to its end: the prefix of the rotations of words with one more letter.

    Prefixes of words longer than WRITTEN_OUT stand as their SHA-256 and the word's length,
    so that a word of n letters makes n short rows.
    """
    n = F.char_length("word")

    def piece(start: Column, size: Column) -> Column:
        return F.substring(F.col("word"), start, size)

    def letter(i: Column) -> Column:
        return F.substring(F.col("word"), i + 1, F.lit(1))

    def keyed(prefix: Column, length: Column) -> Column:
        digest = F.concat(F.lit(END + END), F.sha2(prefix, 256), length.cast("string"))
        return F.when(length <= WRITTEN_OUT, prefix).otherwise(digest)

    i = F.col("i")
    before = piece(F.lit(1), i)
    rows = words.select("rank", "n", "word", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    again = (i > 0) & (letter(i) == letter(i - 1))
    edit = F.struct(keyed(F.concat(piece(i + 2, n), F.lit(END), before), n - 1).alias("prefix"),
                    F.when(again, F.lit("again")).otherwise(F.lit("edit")).alias("kind"))
    whole = F.struct(keyed(F.concat(piece(i + 1, n), F.lit(END), before), n).alias("prefix"),
                     F.lit("whole").alias("kind"))
    both = F.when(i < n, F.array(edit, whole)).otherwise(F.array(whole))
    return rows.select("rank", "n", F.explode(both).alias("r")).select("r.prefix", "rank", "n", "r.kind")


def neighbours(words: DataFrame) -> DataFrame:
    """(rank, n_near, near) per word with a near word: their number and the best of them.

    The rotations are dealt to tasks by their prefixes and sorted there, and every run of
    equal prefixes is scanned.
    Its words of kind `edit` and `again` are one replacement apart, and one letter more than
    the word of kind `whole`, if there is one. A run holds one word per letter of the
    alphabet and one whole word at most, 91, whatever the data. Every word sends its count
    and the best other word of the run, not its pairs: the smallest rank, as ranks follow
    the wanted order. A pair that differs by one of several equal letters is counted at the
    first of them only.
    """
    run = W.partitionBy("prefix")
    best = run.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    me = F.struct("rank", "n")
    edited = F.count(F.when(F.col("kind") != "whole", 1)).over(run)
    canonical = F.count(F.when(F.col("kind") == "edit", 1)).over(run)
    wholes = F.count(F.when(F.col("kind") == "whole", 1)).over(run)
    first, second = F.first(me).over(best), F.nth_value(me, 2).over(best)
    found = rotations(words).select(
        "rank",
        F.when(F.col("kind") == "whole", canonical).otherwise(
            edited - 1 + F.when(F.col("kind") == "edit", wholes).otherwise(0)).alias("c"),
        F.when(first["rank"] == F.col("rank"), second).otherwise(first).alias("other"))
    found = found.where(F.col("other").isNotNull())
    return found.groupBy("rank").agg(F.sum("c").alias("n_near"), F.min("other").alias("near"))


def roots(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(rank, root) of (rank, form): the last word of the chain that starts at each.

    Every round doubles the steps taken. A form is at least twice as frequent as its word,
    so chains have fewer than 63 steps and at most seven rounds change anything.
    """
    at = written(forms.select("rank", F.col("form").alias("root")), "spelling-chain")
    for _ in range(max_rounds):
        ahead = at.select(F.col("rank").alias("k"), F.col("root").alias("next"))
        step = at.join(ahead, F.col("root") == F.col("k"), "left").select(
            "rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on"))
        step = written(step, "spelling-chain")
        if step.where("on").isEmpty():
            return at
        at = step.drop("on")
    raise RuntimeError("chains of forms did not end")


def variants(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.
    A word's form is its most frequent near word (ties: the smallest in code-point order) if
    that is `ratio` times as frequent; its root is the last word reached from form to form.
    Null texts have no words; a null id counts as an empty one; rows that repeat an id are
    counted as often. Long words are words like any other. No words, no rows.
    """
    counts = written(word_counts(docs, row_id, text, min_length, min_count, noise), "spelling-counts")
    # UTF-8 sorts by code point, so ranks follow frequency, then code-point order
    words = written(ranked_over_tasks(counts, [F.desc("n"), "word"], "rank"), "spelling-words")
    near = neighbours(words).withColumn("rank_", F.col("rank")).drop("rank")
    stats = words.join(near, F.col("rank") == F.col("rank_"), "left").select(
        "word", "rank", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("near.n") >= F.col("n") * ratio, F.col("near")).alias("near"))
    stats = written(stats, "spelling-near")
    chain = roots(stats.where("near IS NOT NULL").select("rank", F.col("near.rank").alias("form")))

    def named(name: str) -> DataFrame:
        return words.select(F.col("rank").alias(f"{name}_rank"), F.col("word").alias(name))

    follows = chain.select(F.col("rank").alias("at"), F.col("root").alias("to"))
    rows = stats.join(follows, F.col("rank") == F.col("at"), "left")
    rows = rows.join(named("form"), F.col("near.rank") == F.col("form_rank"), "left")
    rows = rows.join(named("root"), F.col("to") == F.col("root_rank"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                       F.col("near.n").alias("form_n"))
