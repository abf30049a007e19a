"""Sub-word encoding with a given byte-level vocabulary, and decoding."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.functions.text import exploded
from parcorp.session import materialised, sized

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary splits texts into words
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def subword_ranks(spark: SparkSession, path: str = RANKS) -> DataFrame:
    """(token, token_id): the bytes of each token in hex digits, and its rank. The file holds
    one token per line in base 64; it is read by the driver, as executors may not have it."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    rows = [(base64.b64decode(token).hex().upper(), int(rank)) for token, rank in pairs]
    return spark.createDataFrame(rows, "token string, token_id int")


def words(text: Column) -> Column:
    """The words in which sub-words are looked for; put together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _merged(pieces: Column, ids: Column, reach: int) -> Column:
    """One step: of all neighbours that a token covers, those of the lowest rank become one
    piece, the leftmost first. Pieces are (start, end) in bytes; `ids` maps start * reach + length."""
    def rank(s: Column, e: Column) -> Column:
        return F.when(e - s < reach, F.try_element_at(ids, s * reach + (e - s)))

    n = F.size(pieces)
    following = F.slice(pieces, 2, F.greatest(n - 1, F.lit(0)))
    offers = F.zip_with(F.slice(pieces, 1, F.greatest(n - 1, F.lit(0))), following, lambda a, b: rank(a["s"], b["e"]))
    ranked = F.filter(F.transform(offers, lambda r, i: F.struct(r.alias("r"), (i + 1).alias("i"))), lambda o: o["r"].isNotNull())

    def joined(best: Column) -> Column:
        one = F.struct(F.element_at(pieces, best["i"])["s"].alias("s"), F.element_at(pieces, best["i"] + 1)["e"].alias("e"))
        return F.concat(F.slice(pieces, 1, best["i"] - 1), F.array(one), F.slice(pieces, best["i"] + 2, n))

    return F.element_at(F.transform(F.array(F.array_min(ranked)), lambda best: F.when(
        best.isNotNull(), joined(best)).otherwise(pieces)), 1)


def word_ids(distinct: DataFrame, ranks: DataFrame) -> DataFrame:
    """(word, ids) of distinct words: from single bytes on, the neighbours whose union has the
    lowest rank are merged, until no neighbours make a token.

    All parts of a word that are tokens are found by one join; the merging is a fold within
    the row, over the few tokens that the word holds. Words of many thousand bytes take
    quadratic time.
    """
    longest = ranks.agg(F.max(F.length("token"))).first()[0] // 2
    reach = longest + 1
    rows = distinct.select("word", F.hex(F.encode("word", "UTF-8")).alias("hex"))
    starts = F.sequence(F.lit(0), (F.length("hex") / 2 - 1).cast("int"))
    at = rows.where("hex <> ''").select("word", "hex", F.explode(starts).alias("s"))
    left = (F.length("hex") / 2 - F.col("s")).cast("int")
    parts = at.select("word", "s", "hex", F.explode(F.sequence(F.lit(1), F.least(left, F.lit(longest)))).alias("n"))
    parts = parts.select("word", (F.col("s") * reach + F.col("n")).alias("k"), F.substring("hex", F.col("s") * 2 + 1, F.col("n") * 2).alias("token"))
    found = parts.join(sized(ranks), "token").groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "token_id"))).alias("ids"),
        F.max(F.floor((F.col("k") - 1) / reach)).cast("int").alias("last"))
    single = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    pieces = F.aggregate(F.sequence(F.lit(0), F.col("last")), single, lambda acc, _: _merged(acc, F.col("ids"), reach))
    out = F.transform(pieces, lambda p: F.try_element_at(F.col("ids"), p["s"] * reach + p["e"] - p["s"]))
    return found.select("word", out.alias("ids"))


def encode_subwords(df: DataFrame, ranks: DataFrame, text: str, out: str = "input_ids", row_id: str = "id",
                    begin: int | None = None, end: int | None = None) -> DataFrame:
    """Add the sub-word ids of a text, between `begin` and `end` where given.

    Ids of rows are unique. Every distinct word is encoded once, however often it occurs; the
    words of the texts fetch their ids through one join, broadcast while the words' measured
    size allows it and otherwise split at frequent words by the skew join. Null texts are
    empty.
    """
    placed = exploded(df, [row_id], words(F.col(text)), "word", pos="_pos").withColumnRenamed(row_id, "_id")
    table = materialised(word_ids(placed.select("word").distinct(), ranks))
    found = placed.join(sized(table), "word").groupBy("_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "ids"))), lambda x: x["ids"])).alias("_ids"))
    ids = F.coalesce("_ids", F.array().cast("array<int>"))
    around = [F.array(F.lit(b)) for b in (begin,) if b is not None], [F.array(F.lit(e)) for e in (end,) if e is not None]
    return df.join(found, F.col(row_id).eqNullSafe(F.col("_id")), "left").withColumn(
        out, F.concat(*around[0], ids, *around[1])).drop("_id", "_ids")


def decode_subwords(df: DataFrame, ranks: DataFrame, ids: str, out: str = "text", row_id: str = "id") -> DataFrame:
    """Add the text of sub-word ids; ids that are no token of the vocabulary are left out, and
    bytes that are no text become the replacement character."""
    toks = exploded(df, [row_id], F.col(ids), "token_id", pos="_pos").withColumnRenamed(row_id, "_id")
    found = toks.join(sized(ranks), "token_id").groupBy("_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "token"))), lambda x: x["token"]), "").alias("_hex"))
    text = F.unhex("_hex").cast("string")
    return df.join(found, F.col(row_id).eqNullSafe(F.col("_id")), "left").withColumn(
        out, F.coalesce(F.make_valid_utf8(text), F.lit(""))).drop("_id", "_hex")
