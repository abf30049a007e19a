"""Vocabulary, encoding, decoding, chunking, padding, masking, splitting of long pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp import constants as K
from parcorp.functions import sequences as S
from parcorp.functions.text import exploded, seeded_md5
from parcorp.operators.ranking import positions
from parcorp.operators.stats import alphabet
from parcorp.session import sized


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, token_id): the special tokens, then all characters by code point.

    The one unpartitioned window runs over distinct characters only, of which Unicode
    has at most 1,114,112.
    """
    spark = df.sparkSession
    specials = spark.createDataFrame(
        list(enumerate(K.VOCAB_SPECIALS)), "token_id bigint, token string"
    ).select("token", "token_id")
    rank = F.row_number().over(W.orderBy("char")) + (len(K.VOCAB_SPECIALS) - 1)
    letters = alphabet(df, text).select(F.col("char").alias("token"), rank.cast("bigint").alias("token_id"))
    return specials.unionByName(letters)


def vocabulary_diff(vocab: DataFrame, letters: DataFrame) -> DataFrame:
    """(kind, token): one-character entries that are no letters, and longer entries."""
    single = vocab.where(F.length("token") == 1)
    unknown = single.join(letters.select(F.col("char").alias("token")), "token", "left_anti")
    longer = vocab.where(F.length("token") != 1)
    return unknown.select(F.lit("not_in_alphabet").alias("kind"), "token").unionByName(
        longer.select(F.lit("multi").alias("kind"), "token")
    )


def token_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, token_id) as text, with a note for tokens that are missing."""
    found = F.col("token_id").cast("string")
    note = F.lit("Token not found in vocabulary")
    return tokens.join(sized(vocab), "token", "left").select(
        "token", F.coalesce(found, note).alias("token_id")
    )


def encode_columns(df: DataFrame, vocab: DataFrame, texts: dict[str, str], row_id: str = "id") -> DataFrame:
    """Add the token ids of several texts (text column -> column of ids): special tokens
    whole, characters one by one.

    A row sends the distinct tokens of all its texts through one vocabulary join, not every
    character, and gets them back as a small map; the characters never leave the row. The
    map is searched from its start, so tokens stand in it as they first appear: the
    frequent ones come early.
    """
    found = F.array_distinct(F.concat(*[
        F.coalesce(S.split_tokens(F.col(t)), F.array().cast("array<string>")) for t in texts]))
    toks = exploded(df, [row_id], found, "token", pos="_pos").withColumnRenamed(row_id, "_id")
    ids = F.coalesce(F.col("token_id").cast("int"), F.lit(K.UNK_ID))
    placed = F.sort_array(F.collect_set(F.struct("_pos", "token", ids.alias("i"))))
    entries = F.array_distinct(F.transform(
        placed, lambda e: F.struct(e["token"].alias("token"), e["i"].alias("i"))
    ))
    maps = (
        toks.join(sized(vocab), "token", "left").groupBy("_id")
        .agg(F.map_from_entries(entries).alias("_ids"))
    )
    joined = df.join(maps, F.col(row_id).eqNullSafe(F.col("_id")), "left")
    for text, out in texts.items():
        inner = F.transform(S.split_tokens(F.col(text)), lambda t: F.try_element_at(F.col("_ids"), t))
        joined = joined.withColumn(out, F.concat(F.array(F.lit(K.BOS_ID)), inner, F.array(F.lit(K.EOS_ID))))
    return joined.drop("_id", "_ids")


def encode(
    df: DataFrame, vocab: DataFrame, text: str, out: str = "input_ids", row_id: str = "id"
) -> DataFrame:
    """Add the token ids of one text."""
    return encode_columns(df, vocab, {text: out}, row_id)


def decode(
    df: DataFrame, vocab: DataFrame, ids: str, out: str = "text", row_id: str = "id",
    skip_special: bool = True,
) -> DataFrame:
    """Add the text of a sequence of token ids (ignored labels count as padding)."""
    seq = S.restored(F.col(ids))
    if skip_special:
        seq = F.filter(seq, lambda i: i >= len(K.VOCAB_SPECIALS))
    toks = exploded(df, [row_id], F.array_distinct(seq), "token_id").withColumnRenamed(row_id, "_id")
    known = vocab.select(F.col("token_id").cast("int").alias("token_id"), "token")
    maps = (
        toks.join(sized(known), "token_id", "left").groupBy("_id")
        .agg(F.map_from_entries(F.collect_set(
            F.struct("token_id", F.coalesce("token", F.lit(K.UNK))))).alias("_toks"))
    )
    joined = df.join(maps, F.col(row_id).eqNullSafe(F.col("_id")), "left")
    text = F.array_join(F.transform(seq, lambda i: F.try_element_at(F.col("_toks"), i)), "")
    return joined.withColumn(out, F.coalesce(text, F.lit(""))).drop("_id", "_toks")


def chunked(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per chunk (`chunk` counts from 0), all columns cut in the same places."""
    parts = F.arrays_zip(*[S.chunks(F.col(c)).alias(c) for c in columns])
    df = exploded(df, keep, parts, "_c", pos="chunk")
    return df.select(*keep, "chunk", *[F.col(f"_c.{c}").alias(c) for c in columns])


def fits(*lengths: Column, limit: int = K.MAX_PAIR_LEN) -> Column:
    """All sequences of an example are within the limit."""
    return F.greatest(*lengths, F.lit(0)) <= limit


def padded_batches(
    df: DataFrame, ids: str, batch_size: int, multiple: int = K.PAD_LEN, seed: int = 42,
    row_id: str = "id", pad: int = K.PAD_ID,
) -> DataFrame:
    """Add `batch` and `padded`: ids filled up to the batch's longest, rounded up.

    Batches have a fixed number of rows, so the window over a batch is bounded.
    """
    keyed = df.withColumn("_key", seeded_md5(seed, F.col(row_id)))
    placed = positions(keyed, "_key", "_pos", tie=[row_id])
    batch = F.floor((F.col("_pos") - 1) / batch_size).cast("bigint")
    longest = F.max(F.size(ids)).over(W.partitionBy("batch"))
    size = (F.ceil(longest / multiple) * multiple).cast("int")
    return (
        placed.withColumn("batch", batch).withColumn("_size", size)
        .withColumn("padded", S.padded(F.col(ids), F.col("_size"), pad))
        .drop("_key", "_pos", "_size")
    )


def split_long_pairs(
    df: DataFrame, left: str, right: str, keep: Sequence[str],
    limit: int = K.MAX_PAIR_LEN, mark: str = "<SURFACE>",
) -> DataFrame:
    """Pairs within the limit as they are, longer ones cut at the surface marks.

    Adds `piece` (0 for uncut pairs) and `status`: ok, fixed, too_long, or rejected when
    the two sides have different numbers of surfaces. Empty surfaces are left out.
    """

    def surfaces(column: str) -> Column:
        cut = F.filter(F.split(F.col(column), mark), lambda s: s != "")
        return F.transform(cut, lambda s: F.concat(F.lit(mark), s))

    ok = fits(S.encoded_length(F.col(left)), S.encoded_length(F.col(right)), limit=limit)
    whole = F.array(F.struct(F.col(left).alias("l"), F.col(right).alias("r")))
    df = df.withColumn("_ok", ok).withColumns({"_l": surfaces(left), "_r": surfaces(right)})
    even = F.size("_l") == F.size("_r")
    pieces = F.when(F.col("_ok") | ~even, whole).otherwise(
        F.zip_with("_l", "_r", lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    )
    first = F.when(F.col("_ok"), "ok").when(~even, "rejected")
    df = exploded(df.withColumn("_s", first), [*keep, "_s"], pieces, "_p", pos="pos")
    df = df.select(*keep, "_s", "pos", F.col("_p.l").alias(left), F.col("_p.r").alias(right))
    again = fits(S.encoded_length(F.col(left)), S.encoded_length(F.col(right)), limit=limit)
    status = F.coalesce("_s", F.when(again, "fixed").otherwise("too_long"))
    piece = F.when(F.col("_s").isNull(), F.col("pos") + 1).otherwise(0)
    return df.select(*keep, piece.alias("piece"), left, right, status.alias("status"))
