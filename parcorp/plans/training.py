"""Split corpus to training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.sequences import encoded_length, special_mask
from parcorp.functions.text import seeded_md5
from parcorp.operators import sequences as Q
from parcorp.operators.sample import oversample
from parcorp.operators.subwords import encode_subwords
from parcorp.session import materialised


def balanced(splits: DataFrame, factor: int = K.OVERSAMPLING, seed: int = 42) -> DataFrame:
    """Oversample the minority genres of the training split; other splits stay.

    Adds `copy_id`, the text's id with the number of the copy, and `shuffle_key`, a seeded
    random key of the copy: sorted by it, the rows are in the prepared data's order.
    """
    once = (F.col("genre") == K.MAJORITY_GENRE) | (F.col("split") != "train")
    out = oversample(splits, once, factor)
    out = out.withColumn("copy_id", F.concat_ws("#", "id", "copy")).drop("copy")
    parts = [c for c in ("chunk", "piece") if c in splits.columns]
    return out.withColumn("shuffle_key", seeded_md5(seed, F.col("copy_id"), *map(F.col, parts)))


def in_order(prepared: DataFrame) -> DataFrame:
    """Prepared rows in their seeded order, sorted by ranges of the key in many tasks."""
    return prepared.orderBy("shuffle_key", "copy_id").drop("shuffle_key")


def glyph_chunks(splits: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, split, chunk, input_ids, special_tokens_mask) for masked-token training.

    Texts are encoded and cut once; the copies of a chunk are made afterwards.
    """
    enc = Q.encode(splits, vocab, "glyphs")
    enc = enc.withColumn("special_tokens_mask", special_mask(F.col("input_ids")))
    cut = Q.chunked(enc, ["input_ids", "special_tokens_mask"], ["id", "split", "genre"])
    return balanced(cut).drop("genre")


def pair_examples(
    splits: DataFrame, glyph_vocab: DataFrame, text_vocab: DataFrame | None = None, limit: int = K.MAX_PAIR_LEN,
    ranks: DataFrame | None = None, text_ends: tuple[int | None, int | None] = (None, None),
) -> tuple[DataFrame, DataFrame]:
    """Encoded pairs within the limit, and the pairs that stayed too long or uneven.

    The source side is encoded by characters; the target side by the characters of
    `text_vocab`, or by the sub-words of `ranks`, between the ids `text_ends`. The limit
    counts the tokens of either side as they are encoded.
    """
    if ranks is None:
        cut = Q.split_long_pairs(splits, "glyphs", "transliteration", ["id", "split", "genre"], limit)
        good = cut.where(F.col("status").isin("ok", "fixed"))
        good = good.withColumn("example", F.concat_ws("#", "id", "piece"))
        enc = Q.encode(good, text_vocab, "transliteration", "labels", "example")
    else:
        cut = _subword_pairs(splits, ranks, limit, text_ends)
        enc = cut.where(F.col("status").isin("ok", "fixed"))
    enc = Q.encode(enc, glyph_vocab, "glyphs", "input_ids", "example")
    kept = balanced(enc).select("id", "piece", "split", "copy_id", "shuffle_key", "input_ids", "labels")
    return kept, cut.where(~F.col("status").isin("ok", "fixed")).drop("labels", "example")


def _subword_pairs(splits: DataFrame, ranks: DataFrame, limit: int, ends: tuple) -> DataFrame:
    """Pairs with `labels` and `status`: whole ones within the limit, the others cut at their
    surfaces and measured again."""
    keep = ["id", "split", "genre"]

    def measured(df: DataFrame) -> DataFrame:
        df = encode_subwords(df, ranks, "transliteration", "labels", "example", *ends)
        return df.withColumn("_fits", Q.fits(encoded_length(F.col("glyphs")), F.size("labels"), limit=limit))

    whole = materialised(measured(splits.select(*keep, "glyphs", "transliteration", F.concat(F.col("id").cast("string"), F.lit("#0")).alias("example"))))
    ok = whole.where("_fits").withColumns({"piece": F.lit(0), "status": F.lit("ok")})
    pieces = Q.split_long_pairs(whole.where("NOT _fits"), "glyphs", "transliteration", keep, limit=0)
    pieces = measured(pieces.withColumn("example", F.concat_ws("#", "id", "piece")))
    status = F.when(F.col("status") == "rejected", "rejected").when(F.col("_fits"), "fixed").otherwise("too_long")
    return ok.drop("_fits").unionByName(pieces.withColumn("status", status).drop("_fits"))
