"""Array expressions on token-id sequences."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import hex_fraction, seeded_md5

# a special token, or any one character
# (the first alternative takes every character that cannot start a special token)
TOKEN = r"(?s)[^<.\n]|" + "|".join(re.escape(t) for t in K.VOCAB_SPECIALS) + "|."


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def encoded_length(text: Column) -> Column:
    """Length of the encoded text, begin and end tokens included."""
    return F.size(split_tokens(text)) + 2


def special_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i < len(K.VOCAB_SPECIALS)).cast("int"))


def chunks(ids: Column, size: int = K.CHUNK_LEN, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """The whole sequence, its head and tail, or overlapping windows and its tail.

    The tail may repeat the last window; it is kept.
    """
    n = F.size(ids)
    tail = F.slice(ids, n - size + 1, F.lit(size))
    starts = F.sequence(F.lit(0), n - size, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.slice(ids, s + 1, F.lit(size)))
    return (
        F.when(n <= size, F.array(ids))
        .when(n <= 2 * size, F.array(F.slice(ids, 1, size), tail))
        .otherwise(F.concat(windows, F.array(tail)))
    )


def padded(ids: Column, size: Column, pad: int = K.PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))))


def padded_or_cut(ids: Column, size: int = K.PAD_LEN, pad: int = K.PAD_ID) -> Column:
    return F.slice(padded(ids, F.lit(size), pad), 1, size)


def restored(labels: Column, pad: int = K.PAD_ID) -> Column:
    """Ignored label positions back to the pad token."""
    return F.transform(labels, lambda x: F.when(x == K.IGNORE_LABEL, pad).otherwise(x))


def masked(ids: Column, row_id: Column, vocab_size: Column, prob: float, seed: int) -> Column:
    """(id, label) pairs for masked-token training, reproducible from seed, id, position.

    A chosen non-special token becomes the mask in 80 % of the cases, any vocabulary
    entry in 10 %, and stays in 10 %. Labels keep the chosen tokens, -100 elsewhere. One
    digest decides for four positions, and only chosen ones get a digest of their own.
    """
    limit = F.lit(f"{math.ceil(prob * 16**8):08x}")
    four = F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / 4).cast("int"))
    # a step of its own, so that each digest is computed once
    parts = F.transform(four, lambda g: F.struct(
        g.alias("g"), seeded_md5(seed, row_id, g).alias("digest"), F.slice(ids, g * 4 + 1, F.lit(4)).alias("ids")))

    def draw(part: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            chosen = (i >= len(K.VOCAB_SPECIALS)) & (F.substr(part["digest"], k * 8 + 1, F.lit(8)) < limit)
            own = F.when(chosen, seeded_md5(seed, row_id, part["g"] * 4 + k, F.lit("new")))
            return F.struct(i.alias("i"), own.alias("digest"))

        return F.transform(part["ids"], one)

    def replace(x: Column) -> Column:
        kind = hex_fraction(x["digest"], 1)
        random_id = F.floor(hex_fraction(x["digest"], 9) * vocab_size).cast("int")
        new = F.when(kind < 0.8, K.MASK_ID).when(kind < 0.9, random_id).otherwise(x["i"])
        return F.when(
            x["digest"].isNull(),
            F.struct(x["i"].alias("id"), F.lit(K.IGNORE_LABEL).alias("label")),
        ).otherwise(F.struct(new.alias("id"), x["i"].alias("label")))

    drawn = F.when(F.size(ids) > 0, F.flatten(F.transform(parts, draw))).otherwise(
        F.array().cast("array<struct<i:int,digest:string>>"))
    return F.transform(drawn, replace)


def argmax(scores: Column) -> Column:
    """Zero-based place of the first maximum."""
    return F.array_position(scores, F.array_max(scores)) - 1


def ngrams(tokens: Column, order: int) -> Column:
    """(n, gram) for all n-grams up to the given order."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        grams = F.transform(starts, lambda s: F.struct(
            F.lit(n).alias("n"), F.array_join(F.slice(tokens, s, F.lit(n)), " ").alias("gram")))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.filter(
            F.array(F.struct(F.lit(n).alias("n"), F.lit("").alias("gram"))), lambda _: F.lit(False)))

    return F.flatten(F.array(*[of(n) for n in range(1, order + 1)]))
