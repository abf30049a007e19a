import base64
import random

import tiktoken

from parcorp.operators import subwords

ODD = [None, "", " ", "a", "\n\n", "don't we'll I'm", "  two  spaces \n\n x", "été Ünïcode 漢字かな 🙂🙂", "12 345,678.90!!", "\t\ttab nbsp em",
       "ab" * 300, "<|endoftext|> </s>", "é \u0000 ﻿", "a" * 1200]


def encoding():
    with open(subwords.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = subwords.PATTERN.removeprefix("(?U)")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_library(spark):
    rnd = random.Random(2)
    letters = "aeiounrstlé ß\n.,'-0123漢🙂"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80))) for _ in range(120)]
    texts += ["The quick brown fox jumps over the lazy dog, internationalization of tokenisation."] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    enc = encoding()
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    ranks = subwords.subword_ranks(spark)
    found = subwords.encode_subwords(df, ranks, "text")
    assert {r.id: r.input_ids for r in found.collect()} == want
    back = subwords.decode_subwords(found.drop("text"), ranks, "input_ids")
    assert {r.id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    around = subwords.encode_subwords(df.limit(3), ranks, "text", begin=7, end=8).collect()
    assert all(r.input_ids == [7, *want[r.id], 8] for r in around)


def test_broken_ids_and_empty_tables(spark):
    ranks = subwords.subword_ranks(spark)
    df = spark.createDataFrame([(1, [64, 999_999, 65]), (2, []), (3, None), (4, [ranks.where("token = 'C3'").first().token_id])],
                               "id int, ids array<int>")
    assert {r.id: r.text for r in subwords.decode_subwords(df, ranks, "ids").collect()} == {1: "ab", 2: "", 3: "", 4: "�"}
    none = spark.createDataFrame([], "id int, text string")
    assert subwords.encode_subwords(none, ranks, "text").count() == 0


def test_pairs_with_two_vocabularies(spark):
    from parcorp.operators.sequences import vocabulary
    from parcorp.plans.training import pair_examples

    rows = [(f"p{i}", "train", "g", "ab" * (i + 1), "some words " * (i + 1)) for i in range(4)]
    splits = spark.createDataFrame(rows, "id string, split string, genre string, glyphs string, transliteration string")
    vocab = vocabulary(splits, "glyphs")
    kept, left = pair_examples(splits, vocab, ranks=subwords.subword_ranks(spark), text_ends=(50256, 50256))
    enc = encoding()
    got = {r.id: r.labels for r in kept.collect()}
    assert got == {r[0]: [50256, *enc.encode_ordinary(r[4]), 50256] for r in rows} and left.isEmpty()
    # the gate counts sub-words on the target side
    kept, left = pair_examples(splits, vocab, limit=8, ranks=subwords.subword_ranks(spark), text_ends=(50256, 50256))
    assert {r.id for r in kept.collect()} == {i for i, ids in got.items() if len(ids) <= 8 and 2 * (int(i[1]) + 1) + 2 <= 8}
