import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions import sequences as S
from parcorp.operators import atf, augment, metrics
from parcorp.operators import sequences as Q

TEXTS = [("a", "𒀭𒆠<SURFACE>𒀭...\n"), ("b", "<unk>𒆠"), ("c", ""), ("d", "𒀭zé")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id string, t string")


@pytest.fixture(scope="module")
def vocab(spark):
    return Q.vocabulary(spark.createDataFrame([("𒀭𒆠x<SURFACE>",), ("𒀭y...",)], "t string"), "t")


def test_vocabulary(spark, vocab):
    got = {r.token: r.token_id for r in vocab.collect()}
    letters = sorted("𒀭𒆠xy")
    assert got == {**{t: i for i, t in enumerate(K.VOCAB_SPECIALS)}, **{c: 11 + i for i, c in enumerate(letters)}}
    toks = spark.createDataFrame([("x",), ("nope",)], "token string")
    assert {tuple(r) for r in Q.token_ids(toks, vocab).collect()} == {
        ("x", "11"), ("nope", "Token not found in vocabulary")}


def test_encode_and_decode(texts, vocab):
    enc = Q.encode(texts, vocab, "t").cache()
    ids = {r.id: r.input_ids for r in enc.collect()}
    an, ki = 13, 14
    assert ids == {"a": [0, an, ki, 6, an, 10, 5, 2], "b": [0, 3, ki, 2], "c": [0, 2], "d": [0, an, 3, 3, 2]}
    masks = {r.id: r.m for r in enc.select("id", S.special_mask(F.col("input_ids")).alias("m")).collect()}
    assert masks["a"] == [1, 0, 0, 1, 0, 1, 1, 1]
    back = {r.id: r.text for r in Q.decode(enc, vocab, "input_ids").collect()}
    assert back == {"a": "𒀭𒆠𒀭", "b": "𒆠", "c": "", "d": "𒀭"}
    whole = {r.id: r.text for r in Q.decode(enc, vocab, "input_ids", skip_special=False).collect()}
    assert whole["a"] == "<s>𒀭𒆠<SURFACE>𒀭...\n</s>"


def test_encode_keeps_repeated_ids(texts, vocab):
    twice = texts.unionByName(texts)
    assert Q.encode(twice, vocab, "t").count() == 8


def reference_chunks(ids, size=64, step=54):
    if len(ids) <= size:
        return [ids]
    if len(ids) <= 2 * size:
        return [ids[:size], ids[-size:]]
    return [ids[i:i + size] for i in range(0, len(ids) - size + 1, step)] + [ids[-size:]]


def test_chunks(spark):
    lengths = [1, 64, 65, 128, 129, 172, 300]
    df = spark.createDataFrame([(n, list(range(n))) for n in lengths], "n int, ids array<int>")
    out = Q.chunked(df, ["ids"], ["n"]).collect()
    for n in lengths:
        got = [r.ids for r in sorted(out, key=lambda r: r.chunk) if r.n == n]
        assert got == reference_chunks(list(range(n)))
    assert [len(reference_chunks(list(range(n)))) for n in lengths[1:6]] == [1, 2, 2, 3, 4]


def test_padding(spark):
    df = spark.createDataFrame([("a", [7, 8, 9]), ("b", list(range(200))), ("c", [1])], "id string, ids array<int>")
    got = {r.id: r.x for r in df.select("id", S.padded_or_cut(F.col("ids"), 5).alias("x")).collect()}
    assert got["a"] == [7, 8, 9, 1, 1] and got["b"] == [0, 1, 2, 3, 4]
    out = Q.padded_batches(df, "ids", 2, multiple=128).collect()
    sizes = {r.id: len(r.padded) for r in out}
    batches = {r.id: r.batch for r in out}
    assert sorted(Counter(batches.values()).values()) == [1, 2]
    for r in out:
        longest = max(len(x.ids) for x in out if x.batch == r.batch)
        assert sizes[r.id] == math.ceil(longest / 128) * 128
        assert r.padded[:len(r.ids)] == r.ids and set(r.padded[len(r.ids):]) <= {1}


def test_masking(spark):
    df = spark.createDataFrame([(str(i), [0] + list(range(11, 61)) + [2]) for i in range(200)], "id string, ids array<int>")
    pairs = df.select("id", "ids", S.masked(F.col("ids"), F.col("id"), F.lit(100), 0.15, 3).alias("m"))
    rows, again = pairs.collect(), pairs.repartition(3).collect()
    assert {r.id: r.m for r in rows} == {r.id: r.m for r in again}
    kinds = Counter()
    for r in rows:
        for old, (new, label) in zip(r.ids, r.m):
            if label == -100:
                assert new == old
                kinds["kept"] += 1
            else:
                assert label == old and old >= 11
                kinds["mask" if new == K.MASK_ID else "same" if new == old else "random"] += 1
    chosen = kinds["mask"] + kinds["same"] + kinds["random"]
    assert abs(chosen / 10_000 - 0.15) < 0.02 and abs(kinds["mask"] / chosen - 0.8) < 0.05


def test_long_pairs(spark):
    big = "x" * 200
    df = spark.createDataFrame([
        ("ok", "<SURFACE>a", "b"), ("cut", f"<SURFACE>{big}<SURFACE>{big}", f"{big}<SURFACE>{big}"),
        ("uneven", f"{big}<SURFACE>{big}", big * 2), ("still", f"{big * 2}<SURFACE>a", "a<SURFACE>b"),
    ], "id string, g string, t string")
    got = {(r.id, r.piece): (r.g, r.t, r.status) for r in Q.split_long_pairs(df, "g", "t", ["id"]).collect()}
    assert got[("ok", 0)] == ("<SURFACE>a", "b", "ok")
    assert got[("cut", 1)] == got[("cut", 2)] == ("<SURFACE>" + big, "<SURFACE>" + big, "fixed")
    assert got[("uneven", 0)][2] == "rejected"
    assert (got[("still", 1)][2], got[("still", 2)]) == ("too_long", ("<SURFACE>a", "<SURFACE>b", "fixed"))


def test_accuracy_and_lengths(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, -100, 4])], "pred array<int>, label array<int>")
    assert tuple(metrics.masked_accuracy(df).first()) == (2, 0.5)
    ids = spark.createDataFrame([([5, 1, 1],), ([5, 6, 7],)], "ids array<int>")
    assert metrics.mean_length(ids, "ids").first().gen_len == 2.0
    scores = spark.createDataFrame([([0.1, 0.7, 0.7],)], "v array<double>")
    assert scores.select(S.argmax(F.col("v"))).first()[0] == 1


def reference_bleu(pairs):
    matches, totals, refs, hyps = [0] * 5, [0] * 5, 0, 0
    for hyp, ref in pairs:
        h, r = hyp.split(), ref.split()
        refs, hyps = refs + len(r), hyps + len(h)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            matches[n] += sum(min(c, rc[g]) for g, c in hc.items())
            totals[n] += sum(hc.values())
    if not all(totals[1:]) or not any(matches):
        return 0.0
    logs, smooth = 0.0, 1
    for n in range(1, 5):
        if matches[n] == 0:
            smooth *= 2
        logs += math.log(100 * matches[n] / totals[n] if matches[n] else 100 / (smooth * totals[n]))
    return round((1 if hyps >= refs else math.exp(1 - refs / hyps)) * math.exp(logs / 4), 4)


@pytest.mark.parametrize("pairs", [
    [("a b c d e", "a b c d e")], [("a b c d x y", "a b c d e f g h"), ("the the the the", "the cat")],
    [("a b c d", "e f g h")], [("a b", "a b")], [("  a b c d e\n", "a b c x e")],
])
def test_bleu(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, p string, l string")
    assert metrics.corpus_bleu(df, "p", "l").first().bleu == pytest.approx(reference_bleu(pairs), abs=1e-4)


def test_annotated_records(spark):
    atf_text = "&P1 = x\n#atf: lang sux\n#tr.en: 2 sheep \n1. 2(diš) udu \n"
    rows = [
        ("r1", [(("Admin",),), (("Legal",),)], ("Ur III",), (atf_text,)),
        ("r2", [], None, (atf_text.replace("&", ""),)), ("r3", None, None, ("#atf: lang akk",)), ("r4", None, None, None),
    ]
    from parcorp.schemas import ATF_RECORDS
    got = {r.id: r for r in atf.parsed(spark.createDataFrame(rows, ATF_RECORDS)).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].name, got["r1"].genre, got["r1"].period) == ("P1", "Admin, Legal", "Ur III")
    assert (got["r1"].translation, got["r1"].transliteration) == ("2 sheep", "\n1. 2(diš) udu\n")
    assert (got["r2"].name, got["r2"].genre, got["r2"].period) == (None, "Unknown", "Unknown")


def test_prompts(spark):
    df = spark.createDataFrame([("a", "<SURFACE>\n\nx  ...  <unk> y\n"), ("b", "z" * 300)], "id string, transliteration string")
    got = {r.id: r for r in augment.prompts(df, "H ").collect()}
    assert got["a"].transliteration == "x......y"
    assert got["a"].prompt == "H INPUT:\nx......y\n\nOUTPUT:\n"
    assert got["b"].prompt == "" and got["b"].n_tokens == 302
    done = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in augment.pending_prompts(df, done, "H ").collect()] == ["b"]


def test_genre_list_is_unknown_only_without_genres(spark):
    schema = "g array<struct<genre:struct<genre:string>>>"
    rows = [([],), (None,), ([(("",),)],), ([(("a",),), ((None,),)],)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(atf.genre_list(F.col("g"))).collect()]
    assert got == ["Unknown", "Unknown", "", "a"]


def test_null_ids_are_encoded(spark):
    df = spark.createDataFrame([(None, "ab"), (1, "ba")], "id long, t string")
    vocab = Q.vocabulary(df, "t")
    enc = Q.encode(df, vocab, "t")
    assert {r.id: r.input_ids[1:-1] for r in enc.collect()} == {None: [11, 12], 1: [12, 11]}
    assert {r.id: r.text for r in Q.decode(enc, vocab, "input_ids").collect()} == {None: "ab", 1: "ba"}


def test_masks_draw_from_the_vocabulary(spark):
    df = spark.createDataFrame([(i, [11 + j % 5 for j in range(i)]) for i in range(200)], "id long, ids array<int>")
    out = df.select("ids", S.masked(F.col("ids"), F.col("id"), F.lit(16), 0.15, 3).alias("m")).collect()
    pairs = [(i, x.id, x.label) for r in out for i, x in zip(r.ids, r.m)]
    assert all(len(r.ids) == len(r.m) for r in out)
    chosen = [(i, new) for i, new, label in pairs if label != -100]
    assert 0.13 < len(chosen) / len(pairs) < 0.17 and all(0 <= new < 16 for _, new in chosen)
    assert 0.76 < sum(new == 4 for _, new in chosen) / len(chosen) < 0.86
    assert all(i == new for i, new, label in pairs if label == -100)


def test_13a_tokens(spark):
    said = {
        "Hello, world!": "Hello , world !",
        "It costs $3.50, or 1,000.": "It costs $ 3.50 , or 1,000 .",
        "a.b,c 3-4 x-y 5.": "a . b , c 3 - 4 x-y 5 .",
        "&quot;A&amp;B&quot; &lt;tag&gt;": '" A & B " < tag >',
        "end-\nof line\nnext": "endof line next",
        "don't (stop) [now] {x} a/b @c #d": "don't ( stop ) [ now ] { x } a / b @ c # d",
        "<skipped>été, naïve.": "été , naïve .",
        "1.": "1 .", ".5 ,": ". 5 ,", "": "",
    }
    df = spark.createDataFrame(list(said.items()), "t string, want string")
    for r in df.select("want", metrics.spaced_13a(F.col("t")).alias("got")).collect():
        assert " ".join(r.got.split()) == r.want
    pairs = spark.createDataFrame([(1, "The cat, sat.", "The cat , sat ."), (2, None, "x")], "id int, p string, l string")
    spaced = metrics.corpus_bleu(pairs, "p", "l", tokenise="13a").first()
    assert spaced.sys_len == 5 and spaced.ref_len == 6
    assert metrics.corpus_bleu(pairs, "p", "l").first().sys_len == 3


def test_bleu_tasks_grow_with_the_texts(spark, monkeypatch):
    rows = [(i % 40, f"a b {i % 7} c d", f"a b {i % 5} c d e") for i in range(90)] + [(None, "x y", "x y z")]  # ids repeat
    df = spark.createDataFrame(rows, "id int, p string, l string")
    few = metrics.ngram_matches(df, "p", "l").orderBy("n").collect()
    monkeypatch.setattr(metrics, "PLACE_BYTES", 200, raising=False)
    many = metrics.ngram_matches(df, "p", "l")
    places = re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", many._jdf.queryExecution().executedPlan().toString())
    assert many.orderBy("n").collect() == few and max(map(int, places)) > 20
