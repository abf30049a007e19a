import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcorp.llm import chat, langid

SAID = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "system", "be <<good>>"), (1, 1, "user", SAID), (1, 2, "assistant", r"<\s>[\\INST]<s>\\[/INST]"),
    (1, 3, "assistant", "twice <|endoftext|> \\"), (2, 5, "user", None), (2, 1, "assistant", ""), (3, 0, None, "no role"),
    (3, 1, "to[ROLE]ol", "x[/ROLE]</s>"), (None, 0, "user", "no id"), (None, 1, "assistant", "é𝄞 \U0001f600 日本"),
    (4, 0, "assistant", "a " * 60_000), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "tie"),
    (6, None, "user", "first"), (6, 10**12, "assistant", "last"), (6, 5000, "assistant", "\n\n  "), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID),
]
TURNS += [(8, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(3000)]


def expected():
    out = {}
    for conv in {t[0] for t in TURNS}:
        rows = [(turn, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or "") for c, turn, role, text in TURNS if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3]))
        said = [(role, text) for _, role, _, text in rows]
        loss = "".join(text for role, text in said if role == "assistant")
        marks = {"user": 13, "system": 11, "assistant": 4}
        size = 3 + sum(len(chat.escape(t)) + marks.get(r, 17 + len(chat.escape(r))) for r, t in said)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        out[conv] = (conv, len(said), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, ids string")
    tokens = chat.formatted(df.repartition(3)).cache()
    got = {r.conv_id: tuple(r) for r in chat.read_back(tokens).collect()}
    assert got == expected()
    rows = tokens.orderBy("conv_id", "at").collect()
    for conv in {t[0] for t in TURNS}:  # places follow one another, turns are counted
        mine = [r for r in rows if r.conv_id == conv]
        assert [r.turn_no for r in mine] == list(range(len(mine)))
        assert [r.at for r in mine] == [sum(len(x.ids) for x in mine[:i]) for i in range(min(len(mine), 50))] + [r.at for r in mine[50:]]
        assert all(len(r.ids) == len(r.loss) for r in mine)
    tokens.unpersist()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(df)).count() == 0


def test_missing_tokens_are_noticed(spark):
    df = spark.createDataFrame([t for t in TURNS if t[0] == 1], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="tokens missing"):
        chat.read_back(chat.formatted(df).where("turn_no <> 1")).collect()


def test_escapes():
    rnd = random.Random(0)
    parts = [*chat.CONTROL, chat.END_OF_TEXT, "<", "[", "\\", "/s>", "s>", "INST]", " ", "a"]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in [*chat.CONTROL, chat.END_OF_TEXT])


# ---- languages ------------------------------------------------------------------------------------
def best_path(scores, switch):
    n, k = scores.shape
    paths = []
    for path in itertools.product(range(k), repeat=n):
        paths.append((sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:])), path))
    return max(paths)[0]


def test_viterbi_is_optimal():
    rnd = np.random.default_rng(3)
    scores = rnd.normal(size=(60, 3)).astype(np.float32) * 4
    bounds = np.array([0, 7, 7, 13, 14, 22, 30, 38, 46, 53, 60])
    labels = langid.viterbi(scores, bounds, 3.0)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            mine = labels[a:b]
            value = sum(scores[a + i, p] for i, p in enumerate(mine)) - 3.0 * sum(x != y for x, y in zip(mine, mine[1:]))
            assert value == pytest.approx(best_path(scores[a:b].astype(float), 3.0), abs=1e-4)


SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["schr", "eng", "ung", "och"], "ru": ["пра", "ве", "ст", "ний"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(2, 4))) for _ in range(n))


def test_languages_and_spans(spark):
    rnd = random.Random(7)
    rows = [(i, prose(rnd, lang, 40), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 120))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "ru"]
    mixed = [prose(rnd, lang, 12) for lang in ("aa", "ru", "bb")]
    tests = [(1, prose(rnd, "aa", 30)), (2, prose(rnd, "bb", 30).upper()), (3, prose(rnd, "ru", 3)), (4, "\n".join(mixed)),
             (5, None), (6, ""), (7, "12 34 !! \t"), (8, "日本語 のみ"), (9, prose(rnd, "aa", 200_000)), (None, prose(rnd, "bb", 9)),
             (1, "𝄞" + prose(rnd, "ru", 5) + "𝄞")]
    df = spark.createDataFrame([(*t, "clash", 2) for t in tests], "doc_id long, text string, lang_pred string, spans int")
    out = {(r.doc_id, r.lang_pred): r for r in langid.label(df, model).collect()}
    assert set(out) >= {(1, "aa"), (2, "bb"), (3, "ru"), (5, "und"), (6, "und"), (7, "und"), (9, "aa"), (None, "bb"), (1, "ru")}
    assert len(out) == len(tests)
    four = next(r for (i, _), r in out.items() if i == 4)
    assert [s.lang for s in four.spans] == ["aa", "ru", "bb"]
    text = tests[3][1]
    assert [text[s.start:s.end] for s in four.spans] == mixed
    for r in out.values():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0) == (not r.spans)
    kept = langid.accepted(df, model, 0.5)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 9, None} | ({8} if (8, "und") not in out else set()) | ({4} if four.score >= 0.5 else set())


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang, rnd.randint(1, 50)), lang, "s") for i, lang in enumerate(itertools.islice(itertools.cycle(["aa", "bb"]), 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = langid.identified(df).join(df.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 60 and right / n > 0.97


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[:3] for r in langid.identified(df).collect()] == [(1, "und", 0.0)]
    assert langid.identified(df.limit(0)).count() == 0


def test_long_texts_are_cut_at_words():
    text = "ab " * 700_000 + "c" * 10
    pieces = list(langid._pieces(text))
    assert "".join(p for _, p in pieces) == text and len(pieces) > 1
    assert all(not p[-1].isalpha() for _, p in pieces[:-1])
    assert re.fullmatch("x+", "".join(p for _, p in langid._pieces("x" * 3_000_000)))


def test_many_languages(spark):
    rnd = random.Random(8)
    rows, every = [], [a + b + c for a in "bcdfghklmnprst" for b in "aeiou" for c in "bdgklmnrst"]
    for k in range(2000):
        own = rnd.sample(every, 6)
        rows += [(4 * k + i, " ".join("".join(rnd.choices(own, k=2)) for _ in range(25)), f"l{k:04d}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df)
    assert len(model.langs) == 2000 and model.scores.shape[0] < 20_000
    sample = df.where("doc_id % 400 < 2")
    got = langid.label(sample, model).join(sample.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.95 * sample.count()
    whole, parts = model.explained(rows[0][1] * 40), []
    big, langid.GROUP = langid.GROUP, 2000
    try:
        parts = model.explained(rows[0][1] * 40)
    finally:
        langid.GROUP = big
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))
