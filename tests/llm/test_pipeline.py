import random

import pytest

import corpus_pipeline
from parcorp.llm import packing
from parcorp.llm.queries import QUERIES
from tests.llm.test_mixing_packing import brute_fit, edf
from tests.llm.test_near import fingerprint, roots


def fixture():
    rnd = random.Random(11)
    en = ["the", "thing", "nation", "which", "over", "shall", "with", "other"]
    de = ["und", "nicht", "schrift", "zeitung", "über", "macht", "auch", "ein"]
    rows = []
    for i in range(90):
        lang, words = ("en", en) if i % 3 else ("de", de)
        text = " ".join("".join(rnd.choices(words, k=2)) for _ in range(rnd.randint(20, 300)))
        rows.append((i, text, lang, "hot" if i % 2 else f"s{i % 5}"))
    rows += [(200 + i, rows[4][1].upper(), "en", "copy") for i in range(6)]
    rows += [(300 + i, rows[5][1] + " x" * (i % 2), "en", None) for i in range(4)]
    rows += [(400, None, "en", "s1"), (401, "12 34", "en", "s1"), (402, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark, tmp_path):
    rows = fixture()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", digest string")
    docs, text = df, {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "best_fit_pack":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
    # documents without a letter go, everything else stays
    assert set(kept["language_id"]) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    best = {}
    for i in kept["language_id"]:
        best[lower(text[i])] = max(i, best.get(lower(text[i]), i))
    assert sorted(kept["exact_dedup"]) == sorted(best.values())
    prints = {i: fingerprint(text[i]) for i in kept["exact_dedup"]}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = roots(prints, links)
    assert sorted(kept["simhash_dedup"]) == sorted(i for i in root if root[i] == i)
    assert sorted(kept["mix_sources"]) == sorted(kept["simhash_dedup"])
    assert set(kept["best_fit_pack"]) == set(kept["mix_sources"])


def test_mixture_decides_the_order(spark, tmp_path):
    rows = fixture()[:90]
    df = spark.createDataFrame(rows, SCHEMA)
    corpus_pipeline.mix_sources(spark, df, "").coalesce(1).write.parquet(f"{tmp_path}/m")
    got = [r.source for r in spark.read.parquet(f"{tmp_path}/m").collect()]
    counts = {s: got.count(s) for s in set(got)}
    names = sorted(counts)
    top = max(counts.values())
    weights = {i: max(1, round(50 * (counts[s] / top) ** 0.7)) for i, s in enumerate(names)}
    blocks = {i: -(-counts[s] // 16) for i, s in enumerate(names)}
    want = []
    for _, s, block in edf(blocks, weights):
        want += [names[s]] * min(16, counts[names[s]] - 16 * block)
    assert got == want


def test_mixture_decides_the_bins(spark):
    rows = [(i, f"word{i} and more", "en", "ab"[i % 2], 1) for i in range(256)] + [(None, f"x{i}", "en", None, 1) for i in range(32)]
    df = spark.createDataFrame(rows, SCHEMA)
    for first, other in ("ab", "ba"):
        out = corpus_pipeline.pack_sequences(spark, df, "", {first: 4, other: 1, "": 1}, shard_rows=32).collect()
        assert len(out) == len(rows)
        half = sorted((r for r in out if r.doc_id is not None), key=lambda r: r.bin >> 20)[:100]
        share = sum("ab"[r.doc_id % 2] == first for r in half) / len(half)
        assert share > 0.7


def test_packing_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(df, capacity=100).collect()
    cut = [r for r in packing.pieces(df, 100).collect() if r.n_words]
    cut.sort(key=lambda r: (-r.n_words, r.id, r.piece))
    number = {s: i for i, s in enumerate({r.source for r in cut if r.source is not None})}
    want = brute_fit([r.n_words for r in cut], [number.get(r.source, -1) for r in cut], [r.cluster for r in cut], 100)
    got = {(r.doc_id, r.piece): (r.bin & 0xFFFFF, r.offset) for r in out if r.bin is not None}
    assert got == {(r.id, r.piece): w for r, w in zip(cut, want)}


def test_run(spark, tmp_path):
    spark.createDataFrame(fixture(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "first_word", "n_words", "bin", "offset"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_unlearned_scripts_and_noise_go(spark):
    rnd = random.Random(3)
    noise = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(80))
    odd = [(500, "это документ на языке которого нет", None, "s1", 1), (501, "这是一个中文文件", None, "s1", 1),
           (502, noise, None, "s1", 1)]
    rows = fixture()[:90] + odd
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id for r in got} == set(range(90))


def test_one_row_of_each_group_stays(spark):
    rows = fixture()[:40]
    out = corpus_pipeline.exact_dedup_(spark, spark.createDataFrame(rows + rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    other = " ".join(f"v{i * 104729 % 1000}" for i in range(400))
    texts = [(1, long), (7, long), (7, other), (7, long), (None, other), (None, "alone and apart from all others")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, long), (7, other), (None, texts[5][1])], key=repr)


def test_exact_dedup_of_rows_with_maps(spark):
    rows = [(i, t, {"k": n}) for i, t, n in [(1, "a b", 1), (2, "A b", 2), (2, "a B", 1), (None, "c", 1), (None, "C", 0), (5, "d", 3)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    got = sorted((r.text, r.more["k"]) for r in corpus_pipeline.exact_dedup_(spark, docs, "").collect())
    assert got in ([("A b", 2), ("C", 0), ("d", 3)], [("C", 0), ("a B", 1), ("d", 3)])
    assert got == sorted((r.text, r.more["k"]) for r in corpus_pipeline.exact_dedup_(spark, docs.repartition(3), "").collect())


def test_rows_without_an_id_are_spread_over_the_mixture(spark, tmp_path):
    rows = [(i if i < 100 else None, f"text {i}", "en", "ab"[i % 2], 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    corpus_pipeline.mix_sources(spark, docs, "").coalesce(1).write.parquet(f"{tmp_path}/m")
    got = spark.read.parquet(f"{tmp_path}/m").collect()
    assert sorted(r.text for r in got) == sorted(r[1] for r in rows)
    places = [i for i, r in enumerate(got) if r.doc_id is not None]
    assert min(places) < 200 and max(places) > 1000
    half = [r.doc_id is None for r in got[:600]]
    assert 500 < sum(half) < 590


@pytest.mark.parametrize("empty", [True, False])
def test_no_rows_and_only_nulls(spark, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else [(None, None, None, None, None)] * 2, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_pack":
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
