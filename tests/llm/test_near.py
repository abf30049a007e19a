import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from parcorp.llm import common, pq_dedup, simhash, suffixes


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)]
    links += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)]
    links = [(a, b) for a, b in links if a != b] + [(160, 100)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({x for e in links for x in e}, links)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\r\n", "One", "one two", "one  TWO", "one two three four", "a\x0bb\x0cc d e", "É é \xa0x y", "w " * 70_000]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t) == fingerprint(t)
    # the same hash as Spark's own
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_bit_sliced_distances():
    rnd = np.random.default_rng(0)
    fps = rnd.integers(0, 2**63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, *[fps ^ np.uint64(int(m)) for m in (1, 7, 1 << 63, 15, 31, 2**40 + 5)], np.zeros(1, np.uint64)]))
    for radius in (0, 1, 3, 4, 6):
        got = {(i, int(j)) for i, js in simhash.within(fps, simhash.planes(fps), 0, len(fps), radius) for j in js}
        want = {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if bin(int(a ^ b)).count("1") <= radius}
        assert got == want


@pytest.mark.parametrize("pieces,block", [(5, 4096), (6, 16), (7, 8)])
def test_near_groups(spark, pieces, block):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rnd.choices(words, k=120)) for _ in range(8)]
    texts = list(TEXTS) + base + [t.replace(t.split()[i], "new") for t in base for i in range(25)] + [base[0]] * 60
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "One", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    fps = {i: fingerprint(t) for i, t, _, _ in rows}
    links = [(i, j) for i, j in itertools.combinations(fps, 2) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = roots(fps, links)
    got = simhash.near_groups(df, pieces=pieces, block=block).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fp % 2**64 == fps[r.doc_id] for r in got)


def test_near_groups_empty(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_key_masks_share_one():
    for pieces in (5, 6, 7):
        masks = simhash.key_masks(pieces)
        rnd = random.Random(pieces)
        for _ in range(300):
            flip = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not flip & m for m in masks)


# ---- vectors -----------------------------------------------------------------------------------
def vectors():
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 16))
    rows = [(base[i % 60] + rnd.normal(size=16) * rnd.choice([0, 0.05, 0.09, 0.2]), i % 3) for i in range(400)]
    rows = [([float(x) for x in v], lab) for v, lab in rows]
    rows += [([2 * x for x in rows[0][0]], 0), (rows[0][0], 0), (rows[0][0], 0), (rows[0][0], None), (None, 1), ([], 1)]
    rows += [([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [0.0] * 15, 1), ([None] + [1.0] * 15, 1)]
    rows += [([1.0, 2.0], 1), ([1.0, 2.1], 1), ([1e300, 1e300], 1), ([-0.0, 1.0], 1), ([0.0, 1.0], 1)]
    return [(i, v, lab) for i, (v, lab) in enumerate(rows)]


def brute(rows, threshold):
    def ok(v, lab):
        return lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {}
    for i, v, lab in rows:
        if ok(v, lab):
            x = np.array(v) / max(abs(y) for y in v)
            unit[i] = (lab, x / np.sqrt((x * x).sum()))
    links = []
    for key in {(lab, len(x)) for lab, x in unit.values()}:
        mine = [i for i, (lab, x) in unit.items() if (lab, len(x)) == key]
        x = np.array([unit[i][1] for i in mine])
        links += [(mine[a], mine[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)))]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = roots(n, links)
    return {i: (n[i], root[i], root[i] == i) for i in n}


@pytest.mark.parametrize("lists,block", [(None, 2048), (12, 2048), (5, 20)])
def test_near_vectors(spark, lists, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, c string")
    got = pq_dedup.near_vectors(df, lists=lists, block=block, miss=0).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows, 0.93)
    assert sum(n for n, _, _ in brute(rows, 0.93).values()) > 300


def test_recall_of_the_default_probes(spark):
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(1500, 32))
    side = rnd.normal(size=base.shape) * 0.35  # cosines around the threshold
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, base + side]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = pq_dedup.near_vectors(df, lists=40).agg({"n_links": "sum"}).first()[0]
    want = sum(n for n, _, _ in brute(rows, 0.93).values())
    assert 0.99 * want <= got <= want and want > 1000


def test_default_probes_miss_no_neighbour_on_low_rank_vectors(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(2000, 4)) @ rnd.normal(size=(4, 64))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = pq_dedup.near_vectors(df, lists=40).agg({"n_links": "sum"}).first()[0]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = int((x @ x.T >= 0.93).sum()) - len(x)
    assert got == want and want > 10_000


def test_vectors_of_floats_keep_double_precision(spark):
    rows = [(i, v, lab) for i, v, lab in vectors() if not v or v[0] != 1e300]
    rows += [(1000, [1e38, 1e38], 1), (1001, [3e-45, 3e-45], 1)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = pq_dedup.near_vectors(df, lists=3, block=50).collect()
    want = brute(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert want[1000][0] >= 3 and want[1001][0] >= 3


def test_near_vectors_without_usable_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pq_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = pq_dedup.near_vectors(spark.createDataFrame([(1, None, 2), (2, [1.0], None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- repeated passages ---------------------------------------------------------------------------
def passages(rows, words):
    """Covered words per id, and those behind the first occurrence, by all windows."""
    seen = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for q in range(len(w) - words + 1):
            seen.setdefault(tuple(w[q:q + words]), []).append((i, q))
    every, later = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, q) in enumerate(sorted(places)):
                every.setdefault(i, set()).update(range(q, q + words))
                if k:
                    later.setdefault(i, set()).update(range(q, q + words))
    return every, later


@pytest.mark.parametrize("words,window,gram", [(50, 24, 4), (12, 6, 3), (12, 9, 4)])
def test_repeated_passages(spark, words, window, gram):
    rnd = random.Random(words + window)
    vocab = [f"v{i}" for i in range(40)]
    hot = " ".join(rnd.choices(vocab, k=80))
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 200))) for _ in range(60)]
    texts = [t[: len(t) // 2] + (f" {hot[rnd.randint(0, 40):]} " if i % 3 == 0 else " ") + t[len(t) // 2:] for i, t in enumerate(texts)]
    texts += [texts[4], texts[4], None, "", "a " * 300, "a " * 130, texts[5][: len(texts[5]) // 2] + " tail"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows + [(None, hot)]], "doc_id long, text string, id string, pos int")
    last = 10**6  # rows without an id come last
    every, later = passages([*rows, (last, hot)], words)
    out = suffixes.repeated_passages(df, words=words, window=window, gram=gram).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        key = last if r.doc_id is None else r.doc_id
        assert {x for s in r.spans for x in range(s.start, s.end)} == every.get(key, set())
        assert {x for s in r.later for x in range(s.start, s.end)} == later.get(key, set())
        assert r.n_words == len(every.get(key, ())) and r.n_later == len(later.get(key, ()))
    assert every and later


@pytest.mark.parametrize("tasks", [1, 4, 13])
@pytest.mark.parametrize("hashes", [1, 2])
@pytest.mark.parametrize("only", [False, True])
def test_runs_over_several_tasks(spark, tasks, hashes, only):
    rnd = random.Random(tasks)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 90), i % 2, i, 0, 1) for i in range(400)]
    rows += [(5, 5, 1, 2, 1), (5, 6, 1, 2, 1), (5, 6, 1, 3, 1)]
    df = spark.createDataFrame(rows, "h1 long, h2 long, id long, pos int, n int")
    got = {tuple(r) for r in suffixes.compared(df, tasks, hashes, only).collect()}
    by = {}
    for r in sorted(rows):
        by.setdefault(r[:hashes], []).append(r)
    kinds = {}
    for members in by.values():
        low = min(members, key=lambda r: r[2:4])
        for r in members:
            kinds[r] = suffixes.ONLY if len(members) == 1 else suffixes.FIRST if r == low else suffixes.LATER
    if hashes == 1:  # which one is first is only told where both hashes are compared
        got = {(*r[:5], min(r[5], 1)) for r in got}
        kinds = {r: min(k, 1) for r, k in kinds.items()}
    assert got == {(*r, k) for r, k in kinds.items() if only or k}


def test_rows_without_or_with_equal_ids_are_rows_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    passage, alone = " ".join(words), " ".join(f"x{i}" for i in range(70))
    rows = [(None, passage), (5, "a b " + passage), (5, alone), (None, passage + " c"), (5, "d " + passage), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffixes.repeated_passages(df).collect()
    assert len(out) == len(rows)
    spans = sorted((str(r.doc_id), [(s.start, s.end) for s in r.spans]) for r in out)
    assert spans == [("5", []), ("5", [(1, 61)]), ("5", [(2, 62)]), ("None", []), ("None", [(0, 60)]), ("None", [(0, 60)])]
    first = [r for r in out if r.n_words and not r.n_later]
    assert len(first) == 1 and first[0].doc_id == 5 and sum(r.n_later for r in out) == 3 * 60


def test_repeated_passages_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
