import heapq
import random
from fractions import Fraction

import numpy as np
import pytest

from parcorp.llm import mixing, packing


def rounds(blocks, weights):
    """Quotas of the rounds, until all blocks are used."""
    left = dict(blocks)
    while any(left.values()):
        quota = {s: min(weights[s], left[s]) for s in left}
        left = {s: left[s] - quota[s] for s in left}
        yield quota


@pytest.mark.parametrize("case", range(6))
def test_deviation_below_one_block(spark, case):
    rnd = random.Random(case)
    n = {s: rnd.randint(0, 300) for s in range(rnd.randint(1, 12))}
    w = {s: rnd.choice([1, 2, 7, 50]) for s in n}
    out = sorted(mixing.schedule(spark, n, w).collect())
    assert [r.slot for r in out] == list(range(sum(n.values())))
    used, at = {s: 0 for s in n}, 0
    for quota in rounds(n, w):
        total, before = sum(quota.values()), dict(used)
        for t in range(1, total + 1):
            r = out[at]
            at += 1
            assert r.block == used[r.src]
            used[r.src] += 1
            assert all(abs(Fraction(quota[s] * t, total) - (used[s] - before[s])) < 1 for s in n)
    assert used == n


def edf(n, w):
    """Earliest deadline first, slot by slot."""
    used, out = {s: 0 for s in n}, []
    for quota in rounds(n, w):
        total, taken = sum(quota.values()), {s: 0 for s in n}
        for t in range(total):
            ready = [(-(-(taken[s] + 1) * total // quota[s]), s) for s in n
                     if taken[s] < quota[s] and taken[s] * total // quota[s] <= t]
            _, s = min(ready)
            out.append((len(out), s, used[s]))
            taken[s] += 1
            used[s] += 1
    return out


def test_schedule_is_edf(spark):
    n, w = {0: 400, 1: 170, 2: 5, 3: 0, 4: 33}, {0: 50, 1: 13, 2: 1, 3: 9, 4: 13}
    assert sorted(tuple(r) for r in mixing.schedule(spark, n, w).collect()) == edf(n, w)


def edf_by_heap(n, w):
    """The same for many sources."""
    used, out = {s: 0 for s in n}, []
    for quota in rounds(n, w):
        total, ready, at = sum(quota.values()), [], 0
        jobs = sorted((i * total // q, -(-(i + 1) * total // q), s) for s, q in quota.items() for i in range(q))
        for t in range(total):
            while at < len(jobs) and jobs[at][0] <= t:
                heapq.heappush(ready, jobs[at][1:])
                at += 1
            _, s = heapq.heappop(ready)
            out.append((len(out), s, used[s]))
            used[s] += 1
    return out


@pytest.mark.parametrize("sources,most", [(5, 60), (300, 1), (20_000, 2)])
def test_schedule_of_many_sources_is_edf(spark, sources, most):
    rnd = random.Random(sources)
    n = {s: rnd.randint(0, 4) * (1 if sources > 9 else 90) for s in range(sources)}
    w = {s: 50 if sources == 300 else rnd.randint(1, most) for s in n}
    want = edf_by_heap(n, w)
    assert sources > 9 or want == edf(n, w)
    assert sorted(tuple(r) for r in mixing.schedule(spark, n, w).collect()) == want


def test_mix_of_many_sources_places_every_row_once(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('s', id % 2500) AS source")
    out = mixing.mix(df, block_rows=1).collect()
    assert sorted(r.position for r in out) == list(range(5000))
    half = {r.source for r in out if r.position < 2500}
    assert len(half) == 2500  # equal sources take turns


def test_mix_places_every_row_once(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "t") for i in range(500)] + [(None, None, None), (3, "hot", "t"), (3, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = mixing.mix(df, block_rows=8).collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    for r in out:  # rows of a block stand together
        assert r.block >= 0
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.block), []).append(r.position)
    assert all(max(p) - min(p) == len(p) - 1 <= 7 for p in blocks.values())
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"hot": 1})


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def brute_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b[0], i) for i, b in enumerate(bins)
                if b[0] >= size and b[0] > 0 and (s == -1 or s not in b[1]) and (c == -1 or c not in b[2])]
        if fits:
            _, i = min(fits)
        else:
            bins.append([capacity, set(), set()])
            i = len(bins) - 1
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= size
        bins[i][1].add(s)
        bins[i][2].add(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rnd = np.random.default_rng(seed)
    n = 700
    sizes = -np.sort(-np.minimum(100, rnd.geometric(0.03, n)))
    sources = np.where(rnd.random(n) < 0.35, 0, rnd.integers(-1, 300 if seed % 2 else 12, n))
    clusters = np.where(rnd.random(n) < 0.3, 5, rnd.integers(-1, 400, n))
    got = packing.best_fit(sizes, sources, clusters, 100)
    assert list(zip(*[g.tolist() for g in got])) == brute_fit(sizes.tolist(), sources.tolist(), clusters.tolist(), 100)


def test_pack(spark):
    rows = [(i, "w " * (i % 90 + 1), f"s{i % 5}", "x") for i in range(300)]
    rows += [(400, None, "s0", "x"), (401, "", None, "x"), (402, "long " * 20_000, "s1", "x"), (None, "a b c", None, "x"), (500, "same", "s9", "x"), (500, "same", "s9", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    out = packing.pack(df, capacity=100, shard_rows=64).collect()
    assert len([r for r in out if r.doc_id == 402]) == 200
    assert {r.doc_id for r in out if r.bin is None} == {400, 401}
    assert len(out) == len(rows) + 199
    source = {r[0]: r[2] for r in rows}
    bins = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for members in bins.values():
        spans = sorted((m.offset, m.offset + m.n_words) for m in members)
        assert spans[0][0] == 0 and spans[-1][1] <= 100
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        named = [source[m.doc_id] for m in members if source[m.doc_id] is not None]
        assert len(named) == len(set(named))
    assert packing.pack(spark.createDataFrame([], df.schema)).count() == 0


@pytest.mark.parametrize("mixed", [False, True])
def test_crowded_shards_are_dealt_out(spark, mixed):
    rows = [(7 if i % 3 else None, " ".join(f"w{i}x{j % 90}" for j in range(700)), f"s{i % 50}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    places = mixing.mix(df) if mixed else None
    out = packing.pack(df, capacity=10, shard_rows=100, places=places).collect()
    assert sum(r.n_words for r in out) == 60 * 700
    per_shard, held = {}, {}
    for r in out:
        per_shard[r.bin >> 20] = per_shard.get(r.bin >> 20, 0) + 1
        held[r.bin] = held.get(r.bin, 0) + r.n_words
    assert max(per_shard.values()) < 400 and len(per_shard) > 15 and max(held.values()) <= 10


def test_bin_numbers_are_checked(monkeypatch):
    monkeypatch.setattr(packing, "_BIN_BITS", 3)
    with pytest.raises(ValueError, match="more bins"):
        packing.best_fit(np.full(9, 10), np.full(9, -1), np.full(9, -1), 10)
