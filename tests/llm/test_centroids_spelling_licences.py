import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parcorp.llm import centroids, licences, spelling
from parcorp.llm.queries import QUERIES


# ---- centroids ------------------------------------------------------------------------------
def brute_clusters(rows, k, rounds, dim, scale=256):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(at)):
            mine = [v for (_, v), (w, _) in zip(kept, where) if w == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    where = assign()
    total = sum(d for _, d in where)
    per = Counter()
    for c, d in where:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(map(repr, [(i, c, d, per[c], total, digest[c]) for (i, _), (c, d) in zip(kept, where)]))


def clusters(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, cluster int")
    return sorted(repr(tuple(r)) for r in centroids.grouped(df, **kw).collect())


@pytest.mark.parametrize("dim,k", [(3, 7), (16, 40)])
def test_clusters_equal_brute_force(spark, dim, k):
    rnd = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rnd.normal(size=dim).astype(np.float32)]) for i in range(300)]
    rows += [(i, [float(x) for x in np.round(rnd.normal(size=dim) * 2) / 256]) for i in range(300, 400)]  # ties
    rows += [(None, rows[0][1]), (5, rows[5][1]), (401, None), (402, []), (403, [0.0] * dim), (404, [None] * dim),
             (405, [float("nan")] * dim), (406, [float("inf")] + [0.0] * (dim - 1)), (407, [1.0] * (dim + 1))]
    assert clusters(spark, rows, k=k, dim=dim) == brute_clusters(rows, k, 5, dim)


def test_few_and_no_vectors(spark):
    assert clusters(spark, [], dim=2) == []
    assert clusters(spark, [(1, None)], dim=2) == []
    rows = [(i, [0.5, -0.5]) for i in range(10)]  # all centroids alike: the first gets all
    assert clusters(spark, rows, k=4, dim=2) == brute_clusters(rows, 4, 5, 2)
    with pytest.raises(Exception, match="too large"):
        clusters(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], k=1, dim=2)


@pytest.mark.parametrize("k", [1, 2, 5, 40, 300])
def test_tree_finds_the_nearest_and_the_smallest_number(k):
    rnd = np.random.default_rng(k)
    points = rnd.integers(-4, 5, (k, 3))  # many equal centroids and equal distances
    q = rnd.integers(-6, 7, (500, 3))
    who, d2 = centroids.VantageTree(points).nearest(q)
    all_d = ((q[:, None] - points[None]) ** 2).sum(axis=2)
    assert (who == all_d.argmin(axis=1)).all() and (d2 == all_d.min(axis=1)).all()
    big = rnd.integers(-(1 << 27), 1 << 27, (k, 64))
    q = np.concatenate([big[:50] + 1, rnd.integers(-(1 << 27), 1 << 27, (50, 64))])
    who, d2 = centroids.VantageTree(big).nearest(q)
    all_d = ((q[:, None] - big[None]) ** 2).sum(axis=2)
    assert (who == all_d.argmin(axis=1)).all() and (d2 == all_d.min(axis=1)).all()


def test_tree_leaves_centroids_out():
    rnd = np.random.default_rng(0)
    middle = rnd.integers(-10_000, 10_000, (40, 8))
    points = (middle[:, None] + rnd.integers(-20, 20, (40, 25, 8))).reshape(-1, 8)
    tree = centroids.VantageTree(points)
    seen = []
    tree.held = [Spied(h, seen) for h in tree.held]
    tree.nearest(points[:200])
    assert sum(seen) < 0.3 * 200 * len(tree.held)


class Spied:
    """Notes for how many vectors a node's centroids were compared."""

    def __init__(self, members, seen):
        self.members, self.seen = members, seen

    def __iter__(self):
        self.seen.append(1)
        return iter(self.members)


# ---- spelling -------------------------------------------------------------------------------
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, min_length=5, min_count=3, noise=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    links = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(links[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(repr((w, form[w], root(w), n[w], len(links[w]), n.get(form[w]))) for w in n)


def variants(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    return sorted(repr(tuple(r)) for r in spelling.variants(df, **kw).collect())


def test_variants_equal_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("aabcdé") for _ in range(rnd.randrange(4, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(80):
            w = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                p = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:p] + w[p + 1:], w[:p] + rnd.choice("abÉÀ") + w[p:], w[:p] + rnd.choice("abz") + w[p + 1:]])
            words.append(rnd.choice([w, w.upper(), w.title()]))
        rows.append((i % 140, rnd.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(None, "hello hello hello jello jello jello"), (7, None), (8, ""), (9, "1 2 3 × ÷")]
    for noise in (97, 5):
        assert variants(spark, rows, noise=noise) == brute_words(rows, noise=noise)


def test_long_equal_letters_chains_and_no_words(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(3000))
    rows = [(1, " ".join([long] * 9)), (2, " ".join([long[:1500] + long[1501:]] * 3)), (3, " ".join(["aaaaaa"] * 20)),
            (4, " ".join(["aaaaa"] * 8 + ["aaaaaaa"] * 3)), (5, " ".join(["aabaa"] * 3)),
            # 64 and 65 letters: written out and digested prefixes meet
            (6, " ".join(["b" * 64] * 3 + ["b" * 65] * 7 + ["b" * 66] * 20))]
    got = variants(spark, rows, noise=10**12)
    assert got == brute_words(rows, noise=10**12)
    assert any("'aabaa', 'aaaaa', 'aaaaaa'" in r for r in got)
    assert variants(spark, []) == [] and variants(spark, [(1, "a b c")]) == []


# ---- licences -------------------------------------------------------------------------------
def brute_licences(rows, templates, per_template=licences.TEMPLATE_WORDS, per_file=licences.FILE_WORDS, aligned=licences.ALIGNED):
    texts = [licences.words_of(t or "") for t in rows]
    bodies = [licences.words_of(t.text) for t in templates]
    df = Counter(w for ws in texts for w in set(ws))
    order = sorted({w for b in bodies for w in b if df[w]}, key=lambda w: (df[w], w))
    live = [t for t in range(len(templates)) if all(df[w] for k in templates[t].keys for w in k.split())]
    post = {t: [w for w in order if w in bodies[t]][:per_template] for t in live}
    out = []
    for ws in texts:
        base = [(label, i) for p, label in licences.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
        top = [w for w in order if w in set(ws) and any(w in p for p in post.values())][:per_file]
        notes = []
        for t in live:
            starts = {i - q for i, w in enumerate(ws) if w in top and w in post[t] for q, x in enumerate(bodies[t]) if x == w}
            for s in starts:
                agree = {x for q, x in enumerate(bodies[t]) if x in post[t] and x in top and 0 <= s + q < len(ws) and ws[s + q] == x}
                def at(k):
                    q = next(q for q in range(len(bodies[t])) if bodies[t][q:q + len(k)] == k)
                    return s + q >= 0 and ws[s + q:s + q + len(k)] == k
                if len(agree) >= aligned and all(at(k.split()) for k in templates[t].keys):
                    same = sum(0 <= s + q < len(ws) and ws[s + q] == x for q, x in enumerate(bodies[t]))
                    notes.append((templates[t].label, same / len(bodies[t])))
        out.append(repr((len(ws), sorted(base), sorted(notes))))
    return out


def scanned(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id int, text string, ws int, base string").repartition(3)
    found = licences.scan(df, **kw).collect()
    return [repr((r.n_words, sorted(map(tuple, r.base)), sorted(map(tuple, r.notices)))) for r in sorted(found, key=lambda r: r.row.doc_id)]


LICENCE_ROWS = [
    None, "", "cc by", "CC-BY cc by, CC by", "see. Released under the MIT License.", "released under the mit license, x " * 300,
    "the license of MIT was released under", "Licensed under CC BY-NC 4.0.", "licensed cc under by nc 4 0",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "license under the apache license version 2 0", "Licensed under the Apache License, Version 2.0",
    "a " * 70_000 + "mit license", "mıt license é under the", "general public\x00license", "all rights", "reserved all rights reserved all",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and files without restriction",
    *["plain text under the tree of a license"] * 20,
]


def test_licences_equal_brute_force(spark):
    assert scanned(spark, LICENCE_ROWS) == brute_licences(LICENCE_ROWS, licences.TEMPLATES)
    for sizes in ({"per_template": 3, "per_file": 4, "aligned": 2}, {"aligned": 1}):
        assert scanned(spark, LICENCE_ROWS, **sizes) == brute_licences(LICENCE_ROWS, licences.TEMPLATES, **sizes)
    found = scanned(spark, LICENCE_ROWS)
    assert "'mit', 1.0" in found[4] and "mit" not in found[6] and "0.875" in found[10] and "cc-by-nc" not in found[8]


def test_licences_in_empty_and_plain_tables(spark):
    assert scanned(spark, []) == []
    assert scanned(spark, ["cc by", "nothing"]) == ["(2, [('cc-by', 0)], [])", "(1, [], [])"]


def test_only_native_functions_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, LICENCE_ROWS[4])], "doc_id int, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_spelling_variants", "op13_licence_scan"])
def test_registered(name):
    assert name in QUERIES
