"""Near-duplicates and top-k search against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from archspark.llm import mtree
from archspark.llm.mtree import Builder, Tree, top_inner_products
from archspark.llm.simhash import build_tree, components, fingerprint, near_duplicates, route, shard_links


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(points, radius):
    root = list(range(len(points)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(points)):
        for j in range(i):
            if bin(int(points[i]) ^ int(points[j])).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def clustered(rng, n, flips=3):
    centres = rng.integers(0, 2**63, n // 8, dtype=np.uint64) * np.uint64(2)
    out = rng.choice(centres, n)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    return np.unique(out)


def test_shards_find_every_link():
    rng = np.random.default_rng(2)
    points = clustered(rng, 600)
    tree = build_tree(points, 1.0, 40, 4, rng)
    assert tree is not None
    links, homes = [], 0
    for _, rows, home in route(tree, points, 4):
        homes += home.sum()
        a, b = shard_links(points[rows], home, 4)
        links += zip(a.tolist(), b.tolist())
    assert homes == len(points)
    root = {int(p): int(p) for p in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = brute_components(points, 4)
    got: dict = {}
    assert all(got.setdefault(find(int(p)), w) == w for p, w in zip(points, want))
    assert len(set(want)) == len(got) < len(points)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(-5, 500 + i) for i in range(40)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[500 + i] == -5 for i in range(40)) and len(got) == 102
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_against_brute_force(spark, docs_of):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([0, 2, 4, 80]))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0 and words:
            words[-1] = "Changed"
            rows += [(100 + i, " ".join(words)), (200 + i, rows[-1][1])]
    rows += [(300, None), (301, " \n"), (301, " \n"), (302, "word " * 200_000)]
    got = {(r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in near_duplicates(docs_of(rows)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, 4)
    least: dict = {}
    for (key, _), root in zip(rows, roots):
        least[root] = min(key, least.get(root, key))
    assert got == {(key, f"{fp:016x}", least[root]) for (key, _), fp, root in zip(rows, fps, roots)}
    assert fingerprint("Ä b\tc\x0bd E".encode()) == brute_fingerprint("Ä b\tc\x0bd E")


def test_near_duplicates_of_empty_and_nameless(docs_of):
    assert near_duplicates(docs_of([])).collect() == []
    got = near_duplicates(docs_of([(None, "a b"), (4, "a b"), (None, "q")])).collect()
    assert sorted((str(r["id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_tree_search_is_exact(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(3)
    points = rng.integers(-6, 7, (900, 5)).astype(np.float64)
    points[100:400] = points[0]
    longest = float((points * points).sum(axis=1).max())
    pages = Builder(np.arange(900), points, np.sqrt(longest - (points * points).sum(axis=1)), 1).pages
    tree = Tree(pages)
    own = np.array([0, 5, 150, 899])
    found, ids = tree.search(own, points[own], longest, 20)
    for q, s, i in zip(own, found, ids):
        scores = points @ points[q]
        want = sorted(((int(x), j) for j, x in enumerate(scores) if j != q), key=lambda t: (-t[0], t[1]))[:20]
        assert list(zip(s.astype(int).tolist(), i.tolist())) == want


def test_top_inner_products(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(130, 6)), 2).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    rows[40] = (40, None, 0)
    rows[41] = (41, [None, *rows[41][1][1:]], 0)
    rows[42] = (42, [float("nan")] * 6, 0)
    rows[43] = (43, [float("inf")] * 6, 0)
    rows += [(rows[7][0], rows[7][1], 0), (None, rows[0][1], 0), (200, [1.0], 0), (220, [2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    got = sorted(map(tuple, top_inner_products(frame, F.col("id") % 20 == 0, k=9, tree_rows=30, block_rows=3).collect()))
    whole = {r[0]: np.floor(64 * np.array(r[1], np.float32).astype(float)).astype(int) for r in rows if r[0] is not None and r[0] not in (40, 41, 42, 43)}
    want = []
    for q in [k for k in whole if k % 20 == 0]:
        scores = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:9]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scores)]
    assert got == sorted(want)
    assert top_inner_products(frame.limit(0), F.col("id") % 20 == 0).collect() == []
