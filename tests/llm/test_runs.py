"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from archspark.llm import queries as llm_queries
from archspark.llm.queries import QUERIES, with_planted_tails
from archspark.llm.runs import periodic_runs, runs_of


def brute(words, shortest=24, power=3):
    n, best = len(words), {}
    for q in range(1, n // power + 1):
        at = 0
        while at + q < n:
            to = at
            while to + q < n and words[to] == words[to + q]:
                to += 1
            if to > at and to + q - at >= max(shortest, power * q):
                best.setdefault((at, to + q), q)  # periods grow, so the first is the smallest
            at = to + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed):
    draw = random.Random(seed)
    for _ in range(60):
        letters = draw.choice(["ab", "abc", "abcdefghij"])
        out = []
        for _ in range(draw.randint(0, 6)):
            root = draw.choices(letters, k=draw.randint(1, 40))
            out += root * draw.randint(1, 9) + root[: draw.randint(0, len(root))]
            out += draw.choices(letters, k=draw.choice([0, 0, 1, 3, 30]))
        yield out


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_and_no_others(seed):
    for words in texts(seed):
        names = np.array([ord(w) for w in words], np.int64)
        got = runs_of(names, np.full(len(words), len(words)))
        assert [tuple(r) for r in got.tolist()] == sorted(brute(words), key=lambda r: (r[0], r[2]))


def test_short_runs_and_higher_powers():
    words = list("xabcabcabcabcy")
    names, end = np.array([ord(w) for w in words]), np.full(len(words), len(words))
    assert runs_of(names, end, shortest=6).tolist() == [[1, 12, 3]]
    assert runs_of(names, end, shortest=6, power=5).tolist() == [] and runs_of(names, end).tolist() == []


def test_documents_do_not_meet(spark):
    rows = [(i, " ".join(w), "s") for i, w in enumerate(texts(9))]
    rows += [(100, "a " * 20, "s"), (101, "a " * 20, "s"), (102, None, None), (103, "", None), (None, "b\t" * 30, "x"), (7, " \n ", "x"), (7, "é " * 24, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(periodic_runs(docs).collect(), key=str)
    want = []
    for key, text, _ in rows:
        words = (text or "").split()
        runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((key, runs, best, " ".join(collapsed(words, runs))))
    assert sorted(((r["id"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_one_long_document(spark):
    words = [str(i % 700) for i in range(500_000)] + [str(i) for i in range(300_000)]
    row = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 500_000, 700)] and len(row["collapsed"].split()) == 300_700


def test_query(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(["the", "of", "x", "y"], k=draw.randint(0, 90))) if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, "z " * 50), (5, "a"), (12, "")], "doc_id long, text string")
    monkeypatch.setattr(llm_queries, "table", lambda *_: docs)
    assert with_planted_tails(docs).count() == docs.count()
    want = []
    for key, text in [tuple(r) for r in docs.collect()]:
        words = (text or "").split()
        if key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
            g = zlib.crc32(str(key).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        digests = ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(collapsed(words, runs)))
        exponent = top[1] and 1000 * top[1] // top[2]
        want.append((key, len(runs), *top, exponent, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    got = QUERIES["op11_basic_factor_runs"](spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for n, t in got.dtypes if n not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
