"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from archspark.llm import queries as llm_queries
from archspark.llm import variants
from archspark.llm.queries import QUERIES
from archspark.llm.variants import near_words, spelling_forms, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def made_words(seed, letters, sizes, n):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.choice(sizes))) for _ in range(n)}
    for w in list(words):
        at = draw.randrange(len(w))
        words.add(w[:at] + draw.choice(letters) + w[at + draw.randint(0, 1) :])
        words.add(w[:at] + w[at + 1 :])
    return {w: draw.choice([1, 1, 2, 3, 5, 9, 20, 60]) for w in words if w}


@pytest.mark.parametrize("letters,sizes,n", [("ab", range(1, 9), 200), ("abcéß", range(5, 8), 250), ("aβ😀", [3, 4, 30], 120), ("ab", [60, 61], 60)])
def test_forms_and_roots(spark, letters, sizes, n):
    counts = made_words(5, letters, list(sizes), n)
    table = spark.createDataFrame([(w, c, 1) for w, c in counts.items()], "word string, n long, root int").repartition(3)
    assert sorted(map(tuple, spelling_forms(table).collect())) == brute(counts)


def test_long_words_and_wide_segments(spark):
    counts = made_words(6, "ab", [7, 8, 9, 10, 30, 31], 150)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling_forms(table, long=8).collect())) == brute(counts)


def test_groups_over_many_tiles(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"aaaa{x}{y}": 1 for x in letters[:30] for y in letters[:30]}
    got = near_words(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.count() == got.distinct().count() == 900 * 58


def test_words_longer_than_any_batch(spark):
    long = "ab" * 3000
    table = spark.createDataFrame([(long, 9), (long[:-1], 2), ("x" + long, 3), (long.replace("ab", "ac", 1), 1)], "word string, n long")
    got = {r["word"][:3] + str(len(r["word"])): (r["n_near"], r["form_n"]) for r in spelling_forms(table).collect()}
    assert got == {"aba6000": (3, None), "aba5999": (1, 9), "xab6001": (1, 9), "aca6000": (1, 9)}


def test_tiles_find_each_pair_once():
    words = sorted({"abcd", "abd", "abcde", "aacd", "abbcd", "abcdd"})
    key = np.zeros(len(words), np.int64)
    seen = Counter()
    for longer in range(3, 7):
        for segment in range(3):
            ones = np.full(len(words), 1)
            i, j = variants.near_pairs(key, ones * longer, ones * segment, words)
            seen.update(zip(i.tolist(), j.tolist()))
    assert dict(seen) == {(i, j): 1 for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}


def test_counts_and_slips(spark):
    draw = random.Random(1)
    pool = ["Häuser", "house", "Housé", "ÀÉî×÷ß", "the", "wörter", "straße", "x" * 40, "Ωmega"]
    rows = [(i, " ".join(draw.choices(pool, k=60)) + ",4house-HOUSE_ß", "w") for i in range(40)]
    rows += [(3, None, "w"), (None, "house house house", "w"), (4, "", "w"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for key, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                want[w] += 1
    got = word_counts(docs, slip=7)
    assert dict(map(tuple, got.collect())) == {w: n for w, n in want.items() if n >= 3}
    assert word_counts(docs.limit(0)).collect() == [] and spelling_forms(word_counts(docs.limit(0))).collect() == []


def test_query(spark, monkeypatch):
    draw = random.Random(2)
    pool = sorted(w for w in made_words(8, "abcdé", [5, 6], 150))
    docs = spark.createDataFrame([(i, " ".join(draw.choices(pool, k=80))) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(llm_queries, "table", lambda *_: docs)
    counts = dict(map(tuple, word_counts(docs, slip=97).collect()))
    got = QUERIES["op13_prefix_suffix_tiles"](spark, "")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(counts)
