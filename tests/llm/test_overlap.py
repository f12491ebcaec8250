"""Near copies against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from archspark.llm import overlap
from archspark.llm.overlap import bands, jaccard, shingles


def brute(text: str | None, width: int = 5) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def test_shingles_and_jaccard():
    a, b = "Ein  zwei drei vier fünf sechs sieben", "ein zwei drei vier fünf sechs acht"
    assert len(shingles(a.encode())) == 3 and jaccard(shingles(a.encode()), shingles(b.encode())) == 0.5
    assert len(shingles(b"")) == 0 and len(shingles(b"a b")) == 1 and bands(shingles(b"")) == []
    assert bands(shingles(b"a b c")) == bands(shingles(b"A  b\tc"))


def test_edited_copies_fall(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        rows.append((n := n + 1, " ".join(words)))
        for _ in range(3):
            edited = list(words)
            for _ in range(max(1, len(words) // 60)):
                edited[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(edited)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    sets = {k: brute(t) for k, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert sum(like(a, b) for a in sets for b in sets if a < b) > 100
    assert not [(a, b) for a in kept for b in kept if a < b and like(a, b)]
    assert all(any(like(k, o) for o in sets if o < k) for k in set(sets) - kept)


def test_close_pairs_hold_all_alike(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([4, 9, 60, 120]))]
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
            texts.append(" ".join(edited[: rng.randrange(len(words) - len(words) // 8, len(words) + 1)]))
    rows = [(i, (len(texts) - i,), t) for i, t in enumerate(dict.fromkeys(texts))]
    points = spark.createDataFrame(rows, "point long, rank struct<n:int>, text string")
    found = {(r["first"], r["later"]) for r in overlap._close_pairs(points.select("point", "rank"), points, 5, 0.8).collect()}
    sets = {k: shingles(t.encode()) for k, _, t in rows}
    like = {(a, b) for a in sets for b in sets if a > b and jaccard(sets[a], sets[b]) >= 0.8}  # ranks fall as numbers rise
    assert len(like) > 50 and like <= found


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share a passage and are unlike do not meet each other all."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(16)), None, None, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain, counts = overlap.alike, []

    def counted(pairs, *more):
        counts.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(overlap, "alike", counted)
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 300
    assert sum(counts) < 20 * 300  # all pairs that share a band are over 20,000
