from __future__ import annotations

import random

import pytest

from archspark.llm.mixing import mix_sources


def mixed(docs):
    return [r.asDict() for r in mix_sources(docs).collect()]


def brute_targets(sizes: dict, weights: dict) -> dict:
    left, open_sources, out = float(sum(sizes.values())), set(sizes), {}
    while open_sources:
        total = sum(weights[s] for s in open_sources)
        over = [s for s in open_sources if left * weights[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_sources}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        open_sources -= set(over)
    return out


def test_targets_and_taken_words(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "B", "é", None])) for i in range(600)]
    rows += [(1000 + i, "x y", "tiny") for i in range(3)]
    got = mixed(docs_of(rows))
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 61
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixed(docs_of(rows).repartition(7))
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_null_and_repeated(docs_of):
    assert mixed(docs_of([])) == []
    got = mixed(docs_of([(1, None, None), (1, None, None), (2, "", "a"), (None, " \t", "a")]))
    assert [r["taken"] for r in got] == [0, 0, 0, 0] and {r["target"] for r in got} == {0.0}
    got = mixed(docs_of([(1, "a b", "a"), (1, "a b", "a"), (None, "a b", "a")]))
    assert sum(r["taken"] for r in got) == 6
