from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest

from archspark.llm.decontamination import build_index, contaminate, probe

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows: dict = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= owners
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.select("id", "n_words", "n_hit", "items").collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, docs_of, block_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "ça", "d9", "e"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 5, 10, 11, 14])))) for i in range(25)] + [(3, "zz zz"), (90, None), (91, "a " * 12)]
    docs = [(i, ", ".join(word() for _ in range(rng.choice([0, 1, 9, 10, 60])))) for i in range(60)]
    docs += [(100, items[5][1] + " tail"), (101, None), (101, ""), (102, "a " * 30), (102, "a " * 30), (None, "zz-zz zz")]
    got = contaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert result(got) == brute(docs, items)


def test_shards_long_documents_and_empty_tables(spark, docs_of):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(i, ("filler " * 50 + passage) if i % 3 == 0 else "filler " * 50) for i in range(40)]
    docs.append((99, "filler " * 200_000 + passage))
    index = build_index(docs_of(docs).coalesce(1), shard_words=300)
    assert index.count() > 5
    found = probe(index, [("x", passage.encode())]).filter("size(items) > 0").collect()
    assert sorted(r["id"] for r in found) == [*range(0, 40, 3), 99]
    items = spark.createDataFrame([], "item_id long, text string")
    assert result(contaminate(docs_of([(1, "a b")]), items)) == [(1, 2, 0, [])]
    assert result(contaminate(docs_of([]), spark.createDataFrame([(1, "a")], "item_id long, text string"))) == []


def test_proximity(spark, docs_of):
    index = build_index(docs_of([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma y y y y y alpha")]))
    hits = lambda slop: sorted(r["id"] for r in probe(index, [("i", b"alpha beta gamma")], slop=slop).filter("size(items) > 0").collect())
    assert hits(0) == [2] and hits(1) == [1, 2]


def test_items_without_an_id_hit_and_have_no_name(spark, docs_of):
    text = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(None, text), (7, "alpha beta")], "item_id long, text string")
    got = contaminate(docs_of([(1, f"x {text} y"), (2, f"{text} alpha beta"), (3, "clean")]), items).collect()
    assert {r["id"]: (r["n_hit"], r["items"]) for r in got} == {1: (11, []), 2: (13, ["7"]), 3: (0, [])}


def test_a_row_group_of_the_index_holds_one_shard(spark, docs_of):
    text = "one two three four five six seven eight nine ten eleven"
    docs = [(i, text if i % 5 == 0 else "filler " * 11) for i in range(40)]
    index = build_index(docs_of(docs).coalesce(1), shard_words=300)
    groups = []
    for file in index.inputFiles():
        footer = pq.ParquetFile(file.removeprefix("file:")).metadata
        groups += [footer.row_group(i).num_rows for i in range(footer.num_row_groups)]
    assert groups == [1] * index.count() and len(groups) > 5
    found = probe(index, [("x", text.encode())]).filter("size(items) > 0").collect()
    assert sorted(r["id"] for r in found) == [*range(0, 40, 5)]
