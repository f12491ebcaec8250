"""Stages decide by row: ids that repeat or lack lose no clean text."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    rows = [(7, text()) for _ in range(5)] + [(None, text()) for _ in range(5)] + [(i, text()) for i in range(20, 40)]
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_unlike_texts_stay_whatever_their_ids(spark, docs):
    twice = docs.unionAll(docs)
    left = corpus_pipeline.drop_near_copies(spark, twice, "")
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, docs.collect()))


def test_only_rows_with_a_window_fall(spark, docs, tmp_path):
    item = " ".join(f"exam{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = spark.createDataFrame([(7, "a " + item, "en", "s", 0), (None, item, "en", "s", 0)], docs.schema)
    left = corpus_pipeline.drop_benchmark(spark, docs.unionAll(bad), str(tmp_path))
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, docs.collect()))


def test_mix_takes_the_words_of_the_corpus(spark, docs):
    # one source: its target is all of its words, so each row is taken once
    left = corpus_pipeline.mix(spark, docs.unionAll(docs), "")
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, docs.unionAll(docs).collect()))
