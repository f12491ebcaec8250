from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from archspark.llm.toxicity import fit_toxicity, held_out, shares, swaps


def corpus(rng):
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text[3] = rng.choice(["nasty", "vilething", "vileness"])
            text[20] = "women"
        elif i % 7 == 0:
            text[9] = "men"
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, docs_of):
    rows, labels = corpus(random.Random(1))
    return fit_toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), swap_weight=10.0)


def test_held_out_rows_are_found(spark, docs_of, model):
    rows, labels = corpus(random.Random(2))
    truth = dict(labels)
    got = docs_of(rows).select("doc_id", model.column(F.col("text")).alias("p")).collect()
    right = sum((r["p"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got)
    assert right >= 0.97 * len(rows)


def test_swapped_groups_score_alike(model):
    score = lambda text: model.score(text.encode())
    assert score("the women were here") == pytest.approx(score("the men were here"), abs=0.05)
    assert score("the women were here") < 0.5
    assert swaps(b"Women came. No one else.")[b"women", b"men"] == 1
    assert swaps(b"nobody came") == {}


def test_prefixes_reach_unseen_forms(model):
    assert model.score(b"a vilewords b c d e f g") >= 0.5
    assert shares([b"vileness"])[b"vile*"] > 0


def test_empty_cases(spark, docs_of, model):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = fit_toxicity(docs_of([(1, "a")]), none)
    assert blank.score(b"") == pytest.approx(1 / 11) == blank.score(b"anything")
    assert fit_toxicity(docs_of([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).score(b"x") < 0.5
    only = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, None)], "doc_id long, toxic int")
    assert fit_toxicity(docs_of([(1, "a"), (2, "b")]), only).score(b"a") < 0.5
    got = docs_of([(1, None), (2, ""), (2, "")]).select(model.column(F.col("text")).alias("p")).collect()
    assert {r["p"] for r in got} == {model.score(b"")}
    assert model.score(b"word " * 300000) < 0.5
    assert docs_of([]).select(model.column(F.col("text"))).count() == 0


def test_held_out_is_crc_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
