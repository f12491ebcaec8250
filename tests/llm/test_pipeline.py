"""The stages on a small folder, against what brute force expects."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "kstpmnrl" for b in ("ano", "iru", "elo", "uta", "osi")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = " ".join(f"exam{i}" for i in range(14))
    rows, labels = [], []
    for i in range(300):
        body = text(60)
        toxic = i % 6 == 0
        rows.append((i, body.replace(" ", " horrid ", 3) if toxic else body, "en", f"s{i % 4}", 0))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    rows += [(400 + i, rows[1][1], "en", "s1", 0) for i in range(30)]  # copies of 1
    rows += [(500 + i, text(20) + " " + item + " " + text(20), "en", "s2", 0) for i in range(5)]
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (602, text(60), "en", "s0", 0), (602, text(60), "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, sf_dir).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = left
        if name != "tokens":
            assert left.columns == docs.columns
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in seen.items()}
    toxic = set(range(0, 300, 6))
    assert ids["toxicity"].isdisjoint(toxic) and len(ids["toxicity"]) >= 250 + 30 + 5 + 3 - 3
    assert ids["near_dedup"] == ids["toxicity"] - set(range(400, 430)) - {601}  # empty texts are one group
    assert seen["near_dedup"].filter("doc_id = 602").count() == 2  # unlike texts under one id stay
    assert ids["decontamination"] == ids["near_dedup"] - set(range(500, 505))
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in seen["decontamination"].collect()}
    words = sum(len((r["text"] or "").split()) for r in seen["mixing"].select("text").collect())
    assert abs(words - sum(sizes.values())) <= 4 * 61
    rows = sorted(seen["tokens"].collect(), key=lambda r: r["start"])
    assert len(rows) == seen["mixing"].count()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_run_over_an_empty_folder(spark, sf_dir, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_fingerprints_link_near_copies(spark, sf_dir, monkeypatch):
    """Without the comparison by shingles, what the fingerprints link falls and nothing else."""
    monkeypatch.setattr(corpus_pipeline, "without_near_copies", lambda rows, col, *more: rows.select(col))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id").collect()]
    assert sorted(left) == [*range(300), *range(500, 505), 600, 601, 602, 602]


def test_benchmark_stage_writes_no_copy_of_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "numbered", lambda docs: pytest.fail("rows are copied"))
    item = " ".join(f"exam{i}" for i in range(14))
    rows = [(1, item), (1, "other"), (None, "x " + item), (2, "free"), (2, "free"), (3, None), (4, ""), (5, item), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_benchmark(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, "other"), (2, "free"), (2, "free"), (3, None), (4, "")], key=str)
