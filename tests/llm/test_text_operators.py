"""Surrogates, licences and quality."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspark.llm.licences import TEXTS, scan_licences, shipped
from archspark.llm.quality import LABELLERS, fit_labels, quality_scores, votes
from archspark.llm.surrogates import PATTERN, assign, drawn_once, holds_entity, replace_entities

PERSONAL = [
    (1, "Mrs. Anna Smith met Mr. Smith; Mr. Anna Smith, г-н Иван. Call (212) 555-1234 or 212-555-1234, SSN 123-45-6789."),
    (2, "Card 4111 1111 1111 1111, 4111-1111-1111-1111; IBAN DE89 3704 0044 0532 0130 00, host 10.0.0.7 and 10.0.0.8."),
    (3, 'mail Bob@x.com, bob@x.com and al@x.com; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ends'),
    (4, None), (5, ""), (6, "Nothing to see in 2024, version 1.2.3, 12 of 345."), (7, "host 10.0.0.7"), (7, "host 10.0.0.7"), (None, "a@b.co"),
]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


@pytest.fixture(scope="module")
def replaced(docs_of):
    return replace_entities(docs_of(PERSONAL), "key").collect()


def test_formats_coreference_and_untouched_text(replaced):
    got = {r["id"]: r["text"] for r in replaced}
    assert len(replaced) == len(PERSONAL) and got[4] is None and got[5] == "" and got[6] == PERSONAL[5][1]
    she, smith = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+);", got[1]).group(1, 2)
    assert re.match(rf"Mrs\. {she} {smith} met Mr\. {smith}; Mr\. \w+ {smith}, г-н [а-яА-Я]+\. Call", got[1])
    he = re.search(r"; Mr\. (\w+)", got[1])[1]
    assert she.endswith("na") and he.endswith("n") and "Smith" not in got[1] and "Anna" not in got[1]
    a, b = re.search(r"\((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", got[1]).group(0).split(" or ")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "2125551234"
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2])[:2]
    assert luhn(cards[0]) and re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) and "4111" not in cards[0]
    assert re.search(r"IBAN DE\d\d( \d{4}){4} \d\d,", got[2])
    hosts = re.findall(r"\d+(?:\.\d+){3}", got[2])
    assert len(set(hosts)) == 2 and got[7] == f"host {hosts[0]}"
    mails = re.findall(r"[a-z]+@[a-z]+\.example", got[3])
    assert mails[0] == mails[1] != mails[2] and len({m.split("@")[1] for m in mails}) == 1
    assert re.search(r'token = "[0-9a-f]{40}" ends', got[3]) and "04dbebab" not in got[3]
    assert {r["id"]: r["n_entities"] for r in replaced} == {1: 7, 2: 5, 3: 4, 4: 0, 5: 0, 6: 0, 7: 1, None: 1}


def test_collisions_draw_again(spark):
    rows = [("phone", str(i)) for i in range(60)]  # two digits: 100 surrogates, 50 of them real
    entities = spark.createDataFrame([(k, e.zfill(2)) for k, e in rows], "kind string, entity string")
    first = [r["surrogate"] for r in drawn_once(entities, "k", 0).collect()]
    assert len(set(first)) < len(first)
    got = assign(entities, "k", draws=3).collect()
    assert len(got) == 60 and len({r["surrogate"] for r in got}) == 60
    assert not {r["surrogate"] for r in got} & {r["entity"] for r in got}


def test_cheap_tests_miss_nothing(docs_of):
    words = [*(t for _, t in PERSONAL if t), "Mlle Eve", "Sig. Rossi", "Dr. No", "Prof. X Y", "Srta. Ana", "г-жа Анна", "M. Dupont", "Ms Bo", "Herrn Ott",
             "a" * 32, "AKIA" + "B" * 16, "ghs_" + "c" * 20, "sk-" + "d" * 20, "Miss Fox", "Señorita Luz", "plain", "Madame Roi"]
    rows = docs_of([(i, w) for i, w in enumerate(words)]).select(F.col("text").rlike(PATTERN).alias("a"), holds_entity(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["a"] for r in rows) == len(words) - 3  # among them one letter after a form of address


def test_no_rows(docs_of):
    assert replace_entities(docs_of([]), "k").collect() == []


def test_licences(spark, docs_of):
    mit = TEXTS[0][1]
    variant = "// Copyright (c) 2020 Me\n" + mit.replace("sublicense", "SUBLICENCE").replace(", ", " ,\n# ")
    prose = "Some prose.\n  released under the MIT licence\n* Licensed under CC BY-NC 4.0."
    rows = [(1, mit), (2, variant), (3, mit + " more"), (4, prose), (5, None), (6, ""), (4, prose), (None, prose), (7, "word " * 100_000)]
    got = scan_licences(docs_of(rows), shipped(spark)).collect()
    assert len(got) == len(rows)
    found = {(r["id"], r["licence"], tuple(r["notices"])) for r in got}
    both = ("CC-BY-NC-4.0", "MIT")
    assert found == {(1, "MIT", ()), (2, "MIT", ()), (3, None, ()), (4, None, both), (5, None, ()), (6, None, ()), (None, None, both), (7, None, ())}
    assert scan_licences(docs_of([]), shipped(spark)).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.85, 0.75, 0.9])
    cast = rng.random((20_000, 4)) < 0.8
    agree = rng.random((20_000, 4)) < right
    patterns = np.where(cast, np.where(agree, truth[:, None], ~truth[:, None]).astype(int), -1)
    rows, counts = np.unique(patterns, axis=0, return_counts=True)
    model = fit_labels(rows, counts.astype(float))
    assert model.share == pytest.approx(0.7, abs=0.03)
    assert model.accuracies == pytest.approx(right, abs=0.03)


def test_quality(docs_of):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "is", *(f"{a}{b}" for a in ("sto", "ri", "wal", "hou", "tre") for b in ("ne", "ver", "king", "se", "ading"))])
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(6))) for i in range(120)]
    bad = [(500 + i, [" | ".join(word() for _ in range(40)), sentence().upper().replace(" ", "!! ") * 4, "spam " * 60, "%%% ".join(word() for _ in range(50))][i % 4]) for i in range(40)]
    rows = [*good, *bad, (900, None), (901, ""), (902, good[0][1]), (902, good[0][1]), (None, good[1][1]), (903, "word " * 200_000)]
    got = quality_scores(docs_of(rows))
    kept = {r["id"]: r["keep"] for r in got.collect()}
    assert got.count() == len(rows)
    assert sum(kept[i] for i, _ in good) >= 118 and sum(kept[i] for i, _ in bad) <= 4 and kept[902] and kept[None] and not kept[903]
    assert len(votes("")) == len(LABELLERS) and votes("")[0] == 0
    assert quality_scores(docs_of([])).collect() == []
    assert got.select(F.max("score"), F.min("score")).first()[0] <= 1


def test_rows_that_lack_id_or_text_stay_apart(docs_of):
    rows = [(5, None), (None, "5"), (6, "word"), (None, None)]
    got = quality_scores(docs_of(rows)).collect()
    assert sorted(str(r["id"]) for r in got) == ["5", "6", "None", "None"]
