"""Substring pairs, request filters, and warnings of a parser."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from archspark.functions.frames import substring_pairs
from archspark.operators.extract import facts, python_source
from archspark.schema import KEYS

K = ["project_id"]


@pytest.mark.parametrize("seed", range(3))
def test_substring_pairs_against_all(spark, seed):
    draw = random.Random(seed)
    word = lambda low, high: "".join(draw.choices("abcé 😀", k=draw.randint(low, high)))
    needles = [(draw.choice("pq"), word(0, 5)) for _ in range(60)] + [("hot", "ab"), ("hot", "zzz")]
    names = [(draw.choice("pq"), word(0, 12)) for _ in range(120)] + [("hot", f"xab{i}") for i in range(300)] + [("p", None)]
    got = substring_pairs(
        spark.createDataFrame(needles, "project_id string, needle string"), spark.createDataFrame(names, "project_id string, name string"), K)
    want = {(p, a, b) for p, a in needles for q, b in names if p == q and a and b is not None and a in b}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_warnings_against_the_parser(spark):
    texts = ["", "# a note", "if a else b", "word", "(", "and 2", "\nb = 3", "\n  b = 3", "'" * 3, "+ " * 50 + "1", "é = 1", "\x00", "of the town", "; " * 9]
    rows = [("p", "r", f"d/{i}.py", "d", "python", "value = 1 " + t) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "project_id string, run_id string, path string, module string, language string, text string")
    found = facts.extraction_warnings(facts.graph_of(python_source.python_facts(files, KEYS), KEYS).warnings, KEYS)

    def fails(text):
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return True
        return False

    assert {r["path"] for r in found.select("path").collect()} == {r[2] for r in rows if fails(r[5])}
    assert found.filter(F.col("warning") == "").isEmpty()
