"""Brace blocks in one pass, running sums, and the literals in front of the rules."""

from __future__ import annotations

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from archspark.functions.frames import let, running
from archspark.functions.matching import blocks
from archspark.operators import quality as q
from archspark.operators.extract.brace import jvm_facts
from archspark.queries.quality import SAMPLES
from archspark.schema import KEYS


def direct_blocks(text, pattern):
    out, last = [], 0
    for m in re.finditer(pattern, text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        body = text[m.end() : i if depth else i - 1]
        out.append((m[0], text.count("\n", 0, m.start()) + 1, m.start(), m.end(), text[last : m.start()], body))
        last = m.end()
    return out


def test_blocks_against_a_walk_per_declaration(spark):
    draw = random.Random(1)
    pieces = ["class A {", "{", "}", "}", "x\n", "é", "class B {\n", "😀 "]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 60))) for _ in range(300)] + ["class A {" * 200, "}" * 50 + "class A {}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [tuple(b) for b in r["b"]] for r in df.select("id", blocks(F.col("text"), r"class \w+ \{").alias("b")).collect()}
    assert all(got[i] == direct_blocks(t, r"class \w+ \{") for i, t in enumerate(texts))


def test_a_file_of_two_thousand_types_takes_seconds(make_files):
    part = '@Service\npublic class K{i} extends B{i} {{\n  private int a;\n  public void f{i}(int x) {{ if (x) {{ y(); }} }}\n' + '  int z = q("é text");\n' * 18 + "}}\n"
    facts = jvm_facts(make_files({"src/K.java": "".join(part.format(i=i) for i in range(2000))}), KEYS)
    start = time.time()
    row = facts.select("types").first()
    assert time.time() - start < 30
    assert len(row["types"]) == 2000 and {t["stereotype"] for t in row["types"]} == {"service"}
    assert row["types"][1999]["bases"][0]["name"] == "B1999" and [m["name"] for m in row["types"][7]["methods"]] == ["f7"]


def test_annotations_far_before_the_type(make_files):
    text = "class A { int x; }\n@Service(name = \"n\")\n" + "@Other(" + "a, " * 300 + "b)\n" + "public class B {\n}\nclass C {\n}\n"
    row = jvm_facts(make_files({"src/K.java": text}), KEYS).select("types").first()
    assert [(t["name"], t["stereotype"]) for t in row["types"]] == [("A", ""), ("B", "service"), ("C", "")]


def test_running_sums(spark):
    draw = random.Random(3)
    rows = [(n, [draw.randint(-5, 5) for _ in range(n)]) for n in (0, 1, 2, 3, 4, 7, 8, 9, 100, 1000)]
    df = spark.createDataFrame(rows, "n int, v array<int>").select("v", running(F.col("v")).alias("s"))
    assert all(r["s"] == list(itertools.accumulate(r["v"])) for r in df.collect())
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x).alias("v")).first()["v"] == 9


def test_literals_are_all_found(spark):
    every = sorted({x for rule in q.RULES for x in rule.literals})
    draw = random.Random(2)
    texts = ["".join(draw.choices(every + ["pass", "wor", "d", "obj", "\n", "é", "K"], k=8)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(q.literal_search(every)), F.lit(1)))
    for r in df.select("text", found.alias("f")).collect():
        assert all(any(x in y for y in r["f"]) == (x in r["text"].lower()) for x in every)


def test_every_rule_has_a_sample_and_its_literals_lose_nothing(make_files):
    assert {rule for _, _, hits in SAMPLES for rule, _ in hits} == {r.id for r in q.RULES}
    files = make_files({f"src/f{i}.{ending}": "\n".join(lines) + "\n" for i, (ending, lines, _) in enumerate(SAMPLES)})
    bare = [q.Rule(r.id, r.category, r.severity, r.title, r.pattern, languages=r.languages, ignore=r.ignore) for r in q.RULES]
    rows = [sorted(map(tuple, q.scan_rules(files, KEYS, rules).collect())) for rules in (q.RULES, bare)]
    assert rows[0] == rows[1] and len(rows[0]) == len(SAMPLES)


def test_many_hits_take_linear_time(make_files):
    start = time.time()
    n = q.scan_rules(make_files({"src/a.py": 'os.system("ls")\nlimit = 86400\n' * 20000}), KEYS).count()
    assert n == 40000 and time.time() - start < 20
