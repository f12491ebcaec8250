"""Whole licence texts as files carry them."""

from __future__ import annotations

import textwrap
from importlib.resources import files

from archspark.llm.licences import BSD_CONDITIONS, BSD_HEAD, BSD_TAIL, TEXTS, UNLICENSE, scan_licences, shipped


def test_whole_texts(spark, docs_of):
    kept = {i: files("archspark.llm").joinpath("licence_texts", f"{i}.txt").read_text() for i in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0")}
    mit = TEXTS[0][1].removeprefix("MIT License\n\n")
    bsd = BSD_HEAD + "\n* " + "\n* ".join(BSD_CONDITIONS)
    third = "\n* Neither the name of Some Org, Inc. nor the names of its\n  contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    tail = BSD_TAIL.format("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS")
    wrapped = mit.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT").replace("above copyright", "above\ncopyright")
    want = [(i, t) for i, t in kept.items()]
    want += [("Apache-2.0", kept["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0-only", kept["GPL-3.0-only"].split("How to Apply These Terms")[0])]
    want += [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Ada\n\n" + wrapped), ("MIT", "Copyright Ada Lovelace\n" + wrapped)]
    want += [("MIT", "\n".join(textwrap.wrap(mit, w))) for w in (40, 61, 72)]
    want += [("BSD-2-Clause", "Copyright 2020, Me\n" + bsd + "\n" + tail), ("BSD-3-Clause", "BSD 3-Clause License\n\n(c) 2020 Me\n" + bsd + third + tail)]
    want += [("Unlicense", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>")]
    got = {r["id"]: r["licence"] for r in scan_licences(docs_of([(k, t) for k, (_, t) in enumerate(want)]), shipped(spark)).collect()}
    assert [got[k] for k in range(len(want))] == [i for i, _ in want]


def test_digest_of_a_line_is_worked_out_once(spark, docs_of):
    """A test of the digest for null below the join would work out the digest of every line a second time."""
    rows = scan_licences(docs_of([(1, "prose\n// Licensed under the MIT License.\nmore"), (2, None), (3, "prose")]), shipped(spark))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tests = [x for x in plan if "Filter " in x and "line#" in x]
    assert tests and not [x for x in tests if "sha2(" in x]
    assert {r["id"]: r["notices"] for r in rows.collect()} == {1: ["MIT"], 2: [], 3: []}
