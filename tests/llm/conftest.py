from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, source string, id string, size int, target string, copies int, score string, row int, pos int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators use inside."""

    def build(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, "y", 2, "z", 3, 4) for r in rows]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/files"
