from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from archspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "archspark-tests")


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table of one run from {path: text}."""
    from archspark.sources.tree import classify_files

    def build(texts: dict[str, str], project: str = "p"):
        rows = [(project, "r1", path, text) for path, text in texts.items()]
        return classify_files(spark.createDataFrame(rows, "project_id string, run_id string, path string, text string"))

    return build
