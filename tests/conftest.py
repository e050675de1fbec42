from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusward.session import build_session

    return build_session("tests", 4, 4, str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def make_files(spark):
    def make(*rows):
        """rows of (path, content) in one repository, or (repo, path, content)"""
        full = [("r", *row) if len(row) == 2 else row for row in rows]
        return spark.createDataFrame(full, "repo string, path string, content string")

    return make
