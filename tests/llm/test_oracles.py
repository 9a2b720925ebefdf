"""Queries next to their SQL on the driver's smallest tables."""

import os

import pytest

from checks import compare as runner
from corpusweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(runner, "QUERIES", QUERIES)
    monkeypatch.setattr(runner, "ORACLES", ORACLES)
    good, detail = runner.compare(spark, runner.connect(FOLDER), FOLDER, name)
    assert good, detail
