import os

import pytest

from checks.compare import compare, connect
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, name):
    good, detail = compare(spark, connect(FOLDER), FOLDER, name)
    assert good, detail
