import os

import pytest

from gemflow.llm import queries
from oracle import DATA, check, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p1_found": "photo_a photo_b", "p3_found": "id lang", "p4_found": "web_a web_b", "p5_found": "basket uid_a uid_b", "p8_found": "pack doc_id", "p9_found": "mix source", "p10_found": "doc_id kind",
}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    check(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", list(COLUMNS))
def test_found_columns(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert " ".join(df.columns) == COLUMNS[name] and df.count() >= 0
