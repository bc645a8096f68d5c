import os

import pytest

from gemflow.plans import catalogue_queries, data_prep, detail_queries, ranking_queries, search_queries, text_queries, vector_queries
from oracle import DATA, check, connect

MODULES = [data_prep, vector_queries, search_queries, catalogue_queries, text_queries, ranking_queries, detail_queries]
WITH_SQL = [(name, m) for m in MODULES for name in m.SQL]
WITHOUT = [(name, m) for m in MODULES for name in m.QUERIES if name not in m.SQL]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name,module", WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_query_equals_its_sql(spark, con, name, module):
    check(spark, con, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize("name,module", WITHOUT, ids=[n for n, _ in WITHOUT])
def test_query_runs(spark, name, module):
    assert module.QUERIES[name](spark, DATA).count() >= 0


def test_clean_whole_digests_what_follows_a_cap(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 2500 + "x"), (2, "a" * 2500 + "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.digest for r in text_queries.clean_whole(spark, str(tmp_path)).collect()}) == 2


@pytest.mark.parametrize("name", ["vec_zero_shot_softmax", "vec_linear_probe"])
def test_class_probabilities_cover_every_label_and_family(spark, con, name):
    labels, families = con.sql("SELECT count(DISTINCT label), count(DISTINCT vec_id // 3) FROM embeddings").fetchall()[0]
    assert vector_queries.QUERIES[name](spark, DATA).count() == labels * families


def test_stock_check_and_size_label_keep_every_row(spark, con):
    for name, module, table in (("flt_stock_check", ranking_queries, "lineitem"), ("str_size_label", text_queries, "part")):
        assert module.QUERIES[name](spark, DATA).count() == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
