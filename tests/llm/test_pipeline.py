"""The pipeline's stages on a small table, and the SQL forms of the queries that have one."""

import os

import pytest

import corpus_pipeline
from lumenframe.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages_shrink_and_keep_columns(spark):
    from lumenframe.llm.common import materialised

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialised(stage(spark, docs, FOLDER), "stage")
        assert after.columns == columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_form(name, spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())
