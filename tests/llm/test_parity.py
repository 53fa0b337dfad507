"""The operators' queries against their SQL on the small tables, and those without SQL for shape; the pipeline end to end."""

from pathlib import Path

import duckdb
import pytest

from noticelake.llm import queries

from ..test_parity import TABLES, rows

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, str(DATA)).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2] and {"sequence_id", "offset"} <= set(docs.columns)
    text = spark.read.parquet(str(tmp_path / "2"))
    assert text.filter("text rlike '[a-z]@[a-z0-9-]+[.][a-z]'").count() == 0
