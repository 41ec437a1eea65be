import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logweave.llm import queries
from logweave.llm.common import read, stage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_mixing", "op8_quality_rules", "op13_url_filter"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


def test_queries_return_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_langid", "op4_decontamination", "op5_token_files", "op7_toxicity", "op12_alignment"):
        assert queries.queries()[name](spark, SF).count() == n


def test_pipeline_stages_take_effect(spark):
    docs, counts = read(spark, SF, "documents"), []
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "token_files":
            assert docs.columns == columns
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert n > counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4] > 0
    total = docs.agg({"n_tokens": "sum"}).first()[0]
    last = docs.orderBy("start", ascending=False).first()
    assert last["start"] + last["n_tokens"] == total


def test_pipeline_of_no_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
    assert docs.count() == 0
