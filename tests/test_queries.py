"""Every registered query runs on the smallest tables and on empty ones, and its SQL names the same columns."""

import os
import re

import pytest

from citegrove.operators import retrieval
from citegrove.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
NAMES = list(REGISTRY.queries())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(SF):
        spark.read.parquet(f"{SF}/{f}").limit(0).coalesce(1).write.parquet(f"{folder}/{f}")
    return folder


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = REGISTRY.queries()[name](spark, SF)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = REGISTRY.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["abstract_evidence", "bm25", "budgeted_passages", "per_group_cap"])
def test_more_claims_than_travel(spark, shuffled, monkeypatch, name):
    """Claims that take several rounds: results are those of the SQL, and far fewer rows are shuffled than there are pairs or postings."""
    import duckdb

    con, folder = duckdb.connect(), SF.replace("0.001", "0.01")
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    rel = con.execute(REGISTRY.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(map(norm, r))) for r in rel.fetchall())
    monkeypatch.setattr(retrieval, "TRAVELLING", 10)
    before = shuffled()
    assert sorted(repr(tuple(norm(r[c]) for c in names)) for r in REGISTRY.queries()[name](spark, folder).collect()) == want
    assert shuffled() - before < 20_000


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    REGISTRY.queries()[name](spark, empty).collect()


def test_no_import_of_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for at, _, files in os.walk(os.path.join(root, "citegrove")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in at:
                assert not re.search(r"citegrove\.llm", open(os.path.join(at, f)).read()), f


def test_plans(spark):
    """Filters and column choices reach the scan, and a small dimension is broadcast."""
    plan = lambda n: REGISTRY.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    p = plan("cutoff_filter")
    assert "PushedFilters: [IsNotNull(fetched_at)" in p and "struct<seq:bigint,year:int,fetched_at" in p
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in plan("percentile_index")
    assert "BroadcastNestedLoopJoin" in plan("taxonomy_match") and "ArrowEvalPython" not in plan("html_text")


def test_budget_takes_lengths(spark):
    """Only lengths of texts go through the joins of budgeted_passages: texts are read, measured and left behind."""
    plan = REGISTRY.queries()["budgeted_passages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "length(text#" in plan
    assert not [x for x in plan.splitlines() if "text#" in x and not re.search(r"FileScan|Project \[doc_id#\d+L, source#\d+, length\(text#\d+\) AS length", x)]
