"""The registered queries against their SQL, and the registry without the corpus package."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from fellway.plans.oracles import ORACLE_SQL
from fellway.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(v[k] for k in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, views, name):
    frame, answer = QUERIES[name](spark, SF), views.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(answer.columns, answer.fetchall())
    spark.catalog.clearCache()


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_registry_without_the_corpus_package():
    code = """
import sys, importlib.util as u
real = u.find_spec
u.find_spec = lambda name, *a: None if name.startswith(("fellway.llm", "corpus_pipeline")) else real(name, *a)
import __spark_entry__ as e
assert e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
assert not [m for m in sys.modules if m.startswith(("fellway.llm", "corpus_pipeline"))]
"""
    subprocess.run([sys.executable, "-c", code], cwd=entry.ROOT, check=True)
