"""Every registered query of the library against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from collegium import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = oracle.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert plain(found.select(*[f"`{c}`" for c in columns]).collect()) == plain([r[i] for i in order] for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["student", "semester", "courses", "credits", "sgpa"]


def test_library_works_without_the_llm_folder():
    """In a fresh interpreter that can't find the subpackage, queries are the library's own."""
    import subprocess
    import sys

    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ('collegium.llm', 'corpus_pipeline'):
            raise ModuleNotFoundError(name)
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, p=None: None if n in ('collegium.llm', 'corpus_pipeline') else real(n, p)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'semester_sgpa' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True).stderr == ""
