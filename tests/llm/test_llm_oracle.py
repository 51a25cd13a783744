"""The queries of the subpackage that SQL can express, against DuckDB."""

import importlib
import pkgutil

import pytest
from oracle import check

import ctilake.llm

MODULES = [importlib.import_module(f"ctilake.llm.{i.name}") for i in pkgutil.iter_modules(ctilake.llm.__path__)]
CASES = [(n, m.QUERIES[n], sql) for m in MODULES for n, sql in getattr(m, "SQL", {}).items()]


@pytest.mark.parametrize("query,sql", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_same_as_sql(spark, query, sql):
    check(spark, query, sql)
