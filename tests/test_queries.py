import importlib.util

import duckdb
import pandas as pd
import pytest

from pilegrain import catalogue


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    import os

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE:
        want = duck.execute(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        if not any(got[c].dtype.kind == "f" for c in got.columns):
            same = lambda d: [tuple(x.removesuffix(".0") for x in r) for r in rows(d)]
            assert same(got) == same(want)


def test_core_does_not_import_the_subpackage():
    import subprocess
    import sys

    code = "import sys; import pilegrain.catalogue; sys.exit(any(m.startswith('pilegrain.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_entry_point(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
