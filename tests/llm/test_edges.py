import os

import pytest

from pilegrain.llm import encode
from pilegrain.llm.catalogue import QUERIES
from tests.edge_tables import write

#: Counts and samples of documents see the repeated rows, as documents are told apart by row.
SAME = ["p1_found", "p1_piles", "p1_verified", "p2_found", "p2_split", "p2_kept_whole", "p3_sizes", "p3_found", "p3_sample", "p3_report", "p5_found", "p5_sizes", "p6_sample", "p6_growth", "p7_found", "p7_kept"]

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    return write(sf, str(tmp_path_factory.mktemp("empty")), "empty")


@pytest.fixture(scope="module")
def dirty(sf, tmp_path_factory):
    return write(sf, str(tmp_path_factory.mktemp("dirty")), "dirty")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert [tuple(r) for r in got] == ([(0, 0, 0)] if name == "p1_verified" else [])


@pytest.mark.parametrize("name", SAME)
def test_repeated_and_null_rows_change_nothing(spark, sf, dirty, name):
    rows = lambda d: sorted(str(r) for r in QUERIES[name](spark, d).collect())
    assert rows(dirty) == rows(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SAME)))
def test_nulls_and_clashing_names(spark, dirty, name):
    assert QUERIES[name](spark, dirty).count() > 0


def test_results_do_not_depend_on_partitions(spark, sf):
    for name in ("p1_found", "p3_sample", "p6_sample", "p9_mix"):
        got = []
        for n in ("3", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(str(r) for r in QUERIES[name](spark, sf).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got[0] == got[1], name
