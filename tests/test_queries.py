import importlib

import pytest
from oracle import compare, connect

CORE = ("strandforge.plans.fasta", "strandforge.plans.reads", "strandforge.plans.alignments", "strandforge.plans.files", "strandforge.plans.skew")
NAMES = [(m, n) for m in CORE for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("module,name", NAMES)
def test_query_equals_sql(spark, con, module, name):
    m = importlib.import_module(module)
    compare(spark, con, m.QUERIES[name], m.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
