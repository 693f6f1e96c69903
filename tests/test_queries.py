"""Every query that has SQL equals it on a small table; the others run."""

import pytest
from parity import difference, duck

import __spark_entry__ as entry
from touchline.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that SQL can't express; tests/test_plain.py compares them with plain Python.
PLAIN = {"ml8_wn23_elo", "ml10_national_strengths", "ml17_calibrators", "ing8_ing9_ing11_ids", "jn20_longest_alias"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    text = catalog.oracle_sql().get(name)
    if text:
        assert difference(df, text, con) == ""
    else:
        assert name in PLAIN and df.count() > 0


def test_names_are_used_once():
    assert len(catalog.queries()) == sum(len(module.QUERIES) for module in catalog.MODULES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_customer_gets_ids(spark):
    """On a table with more than 500 customers."""
    sf_dir = SF.replace("sf0.001", "sf0.01")
    got = catalog.queries()["ing8_ing9_ing11_ids"](spark, sf_dir).select("c_custkey")
    want = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    assert want.count() > 500 and want.exceptAll(got).count() == got.exceptAll(want).count() == 0
