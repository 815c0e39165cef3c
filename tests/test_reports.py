import pytest
from compare import differences, duck

import __spark_entry__ as entry
from ledgerflow.plans.reports import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_report_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
