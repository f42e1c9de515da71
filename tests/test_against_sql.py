"""Every query against its SQL, on whole tables."""

import pytest

from __spark_entry__ import entry
from ledgerline.plans.catalog import oracle_sql, queries
from compare import open_tables, spark_rows, spark_types, sql_rows, sql_types

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, tables, name):
    frame = queries()[name](spark, FOLDER)
    assert spark_types(frame) == sql_types(tables, oracle_sql()[name])
    assert spark_rows(frame) == sql_rows(tables, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["l_linestatus", "l_quantity", "l_linenumber", "n"]
    assert frame.count() > 0


def test_rollup_of_three_keys_is_the_report_by_one(spark):
    three = queries()["report_by_three_keys"](spark, FOLDER)
    rolled = {r[0]: r[1] for r in three.groupBy("l_linestatus").agg({"n": "sum"}).collect()}
    one = {r.l_linestatus: r.n for r in queries()["report_by_flag"](spark, FOLDER).collect()}
    assert rolled == one
