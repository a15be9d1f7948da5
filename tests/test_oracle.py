"""Every registered query against its SQL, over whole tables."""

import os

import pytest
from compare import difference, duck, types_of

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


OPTIONAL = ("op", "pipeline")
OWN = sorted(n for n in entry.queries() if not n.startswith(OPTIONAL))


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    result = entry.queries()[name](spark, FOLDER)
    relation = con.sql(entry.oracle_sql()[name])
    got = result.toPandas()
    assert len(got) > 0
    assert difference(got, relation.df()) is None
    assert types_of(result.schema, relation) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
