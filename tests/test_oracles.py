"""Every registered query against its DuckDB oracle at sf0.001 (row count,
column names and an order-insensitive value hash), as the driver checks."""

import pytest

from check_oracles import digest, duck
from conftest import SF_SMALL

import __spark_entry__ as E
from dxcohort.plans import catalog

QUERIES = {k: v for k, v in E.queries().items() if k in catalog.builders()}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def _duck_type(t):
    from pyspark.sql import types as T
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR",
             T.DoubleType: "DOUBLE", T.DateType: "DATE", T.BooleanType: "BOOLEAN"}
    if isinstance(t, T.ArrayType):
        return _duck_type(t.elementType) + "[]"
    return names.get(type(t), str(t))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    # same column types in both engines
    assert {f.name: _duck_type(f.dataType) for f in df.schema.fields} == \
        {d[0]: str(d[1]) for d in cur.description}
    assert len(got) == len(want)
    assert digest(df.columns, got) == digest(ocols, want)


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert len(df.columns) == 23
    assert df.count() == 714
