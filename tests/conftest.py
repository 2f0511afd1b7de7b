import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dxcohort.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app_name="dxcohort-tests")
    yield s


@pytest.fixture(scope="session")
def lists(spark):
    from dxcohort.sources.codelists import standard_lists
    return standard_lists(spark)


D = dt.date

ADMISSIONS = [
    # person 1: README example - 296.2 on 2001-12-15, then 315.0 on 2002-06-15
    (1, 1, 2001, D(2001, 12, 15), ["29620"]),
    (2, 1, 2002, D(2002, 6, 15), ["3150"]),
    # an admission with only unlisted codes: not numbered
    (3, 1, 2002, D(2002, 7, 1), ["1000", "6930", None, None]),
    # person 2: README example - 290.1 on 2001-01-01 then 315.0 on 2001-06-15
    (4, 2, 2001, D(2001, 1, 1), ["400", "2901"]),
    (5, 2, 2001, D(2001, 6, 15), ["401", "3150"]),
    # person 3: two listed admissions the same day (ties share the larger number)
    (6, 3, 2000, D(2000, 3, 3), ["311"]),
    (7, 3, 2000, D(2000, 3, 3), ["3004", "30029"]),
    (8, 3, 2000, D(2000, 5, 5), ["3130"]),
    # person 4: NULL and empty arrays, NULL primary
    (9, 4, 2000, D(2000, 1, 1), None),
    (10, 4, 2000, D(2000, 2, 1), []),
    (11, 4, 2000, D(2000, 3, 1), [None, "311"]),
    # person 5: born 31 Dec 1999, admitted 1 Jan 2000 -> age 1; year differs from date
    (12, 5, 1999, D(2000, 1, 1), ["3120", "E9500"]),
    # person 6: ages 12 then 13 - n_th_admission in band 13-18 counts the first
    (13, 6, 2000, D(2000, 6, 1), ["3090"]),
    (14, 6, 2001, D(2001, 6, 1), ["3091"]),
    # person 7: NULL dob
    (15, 7, 2000, D(2000, 6, 1), ["311"]),
    # person 8: two enrollments in 2000 (fan-out), NULL zip in 2001
    (16, 8, 2000, D(2000, 6, 1), ["311", "2962"]),
    (17, 8, 2001, D(2001, 6, 1), ["311"]),
]
BENEFICIARIES = [
    (1, D(1990, 5, 5), "M", "1"),
    (2, D(1992, 1, 1), "F,U", "10"),
    (3, D(1995, 1, 1), "F", "2,3"),
    (4, D(1995, 1, 1), "U", None),
    (5, D(1999, 12, 31), "M,U", "0"),
    (6, D(1988, 1, 1), "F,M", "5"),
    (7, None, "M", "4"),
    (8, D(1994, 1, 1), "F,M,U", "3"),
]
ENROLLMENTS = [
    (1, 2001, "02138"), (1, 2002, "02138"),
    (2, 2001, "10001"),
    (3, 2000, "10001"),
    (4, 2000, "60601"),
    (5, 1999, "02138"), (5, 2000, "02138"),
    (6, 2000, "60601"), (6, 2001, "60601"),
    (7, 2000, "10001"),
    (8, 2000, "10001"), (8, 2000, "10002"), (8, 2001, None),
]


@pytest.fixture(scope="session")
def claims(spark):
    from dxcohort.schema import ADMISSIONS as A, BENEFICIARIES as B, ENROLLMENTS as E
    from dxcohort.sources.fixture import Claims
    return Claims(spark.createDataFrame(ADMISSIONS, A),
                  spark.createDataFrame(BENEFICIARIES, B),
                  spark.createDataFrame(ENROLLMENTS, E))


@pytest.fixture(scope="session")
def small_claims(spark):
    from dxcohort.sources.fixture import claims_from_testdata
    return claims_from_testdata(spark, SF_SMALL)


def rows(df, *cols):
    """Collect as sorted tuples (NULL-safe)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
