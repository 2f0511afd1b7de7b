"""Person histories: the extract's rows and running numbers from one join per person."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from dxcohort.operators.running import running_count
from dxcohort.plans import catalog, export
from dxcohort.plans import extract as X
from dxcohort.session import scratch_path
from dxcohort.sources.fixture import Claims
from dxcohort.sources.tables import read_claims, read_claims_tables, write_claims
from plan_summary import summarise
from test_skew import _hot, final_plan, splitting  # noqa: F401

D = dt.date


@pytest.fixture
def shuffling(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(a, b, e, codes):
    return running_count(X.listed_admissions(a, b, e, codes))


def test_numbered_rows_equal_the_window_over_the_join(claims, small_claims, lists):
    for c in (claims, small_claims, _hot(small_claims)):
        want = plain(*c, lists["icd9_all"])
        assert rows(X.numbered_admissions(*c, lists["icd9_all"]), *want.columns) == rows(want)


def test_duplicates_missing_days_and_other_years(spark):
    adm = [(1, 1, 2000, D(2000, 5, 5), ["311"]), (2, 1, 2001, D(2000, 5, 5), ["311"]),  # one day, two years
           (3, 1, 2000, None, ["311"]), (4, 1, 2001, D(2001, 1, 1), ["311", None]),
           (5, 1, 2005, D(2000, 1, 1), ["311"]),                                     # no enrollment: not counted
           (6, 2, 2000, D(2000, 1, 1), ["311"]), (7, 2, None, D(2000, 1, 1), ["311"]),
           (8, None, 2000, D(2000, 1, 1), ["311"]), (9, 3, 2000, D(2000, 1, 1), ["311"]),
           (9, 4, 2000, D(2000, 1, 1), ["999"]), (10, 5, 2000, None, ["311"])]
    ben = [(1, D(1990, 1, 1), "M", "1"), (2, None, "F", None), (2, None, "F", None), (2, None, "M", None),
           (4, D(1990, 1, 1), "M", "1"), (None, D(1990, 1, 1), "M", "1"), (5, D(1990, 1, 1), "M", "1")]
    enr = [(1, 2000, "a"), (1, 2000, "a"), (1, 2000, None), (1, 2001, "b"), (2, 2000, "c"), (2, 2000, "d"),
           (2, None, "x"), (None, 2000, "x"), (3, 2000, "x"), (5, 2000, None)]
    tables = [spark.createDataFrame(*t) for t in (
        (adm, "admission_id long, bene_id long, year int, admission_date date, diagnosis array<string>"),
        (ben, "bene_id long, dob date, sex string, race_ethnicity_code string"),
        (enr, "bene_id long, year int, zip string"))]
    want = plain(*tables, ["311"])
    got = X.numbered_admissions(*tables, ["311"])
    assert rows(got, *want.columns) == rows(want) and got.count() == 3 + 1 + 3 + 1 + 6 + 1
    text_ids = [t.withColumn("bene_id", F.concat(F.lit("P"), F.col("bene_id"))) for t in tables]
    assert X.numbered_admissions(*text_ids, ["311"]).count() == got.count()
    none = [t.limit(0) for t in tables]
    assert X.numbered_admissions(*none, ["311"]).count() == 0


@pytest.mark.parametrize("name", ["individual_extract", "individual_extract_bands",
                                  "running_admission_number"])
def test_four_scans_and_eight_shuffles(spark, small_claims, shuffling, tmp_path, name):
    write_claims(small_claims, str(tmp_path))
    found = summarise(plan_text(catalog.builders()[name](spark, read_claims(spark, str(tmp_path)))))
    assert found["scans"] <= 4 and found["shuffles"] <= 8


def test_bucketed_tables_shuffle_no_admissions(spark, small_claims, shuffling, lists):
    """Nor are admissions shuffled below the running number: only finished histories are."""
    write_claims(small_claims, scratch_path(spark, "t-history"), buckets=4, table_prefix="t_history_")
    c = read_claims_tables(spark, "t_history_")
    df = X.individual_extract(*c, 0, 18, lists["icd9_all"], lists)
    text = plan_text(df)
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Exchange hashpartitioning(person") == 1
    want = X.individual_extract(*small_claims, 0, 18, lists["icd9_all"], lists)
    assert rows(df) == rows(want)


def test_a_hot_person_is_split(spark, small_claims, splitting, lists):  # noqa: F811
    df = X.numbered_admissions(*_hot(small_claims), lists["icd9_all"])
    assert "skew=true" in final_plan(df)


def test_exports_evaluate_the_extract_once(spark, claims, lists):
    a, b, e = claims
    seen = spark.sparkContext.accumulator(0)
    tick = F.udf(lambda y: (seen.add(1), y)[1], "int")
    counted = Claims(a.withColumn("year", tick("year")), b, e)

    def ticks(run):
        before = seen.value
        run()
        return seen.value - before

    bands = [(0, 18), (0, 12), (13, 18)]
    df = X.individual_extract(*counted, 0, 18, lists["icd9_all"], lists)
    once = ticks(lambda: df.write.format("noop").mode("overwrite").save())
    assert once > 0
    assert once == ticks(lambda: export.write_extract(df, scratch_path(spark, "t-once")))
    path = scratch_path(spark, "t-once")
    export_args = (*counted, lists["icd9_all"], lists, bands, path)
    assert once == ticks(lambda: export.export_individual_records(*export_args))
    kept = scratch_path(spark, "t-stage")
    assert once == ticks(lambda: export.export_individual_records(*export_args, stage=kept))
    assert spark.read.parquet(kept).count() == spark.read.option("header", True).csv(path).count()


def test_staging_leaves_nothing_behind(spark, claims, lists):
    import os
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(root))
    out = scratch_path(spark, "t-clean")
    export.write_extract(X.individual_extract(*claims, 0, 18, lists["icd9_all"], lists), out)
    assert {x for x in set(os.listdir(root)) - before if not x.startswith("t-clean")} == set()
