"""Physical-plan checks: built-in expressions only, no cartesian products,
top-k as TakeOrderedAndProject, filters reaching the scans."""

import pytest

from conftest import SF_SMALL
from dxcohort.plans import catalog

QUERIES = catalog.queries()
SKIP = catalog.FILE_QUERIES - {"run_and_export", "export_individual_records"}  # write while built


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_python_no_cartesian(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                 "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, f"{name}: {node}"


@pytest.mark.parametrize("name", ["top_codes_all", "top_codes_primary", "top_codes_primary_in_list"])
def test_top_k_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan_text(QUERIES[name](spark, SF_SMALL))


def test_year_reaches_both_scans_and_partitions(spark, tmp_path):
    from dxcohort.plans import rates as R
    from dxcohort.sources.tables import read_claims, write_claims
    root = str(tmp_path / "claims")
    write_claims(catalog.claims(spark, SF_SMALL), root)
    a, b, e = read_claims(spark, root)
    text = plan_text(R.admission_count_by_zip(a, b, e, 1998, 0, 18))
    # both partitioned tables are pruned to the one year at planning time
    assert text.count("PartitionFilters: [isnotnull(year") == 2
    assert text.count("(year") >= 2 and "= 1998)" in text


def test_enrolled_share_pushes_dob_range(spark, tmp_path):
    from dxcohort.plans import rates as R
    from dxcohort.sources.tables import read_claims, write_claims
    root = str(tmp_path / "claims")
    write_claims(catalog.claims(spark, SF_SMALL), root)
    text = plan_text(R.diag_share_of_enrolled(*read_claims(spark, root), 1998, 0, 18, ["311"]))
    assert "GreaterThanOrEqual(dob," in text and "LessThanOrEqual(dob," in text


def test_first_admission_uses_partial_aggregation(spark):
    text = plan_text(QUERIES["first_admission_secondary_in_list"](spark, SF_SMALL))
    assert "partial_min" in text
    assert "Window" not in text


def _exchange_inputs(df):
    """The input column lists of every Exchange node of the formatted plan."""
    import re
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    sections = re.split(r"\n\(\d+\) ", text)
    return [sec for sec in sections if sec.startswith("Exchange")]


def test_zip_and_first_admission_queries_never_shuffle_arrays(spark, tmp_path):
    from dxcohort.plans import rates as R
    from dxcohort.sources.tables import read_claims, write_claims
    root = str(tmp_path / "claims")
    write_claims(catalog.claims(spark, SF_SMALL), root)
    a, b, e = read_claims(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from dxcohort.plans import counts as C
        for df in (R.diag_share_of_admissions(a, b, e, 1998, 0, 18, ["311"]),
                   R.diag_share_of_enrolled(a, b, e, 1998, 0, 18, ["311"]),
                   C.first_admission_counts(a, b, (0, 18), "secondary", ["311"]),
                   C.first_admission_total(a, b, (0, 18), "secondary")):
            exchanges = _exchange_inputs(df)
            assert exchanges and not any("diagnosis" in x for x in exchanges)
        # control: per-code counts do shuffle the array rows (once, to people)
        shuffled = [x for x in _exchange_inputs(C.code_counts(a, b, (0, 18), "all"))
                    if "diagnosis" in x]
        assert len(shuffled) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["first_admission_secondary_all", "first_admission_primary_all",
                                  "first_admission_secondary_total"])
def test_first_admission_without_list_does_not_explode(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "Generate" not in text


def test_listed_zip_counts_filter_below_the_aggregate(spark, tmp_path):
    from dxcohort.plans import rates as R
    from dxcohort.sources.tables import read_claims, write_claims
    root = str(tmp_path / "claims")
    write_claims(catalog.claims(spark, SF_SMALL), root)
    plan = R.diag_count_by_zip(*read_claims(spark, root), 1998, 0, 18, ["311"])._jdf \
        .queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [bene_id"):]
    assert "311" in below and "Filter" in below


def test_listed_admissions_by_table_do_not_shuffle(spark, tmp_path):
    from dxcohort.operators.codes import rows_with_listed_code
    from dxcohort.sources.tables import read_claims, write_claims
    root = str(tmp_path / "claims")
    write_claims(catalog.claims(spark, SF_SMALL), root)
    codes = spark.createDataFrame([("311",), ("3004",)], "code string")
    assert "Exchange" not in plan_text(rows_with_listed_code(read_claims(spark, root).admissions, codes))


@pytest.mark.parametrize("name", ["diag_count_by_zip", "admission_count_by_zip", "diag_share_of_admissions",
                                  "diag_share_of_enrolled"])
def test_zip_counts_take_four_shuffles(spark, small_claims, tmp_path, name):
    from dxcohort.sources.tables import read_claims, write_claims
    from plan_summary import summarise
    write_claims(small_claims, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(catalog.builders()[name](spark, read_claims(spark, str(tmp_path))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert summarise(text)["shuffles"] <= 4


@pytest.mark.parametrize("name", ["code_counts_primary", "code_counts_290_319_primary", "top_codes_primary",
                                  "top_codes_primary_in_list"])
def test_primary_counts_explode_nothing(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "Generate" not in text
