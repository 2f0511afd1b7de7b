
import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from dxcohort.operators.cohort import with_bands
from dxcohort.operators.running import running_count
from dxcohort.plans import counts as C
from dxcohort.plans import extract as X
from dxcohort.plans import rates as R
from dxcohort.schema import EXTRACT, FLAG_LISTS


def _extract(claims, lists, low=0, high=18, **kw):
    return X.individual_extract(claims.admissions, claims.beneficiaries, claims.enrollments,
                                low, high, lists["icd9_all"], lists, **kw)


def test_extract_schema_has_23_columns_in_order(claims, lists):
    df = _extract(claims, lists)
    assert df.columns == [f.name for f in EXTRACT.fields]
    assert len(df.columns) == 23
    assert [f.dataType for f in df.schema.fields] == [f.dataType for f in EXTRACT.fields]


def test_running_admission_number_readme_examples(claims, lists):
    got = {(r.bene_id, r.admission_date): r.n_th_admission
           for r in _extract(claims, lists).collect()}
    # README: 296.2 on 2001-12-15 is admission 1, 315.0 on 2002-06-15 is 2; the
    # 2002-07-01 admission with only unlisted codes is not numbered.
    assert got[(1, dt.date(2001, 12, 15))] == 1
    assert got[(1, dt.date(2002, 6, 15))] == 2
    assert (1, dt.date(2002, 7, 1)) not in got
    # same-day admissions are peers and share the larger number
    assert got[(3, dt.date(2000, 3, 3))] == 2 and got[(3, dt.date(2000, 5, 5))] == 3


def test_extract_rows_bands_and_fan_out(claims, lists):
    full = _extract(claims, lists)
    assert full.count() == 13                       # person 7 (NULL dob) is out
    b8 = rows(full.where("bene_id = 8"), "admission_date", "zip", "n_th_admission")
    # two enrollments in 2000 double the row and both count in the number
    assert b8 == [(dt.date(2000, 6, 1), "10001", 2), (dt.date(2000, 6, 1), "10002", 2),
                  (dt.date(2001, 6, 1), None, 3)]
    # band 13-18 still counts the admission at age 12 (window before the filter)
    teen = rows(_extract(claims, lists, 13, 18), "bene_id", "age", "n_th_admission")
    assert teen == [(6, 13, 2)]
    assert _extract(claims, lists, 0, 12).count() == 12


def test_extract_flags_and_positions(claims, lists):
    r = {x.bene_id: x for x in _extract(claims, lists).where("admission_date IN "
         "('2000-06-01', '2001-12-15', '2000-01-01', '2000-05-05')").collect()}
    assert (r[8].depression, r[8].anxiety, r[8].diag1, r[8].diag2, r[8].diag3) == (1, 0, "311", "2962", None)
    assert r[1].depression == 1 and r[1].adole_reaction == 0
    assert r[5].disturb_conduct == 1 and r[5].age == 1          # born 31 Dec, admitted 1 Jan
    assert r[3].emotion_disturb == 1
    assert r[6].adole_reaction == 1


def test_extract_lazy_and_staged_agree(claims, lists, tmp_path):
    staged = _extract(claims, lists, stage=str(tmp_path / "rows"))
    assert rows(_extract(claims, lists)) == rows(staged)


def test_a_band_given_twice_counts_once(claims):
    a, b, _ = claims
    once = C.code_counts(a, b, [(0, 18)], "all")
    assert rows(C.code_counts(a, b, [(0, 18), (0, 18)], "all"), *once.columns) == rows(once)


def test_a_flag_for_every_given_list(claims, lists):
    given = {"icd9_all": lists["icd9_all"], "one": ["311"], "two": ["2962"]}
    got = X.admission_flags(claims.admissions, given)
    assert got.columns[-2:] == ["one", "two"]
    assert X.admission_flags(claims.admissions).columns[-5:] == list(FLAG_LISTS)


def test_text_person_keys_survive_files(spark, claims, lists, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from dxcohort.plans import export
    from dxcohort.sources.fixture import Claims
    from dxcohort.sources.tables import read_claims, write_claims
    text = Claims(*[t.withColumn("bene_id", F.concat(F.lit("AB"), "bene_id")) for t in claims])
    write_claims(text, str(tmp_path / "claims"))
    back = read_claims(spark, str(tmp_path / "claims"), T.StringType())
    assert [rows(x) for x in back] == [rows(x.select(y.columns)) for x, y in zip(text, back)]
    df = X.individual_extract(*back, 0, 18, lists["icd9_all"], lists, FLAG_LISTS)
    export.write_extract(df, str(tmp_path / "csv"))
    got = export.read_extract(spark, str(tmp_path / "csv"), person_type=T.StringType())
    assert rows(got) == rows(df) and {r.bene_id[:2] for r in got.collect()} == {"AB"}


def test_blank_ambiguous_demographics_in_extract(claims, lists):
    df = _extract(claims, lists, blank_ambiguous=True)
    got = {r.bene_id: (r.sex, r.race_ethnicity_code) for r in df.collect()}
    assert got[2] == (None, None)        # 'F,U', '10'
    assert got[3] == ("F", None)         # '2,3'
    assert got[1] == ("M", "1")
    assert got[4] == ("U", None)         # NULL race stays NULL


def test_zip_counts_and_shares(claims, lists):
    a, b, e = claims
    codes = lists["icd9_all"]
    assert rows(R.admission_count_by_zip(a, b, e, 2000, 0, 18)) == [(1, "10002"), (4, "10001"), (4, "60601")]
    assert rows(R.diag_count_by_zip(a, b, e, 2000, 0, 18, codes)) == [(1, "10002"), (2, "60601"), (4, "10001")]
    share = {r.zip: tuple(r)[:3] for r in R.diag_share_of_admissions(a, b, e, 2001, 0, 18, codes).collect()}
    # NULL zip: counted as a group, but never matched by the left join
    assert share == {"02138": (1.0, 1, 1), "10001": (0.5, 1, 2), "60601": (1.0, 1, 1),
                     None: (None, None, 1)}
    enrolled = {r.zip: tuple(r)[:3] for r in R.diag_share_of_enrolled(a, b, e, 2001, 0, 18, codes).collect()}
    assert enrolled == {"02138": (1.0, 1, 1), "10001": (1.0, 1, 1), "60601": (1.0, 1, 1),
                        None: (0.0, 0, 1)}


def test_first_admission_counts_readme_example(claims, lists):
    a, b, _ = claims
    got = rows(C.first_admission_counts_in_band(a, b, 0, 18, "secondary", lists["icd9"], min_cell=None))
    # person 2: 290.1 on 2001-01-01, then 315.0 on 2001-06-15 - only the first counts
    assert got == [("2901", 1), ("2962", 1), ("30029", 1), ("311", 1)]
    assert rows(C.first_admission_counts_in_band(a, b, 0, 18, "secondary", lists["icd9"])) == []


def test_first_admission_totals(claims):
    a, b, _ = claims
    assert C.first_admission_total_in_band(a, b, 0, 18, "secondary").first().total_hosp == 6
    assert C.first_admission_total_in_band(a, b, 0, 18, "primary").first().total_hosp == 7
    assert C.first_admission_total_in_band(a, b, 50, 60, "primary").first().total_hosp == 0


def test_first_admission_primary_ties_and_null_group(claims):
    a, b, _ = claims
    got = dict(rows(C.first_admission_counts_in_band(a, b, 0, 18, "primary", None, min_cell=None)))
    assert got == {"311": 2, "29620": 1, "400": 1, "3120": 1, "3090": 1, None: 0}


def test_null_primary_is_a_zero_count_group(claims):
    a, b, _ = claims
    got = dict(rows(C.code_counts_in_band(a, b, 0, 18, "primary")))
    assert got[None] == 0
    assert None not in dict(rows(C.code_counts_in_band(a, b, 0, 18, "all")))


def test_primary_plus_secondary_equals_all(small_claims):
    a, b, _ = small_claims
    def counts(position):
        return {k: v for k, v in rows(C.code_counts_in_band(a, b, 0, 18, position)) if k is not None}
    p, s, al = counts("primary"), counts("secondary"), counts("all")
    assert {k: p.get(k, 0) + s.get(k, 0) for k in al} == al


def test_bands_in_one_pass_equal_separate_runs(small_claims):
    a, b, _ = small_claims
    bands = [(0, 18), (0, 12), (13, 18)]
    one = rows(C.code_counts(a, b, bands, "secondary"))
    sep = sorted((x for lo, hi in bands for x in rows(
        C.code_counts(a, b, (lo, hi), "secondary"))), key=repr)
    assert one == sep
    # every-admission counts add up across the split bands
    full = dict((r[2], r[3]) for r in one if r[:2] == (0, 18))
    low = dict((r[2], r[3]) for r in one if r[:2] == (0, 12))
    high = dict((r[2], r[3]) for r in one if r[:2] == (13, 18))
    assert all(full[k] == low.get(k, 0) + high.get(k, 0) for k in full)


def test_top_codes_is_a_limit_with_code_tiebreak(small_claims):
    a, b, _ = small_claims
    top = C.top_codes(a, b, 0, 18, "all")
    allc = rows(C.code_counts_in_band(a, b, 0, 18, "all"))
    expect = sorted(allc, key=lambda r: (-r[1], r[0]))[:20]
    assert [tuple(r) for r in top.collect()] == expect


def test_running_count_equals_range_window(small_claims, lists):
    a, b, e = small_claims
    q = X.listed_admissions(a, b, e, lists["icd9_all"])
    w = Window.partitionBy("bene_id").orderBy("admission_date")
    expect = q.withColumn("n_th_admission", F.count(F.lit(1)).over(w))
    cols = ["bene_id", "year", "admission_date", "zip", "n_th_admission"]
    assert rows(running_count(q), *cols) == rows(expect, *cols)


def test_with_bands_overlapping(spark):
    df = spark.createDataFrame([(1, 5), (2, 13), (3, None), (4, 19)], "id int, age int")
    got = rows(with_bands(df, [(0, 18), (0, 12), (13, 18)]), "id", "age_low", "age_high")
    assert got == [(1, 0, 12), (1, 0, 18), (2, 0, 18), (2, 13, 18)]


def test_one_enrollment_per_year_removes_fan_out(claims, lists):
    from dxcohort.operators.cohort import one_enrollment_per_year
    a, b, e = claims
    x = X.individual_extract(a, b, one_enrollment_per_year(e), 0, 18, lists["icd9_all"], lists)
    assert rows(x.where("bene_id = 8"), "zip", "n_th_admission") == [("10001", 1), (None, 2)]


def test_all_positions_in_one_pass_equal_separate_runs(claims, small_claims, lists):
    bands = [(0, 18), (0, 12), (13, 18)]
    for a, b, _ in (claims, small_claims):
        for codes in (None, lists["icd9"]):
            one = rows(C.code_counts_by_position(a, b, bands, codes),
                       "position", "age_low", "age_high", "diag", "diag_count")
            sep = sorted((tuple([p, *r]) for p in ("all", "primary", "secondary")
                          for r in rows(C.code_counts(a, b, bands, p, codes),
                                        "age_low", "age_high", "diag", "diag_count")), key=repr)
            assert one == sep


def test_year_range_limits_admissions(claims):
    a, b, _ = claims
    full = dict(rows(C.code_counts_in_band(a, b, 0, 18, "all")))
    y2000 = dict(rows(C.code_counts_in_band(a, b, 0, 18, "all", year_range=(2000, 2000))))
    manual = dict(rows(C.code_counts_in_band(a.where("year = 2000"), b, 0, 18, "all")))
    assert y2000 == manual and y2000 != full
    assert C.first_admission_total_in_band(a, b, 0, 18, "primary",
                                           year_range=(2001, 2002)).first().total_hosp == 4


def test_standard_lists_are_the_default(claims, lists):
    a, b, e = claims
    assert rows(X.individual_extract(a, b, e, 0, 18)) == rows(_extract(claims, lists))
    assert rows(R.diag_share_of_admissions(a, b, e, 2001, 0, 18)) == rows(
        R.diag_share_of_admissions(a, b, e, 2001, 0, 18, lists["icd9_all"]))
    assert rows(R.diag_share_of_enrolled(a, b, e, 2001, 0, 18)) == rows(
        R.diag_share_of_enrolled(a, b, e, 2001, 0, 18, lists["icd9_all"]))
    assert rows(X.admission_flags(a)) == rows(X.admission_flags(a, lists))
