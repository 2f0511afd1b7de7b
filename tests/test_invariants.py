"""
fixture derived from the test tables."""

from pyspark.sql import functions as F

from conftest import rows
from dxcohort.functions import has_any
from dxcohort.operators.clean import blank_ambiguous_demographics
from dxcohort.plans import counts as C
from dxcohort.plans import extract as X
from dxcohort.plans import rates as R

YEAR = 1998


def test_first_admission_counts_bounded_by_total(small_claims, lists):
    a, b, _ = small_claims
    for low, high in [(0, 18), (0, 12), (13, 18)]:
        counts = C.first_admission_counts_in_band(a, b, low, high, "secondary", lists["icd9"],
                                                  min_cell=None)
        total = C.first_admission_total_in_band(a, b, low, high, "secondary").first().total_hosp
        assert sum(r.diag_count for r in counts.collect()) <= total


def test_zip_counts_agree(small_claims, lists):
    a, b, e = small_claims
    codes = lists["icd9_all"]
    l1 = dict((r.zip, r.diag_count) for r in R.diag_count_by_zip(a, b, e, YEAR, 0, 18, codes).collect())
    l2 = dict((r.zip, r.admin_count) for r in R.admission_count_by_zip(a, b, e, YEAR, 0, 18).collect())
    l3 = {r.zip: r for r in R.diag_share_of_admissions(a, b, e, YEAR, 0, 18, codes).collect()}
    assert {z: r.admin_count for z, r in l3.items()} == l2
    assert {z: r.diag_count for z, r in l3.items() if r.diag_count is not None} == \
        {z: n for z, n in l1.items() if z is not None}
    assert all(r.diag_vs_all_diag is None or 0 < r.diag_vs_all_diag <= 1 for r in l3.values())


def test_enrolled_share_zero_fills(small_claims, lists):
    a, b, e = small_claims
    got = R.diag_share_of_enrolled(a, b, e, YEAR, 0, 18, lists["icd9_all"]).collect()
    assert got and all(r.diag_final is not None and r.enroll_count > 0 for r in got)
    assert all(r.diag_final == 0 for r in got if r.zip is None)


def test_flags_imply_cohort_membership(small_claims, lists):
    a, b, e = small_claims
    x = X.individual_extract(a, b, e, 0, 18, lists["icd9_all"], lists)
    any_flag = sum(F.col(n) for n in ("depression", "anxiety", "emotion_disturb",
                                      "adole_reaction", "disturb_conduct"))
    flagged = x.where(any_flag > 0)
    assert flagged.count() > 0
    assert flagged.where(~has_any("diagnosis", lists["icd9_all"])).count() == 0
    assert x.where(~has_any("diagnosis", lists["icd9_all"])).count() == 0


def test_extract_bands_split_the_full_band(small_claims, lists):
    a, b, e = small_claims
    full, low, high = (X.individual_extract(a, b, e, lo, hi, lists["icd9_all"], lists)
                       for lo, hi in [(0, 18), (0, 12), (13, 18)])
    assert rows(full) == sorted(rows(low) + rows(high), key=repr)


def test_blanking_is_idempotent(small_claims):
    once = blank_ambiguous_demographics(small_claims.beneficiaries)
    assert rows(blank_ambiguous_demographics(once)) == rows(once)


def test_first_admission_counts_do_not_add_across_bands(small_claims):
    # "first" is relative to the band, so 0-12 plus 13-18 can exceed 0-18
    a, b, _ = small_claims
    def total(lo, hi):
        return C.first_admission_total_in_band(a, b, lo, hi, "primary").first().total_hosp
    assert total(0, 12) + total(13, 18) >= total(0, 18)


def test_first_admissions_in_one_pass_equal_separate_runs(small_claims, lists):
    a, b, _ = small_claims
    bands = [(0, 18), (0, 12), (13, 18)]
    for position, codes in (("secondary", lists["icd9"]), ("secondary", None), ("primary", None)):
        one = rows(C.first_admission_counts(a, b, bands, position, codes, min_cell=None),
                   "age_low", "age_high", "diag", "diag_count")
        sep = sorted((tuple([lo, hi, *r]) for lo, hi in bands for r in rows(
            C.first_admission_counts_in_band(a, b, lo, hi, position, codes, min_cell=None),
            "diag", "diag_count")), key=repr)
        assert one == sep
        totals = {(r.age_low, r.age_high): r.total_hosp
                  for r in C.first_admission_total(a, b, bands, position, codes).collect()}
        assert totals == {(lo, hi): C.first_admission_total_in_band(
            a, b, lo, hi, position, codes).first().total_hosp for lo, hi in bands}
