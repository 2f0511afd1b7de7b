"""Random small claims (hypothesis) against brute-force Python definitions of
the queries: NULL and empty arrays, NULL codes, missing dob, same-day
admissions, duplicate enrollments and NULL zips all occur."""

import datetime as dt
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dxcohort.plans import counts as C
from dxcohort.plans import extract as X
from dxcohort.plans import rates as R
from dxcohort.schema import ADMISSIONS, BENEFICIARIES, ENROLLMENTS

CODES = ["2962", "311", "3004", "3130", "E9500", "400", None]
LIST = ["2962", "311", "3004", "3130", "E9500"]
FLAG_LISTS = {"depression": ["2962"], "anxiety": ["3004"], "emotion_disturb": ["3130"],
              "adole_reaction": [], "disturb_conduct": ["E9500"]}
BAND = (0, 12)
YEAR = 2000

people = st.lists(st.tuples(st.sampled_from([1985, 1990, 1995, None]),
                            st.sampled_from(["M", "F,U", None])), min_size=1, max_size=4)
admission = st.tuples(st.integers(0, 3), st.sampled_from([dt.date(1999, 5, 1), dt.date(2000, 1, 1),
                                                          dt.date(2000, 1, 1), dt.date(2000, 7, 9)]),
                      st.one_of(st.none(), st.lists(st.sampled_from(CODES), max_size=4)))
enrollment = st.tuples(st.integers(0, 3), st.sampled_from([1999, 2000]),
                       st.sampled_from(["00501", "10001", None]))
claims_st = st.tuples(people, st.lists(admission, max_size=12), st.lists(enrollment, max_size=8))

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])


def _frames(spark, data):
    ppl, adms, enrs = data
    bene = [(i, dt.date(y, 6, 1) if y else None, s, "1") for i, (y, s) in enumerate(ppl)]
    adm = [(n, b, d.year, d, list(dx) if dx is not None else None)
           for n, (b, d, dx) in enumerate(adms)]
    enr = list(enrs)
    return (spark.createDataFrame(adm, ADMISSIONS), spark.createDataFrame(bene, BENEFICIARIES),
            spark.createDataFrame(enr, ENROLLMENTS), adm, bene, enr)


def _age(adm_date, dob):
    return None if dob is None else adm_date.year - dob.year


def _in_band(age):
    return age is not None and BAND[0] <= age <= BAND[1]


def _people(bene):
    return {b[0]: b for b in bene}


def _position_codes(dx, position):
    if position == "primary":
        return [(0, dx[0] if dx else None)]
    if dx is None:
        return []
    items = list(enumerate(dx))
    return items[1:] if position == "secondary" else items


@given(data=claims_st)
@SETTINGS
def test_code_counts_match_brute_force(spark, data):
    a, b, _, adm, bene, _ = _frames(spark, data)
    ppl = _people(bene)
    for position, keep_null in (("all", False), ("primary", True), ("secondary", True)):
        want = Counter()
        groups = set()
        for _, bid, _, d, dx in adm:
            if bid not in ppl or not _in_band(_age(d, ppl[bid][1])):
                continue
            for _, code in _position_codes(dx, position):
                if code is None and not keep_null:
                    continue
                groups.add(code)
                want[code] += code is not None
        got = {r.diag: r.diag_count for r in
               C.code_counts_in_band(a, b, *BAND, position).collect()}
        assert got == {g: want[g] for g in groups}


@given(data=claims_st)
@SETTINGS
def test_first_admission_matches_brute_force(spark, data):
    a, b, _, adm, bene, _ = _frames(spark, data)
    ppl = _people(bene)
    best = {}
    for aid, bid, _, d, dx in adm:
        if bid not in ppl or not _in_band(_age(d, ppl[bid][1])):
            continue
        for pos, code in _position_codes(dx, "secondary"):
            if code in LIST:
                key = (d, aid, pos)
                if bid not in best or key < best[bid][0]:
                    best[bid] = (key, code)
    want = Counter(code for _, code in best.values())
    got = {r.diag: r.diag_count for r in C.first_admission_counts_in_band(
        a, b, *BAND, "secondary", LIST, min_cell=None).collect()}
    assert got == dict(want)


@given(data=claims_st)
@SETTINGS
def test_extract_matches_brute_force(spark, data):
    a, b, e, adm, bene, enr = _frames(spark, data)
    ppl = _people(bene)
    rows = []
    for aid, bid, year, d, dx in adm:
        if bid not in ppl or dx is None or not any(c in LIST for c in dx):
            continue
        for ebid, eyear, z in enr:
            if ebid == bid and eyear == year:
                rows.append((bid, d, z, _age(d, ppl[bid][1])))
    per_person = defaultdict(list)
    for r in rows:
        per_person[r[0]].append(r[1])
    want = sorted(((bid, d, z, age, sum(1 for x in per_person[bid] if x <= d))
                   for bid, d, z, age in rows if _in_band(age)), key=repr)
    got = X.individual_extract(a, b, e, *BAND, LIST, FLAG_LISTS)
    got = sorted(((r.bene_id, r.admission_date, r.zip, r.age, r.n_th_admission)
                  for r in got.collect()), key=repr)
    assert got == want


@given(data=claims_st)
@SETTINGS
def test_zip_share_matches_brute_force(spark, data):
    a, b, e, adm, bene, enr = _frames(spark, data)
    ppl = _people(bene)
    admin, listed = Counter(), Counter()
    for _, bid, year, d, dx in adm:
        if year != YEAR or bid not in ppl or not _in_band(_age(d, ppl[bid][1])):
            continue
        for ebid, eyear, z in enr:
            if ebid == bid and eyear == YEAR:
                admin[z] += 1
                listed[z] += bool(dx) and any(c in LIST for c in dx)
    want = {z: ((listed[z] / admin[z]) if z is not None and listed[z] else None,
                listed[z] if z is not None and listed[z] else None, admin[z]) for z in admin}
    got = {r.zip: (r.diag_vs_all_diag, r.diag_count, r.admin_count) for r in
           R.diag_share_of_admissions(a, b, e, YEAR, *BAND, LIST).collect()}
    assert got == want


@given(data=claims_st)
@SETTINGS
def test_enrolled_share_matches_brute_force(spark, data):
    a, b, e, adm, bene, enr = _frames(spark, data)
    ppl = _people(bene)

    def in_band(bid):
        dob = ppl[bid][1] if bid in ppl else None
        return dob is not None and BAND[0] <= YEAR - dob.year <= BAND[1]

    enrolled, listed = Counter(), Counter()
    for ebid, eyear, z in enr:
        if eyear == YEAR and in_band(ebid):
            enrolled[z] += 1
    for _, bid, year, _, dx in adm:
        if year != YEAR or not in_band(bid) or not dx or not any(c in LIST for c in dx):
            continue
        for ebid, eyear, z in enr:
            if ebid == bid and eyear == YEAR and z is not None:
                listed[z] += 1
    want = {z: (listed[z] / n, listed[z], n) for z, n in enrolled.items()}
    got = {r.zip: (r.diag_vs_all_enroll, r.diag_final, r.enroll_count) for r in
           R.diag_share_of_enrolled(a, b, e, YEAR, *BAND, LIST).collect()}
    assert got == want


numeric_code = st.builds(lambda c, tail: str(c) + tail, st.integers(285, 325),
                         st.sampled_from(["", "0", "1", "9", "00", "12", "99"]))
e_code = st.builds(lambda c, tail: f"E{c}" + tail, st.integers(945, 962),
                   st.sampled_from(["", "0", "5", "9"]))
rule_st = st.one_of(
    st.builds(lambda p: ("children", p, None), st.one_of(numeric_code, e_code)),
    st.builds(lambda a, b: ("range", str(min(a, b)), str(max(a, b))),
              st.integers(285, 325), st.integers(285, 325)),
    st.builds(lambda a, b: ("range", f"E{min(a, b)}", f"E{max(a, b)}"),
              st.integers(945, 962), st.integers(945, 962)),
    st.builds(lambda c: ("exact", c, None), st.one_of(numeric_code, e_code)))


@given(codes=st.sets(st.one_of(numeric_code, e_code), min_size=1, max_size=25),
       rules=st.lists(rule_st, min_size=1, max_size=5))
@SETTINGS
def test_code_lists_match_brute_force(spark, codes, rules):
    from dxcohort.operators.hierarchy import Rule, build_code_lists

    def category(code):
        return code[:4] if code.startswith("E") else code[:3]

    want = set()
    for i, (kind, a, b) in enumerate(rules):
        name = f"l{i % 2}"
        if kind == "children":
            want |= {(name, c) for c in codes if c.startswith(a)}
        elif kind == "range":
            want |= {(name, c) for c in codes
                     if c.startswith("E") == a.startswith("E") and a <= category(c) <= b}
        else:
            want.add((name, a))
    dim = spark.createDataFrame([(c,) for c in sorted(codes)], "code string")
    got = build_code_lists(spark, dim, [Rule(f"l{i % 2}", k, a, b)
                                        for i, (k, a, b) in enumerate(rules)])
    assert {(r.list_name, r.code) for r in got.collect()} == want
