"""The individual extract: one row per listed admission x enrollment of its
year, with positional codes, disease flags, a running admission number and
demographics (23 columns, see ``dxcohort.schema.EXTRACT``).

Order of steps matters (as in the source SQL):

1. admissions with a listed code, joined to people and to the enrollments of
   the admission's own year (several enrollments multiply a row);
2. ``n_th_admission`` over those rows, **before** the age filter, so in band
   13-18 it still counts a person's earlier admissions at ages 0-12. Both steps are one
   join, to one history per person (``dxcohort.operators.history``);
3. the age filter (NULL age out), then positional codes and flags.

The result is not sorted: sorting the whole extract is a range shuffle, which
the export step performs when a sorted file is wanted
(``dxcohort.plans.export.write_extract``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxcohort.functions.expr import age_at_admission, disease_flags, has_any, positional_codes
from dxcohort.operators.clean import blank_ambiguous_demographics
from dxcohort.operators.cohort import Band, normalize_bands, with_bands
from dxcohort.operators.history import histories, with_history
from dxcohort.schema import EXTRACT, FLAG_LISTS
from dxcohort.sources.tables import stage_table

# Lists that choose the cohort and so give no flag: the current and the older one.
COHORT_LISTS = ("icd9_all", "icd9")
EXTRACT_COLUMNS = [f.name for f in EXTRACT.fields]


def _standard(df: DataFrame) -> dict[str, list[str]]:
    from dxcohort.sources.codelists import standard_lists
    return standard_lists(df.sparkSession)


def _flags(admissions: DataFrame, flag_lists: Mapping[str, Sequence[str]] | None,
           flag_names: Sequence[str] | None):
    """Lists and names of the flags: one for every list but the cohorts', the five
    diseases first."""
    if flag_lists is None:
        flag_lists = _standard(admissions)
    names = [n for n in flag_lists if n not in COHORT_LISTS]
    return flag_lists, flag_names or sorted(
        names, key=lambda n: FLAG_LISTS.index(n) if n in FLAG_LISTS else len(FLAG_LISTS))


def _listed(admissions: DataFrame, codes: Iterable[str] | None) -> DataFrame:
    if codes is None:
        codes = _standard(admissions)["icd9_all"]
    return admissions.select("bene_id", "year", "admission_date", "diagnosis").where(
        has_any("diagnosis", codes))


def listed_admissions(admissions: DataFrame, beneficiaries: DataFrame,
                      enrollments: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """Step 1 alone: listed admissions x people x enrollments of the same year.

    Enrollments are joined to people first (on ``bene_id``), so the large
    admissions side is shuffled once, on ``(bene_id, year)``. A person or
    person-year holding a large share of the rows is split at run time
    (``dxcohort.operators.skew``).
    """
    adm = _listed(admissions, codes)
    people = beneficiaries.select("bene_id", "dob", "sex", "race_ethnicity_code")
    enr = enrollments.select("bene_id", "year", "zip")
    return adm.join(enr.join(people, "bene_id"), ["bene_id", "year"])


def numbered_admissions(admissions: DataFrame, beneficiaries: DataFrame,
                        enrollments: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """Steps 1 and 2: the rows of :func:`listed_admissions` with ``n_th_admission``.

    Admissions are read twice, once without their arrays for the histories, the other
    tables once; the rows themselves are shuffled once, by person (on tables bucketed by
    person not at all).
    """
    adm = _listed(admissions, codes)
    return with_history(adm, histories(adm, beneficiaries, enrollments))


def individual_extract_bands(admissions: DataFrame, beneficiaries: DataFrame,
                             enrollments: DataFrame, codes: Iterable[str] | None,
                             flag_lists: Mapping[str, Sequence[str]] | None,
                             bands: Band | Sequence[Band],
                             flag_names: Sequence[str] | None = None,
                             blank_ambiguous: bool = False,
                             stage: str | None = None) -> DataFrame:
    """The extract for several bands in one pass: the 23 columns plus
    ``age_low``, ``age_high`` (a row appears once per band it falls in).

    The plan is lazy. ``stage`` names a shared folder to write the numbered rows to
    first (an action), for a result that is read several times. The caller removes
    the folder. ``codes`` and ``flag_lists`` default (``None``) to the standard
    lists (``icd9_all`` and the five diseases); ``flag_names`` to every list
    given but the cohorts'.
    """
    flag_lists, flag_names = _flags(admissions, flag_lists, flag_names)
    rows = numbered_admissions(admissions, beneficiaries, enrollments, codes)
    if stage:
        rows = stage_table(rows, stage)
    rows = with_bands(rows.withColumn("age", age_at_admission()), normalize_bands(bands))
    out = rows.select(
        *positional_codes("diagnosis"), "diagnosis", "year", "admission_date", "bene_id",
        "n_th_admission", *disease_flags(flag_lists, flag_names), "zip",
        "race_ethnicity_code", "sex", "age", "age_low", "age_high")
    return blank_ambiguous_demographics(out) if blank_ambiguous else out


def individual_extract(admissions: DataFrame, beneficiaries: DataFrame,
                       enrollments: DataFrame, age_low: int, age_high: int,
                       codes: Iterable[str] | None = None,
                       flag_lists: Mapping[str, Sequence[str]] | None = None,
                       flag_names: Sequence[str] | None = None,
                       blank_ambiguous: bool = False, stage: str | None = None) -> DataFrame:
    """The 23-column extract for one band."""
    return individual_extract_bands(admissions, beneficiaries, enrollments, codes,
                                    flag_lists, (age_low, age_high), flag_names,
                                    blank_ambiguous, stage).drop("age_low", "age_high")


def admission_flags(admissions: DataFrame,
                    flag_lists: Mapping[str, Sequence[str]] | None = None,
                    flag_names: Sequence[str] | None = None) -> DataFrame:
    """The 0/1 disease flags of every admission (key columns kept)."""
    flag_lists, flag_names = _flags(admissions, flag_lists, flag_names)
    keys = [c for c in ("admission_id", "bene_id", "admission_date") if c in admissions.columns]
    return admissions.select(*keys, *disease_flags(flag_lists, flag_names))


def order_extract(extract: DataFrame) -> DataFrame:
    """``ORDER BY bene_id, admission_date`` (PostgreSQL: NULLS LAST); ties are
    split by a row hash so one person-day cannot pin a range partition."""
    from dxcohort.plans.export import _tiebreak
    return extract.orderBy(F.col("bene_id").asc_nulls_last(),
                           F.col("admission_date").asc_nulls_last(), _tiebreak(extract))
