"""Per-zip counts and shares for one year and age band.

* :func:`diag_count_by_zip` - admissions with a listed code, per zip;
* :func:`admission_count_by_zip` - all admissions, per zip;
* :func:`diag_share_of_admissions` - the first over the second;
* :func:`diag_share_of_enrolled` - listed admissions over enrolled people.

Counts are of rows, not distinct people: several enrollment rows for a person
and year multiply admissions, as in the source SQL. The zip is the enrollment
zip of that year; a NULL zip is a group of its own but never matches in the
left join of the source, so its share is NULL (admissions) or 0 (enrolled).

Every query reduces admissions per person (and admission year) and
enrollments per (person, zip) first, so no person - however many rows they hold -
sends more than a few rows through a shuffle, and joins on ``bene_id`` alone (the
year is a literal on both sides). A per-zip ``groupBy`` with
partial aggregation ends each query, so a hot zip sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxcohort.functions.expr import dob_for_age_in_year, has_any, in_band, share


def _cohort_codes(admissions: DataFrame, codes: Iterable[str] | None) -> Iterable[str]:
    """``codes``, or the standard ``icd9_all`` list when none is given."""
    if codes is not None:
        return codes
    from dxcohort.sources.codelists import standard_lists
    return standard_lists(admissions.sparkSession)["icd9_all"]


def _zip_rows(admitted: DataFrame, enrollments: DataFrame, people: DataFrame, year: int,
              counts: Column | None = None) -> DataFrame:
    """A row for each zip of ``year`` and row of ``people``: ``zip``, ``n`` (enrollment rows),
    and ``_n``, ``_l``: all and listed rows of ``admitted`` (``bene_id``, ``adm_year``, ``listed``)
    of that person for which ``counts`` holds; null without any.

    Admissions and enrollments become facts of a person - admitted in a calendar year, or living
    in a zip - counted in one aggregation with partial counts, so what a person sends is
    bounded by years and zips, whatever the skew. One distribution by person then serves the
    join to people and the window that gives each zip of a person the admissions.
    """
    admitted = admitted.select("bene_id", "adm_year", F.lit(None).cast("string").alias("zip"),
                               F.col("listed").cast("long").alias("listed"))
    lives = enrollments.where(F.col("year") == int(year)).select(
        "bene_id", F.lit(None).cast("int").alias("adm_year"), "zip", F.lit(0).cast("long").alias("listed"))
    facts = admitted.where(F.col("adm_year").isNotNull()).unionAll(lives) \
        .groupBy("bene_id", "adm_year", "zip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("listed").alias("n_listed"))
    # a row of the people table is told apart from its like: each multiplies the result
    rows = facts.join(people.withColumn("person_row", F.monotonically_increasing_id()), "bene_id")
    lives_here = F.col("adm_year").isNull()
    if counts is not None:
        rows = rows.where(lives_here | counts)
    one = Window.partitionBy("bene_id", "person_row")
    return rows.select("adm_year", "zip", "n",
                       F.sum(F.when(~lives_here, F.col("n"))).over(one).alias("_n"),
                       F.sum(F.when(~lives_here, F.col("n_listed"))).over(one).alias("_l")).where(lives_here)


def _zip_totals(admissions: DataFrame, beneficiaries: DataFrame,
                enrollments: DataFrame, year: int, age_low: int, age_high: int,
                codes: Iterable[str] | None, listed_only: bool = False) -> DataFrame:
    """Per zip: ``_admissions`` (all) and ``_listed`` (with a listed code),
    counting admission x enrollment rows of ``year`` with age at admission in
    band.

    The age is fixed within a calendar year of admission; an admission without a date has
    none, and no band holds it. ``listed_only`` drops the other admissions in the scan.
    """
    adm = admissions.where(F.col("year") == int(year))
    if listed_only:
        adm = adm.where(has_any("diagnosis", codes))
    listed = (F.coalesce(has_any("diagnosis", codes), F.lit(False)) if codes is not None
              else F.lit(False))
    rows = _zip_rows(
        adm.select("bene_id", F.year("admission_date").alias("adm_year"), listed.alias("listed")),
        enrollments, beneficiaries.select("bene_id", F.year("dob").alias("birth_year")), year,
        in_band(F.col("adm_year") - F.col("birth_year"), age_low, age_high))
    return rows.where(F.col("_n").isNotNull()).groupBy("zip").agg(
        F.sum(F.col("_n") * F.col("n")).cast("long").alias("_admissions"),
        F.sum(F.col("_l") * F.col("n")).cast("long").alias("_listed"))


def diag_count_by_zip(admissions: DataFrame, beneficiaries: DataFrame,
                      enrollments: DataFrame, year: int, age_low: int, age_high: int,
                      codes: Iterable[str] | None = None) -> DataFrame:
    """``diag_count, zip``: admissions carrying a listed code (zips with at
    least one)."""
    totals = _zip_totals(admissions, beneficiaries, enrollments, year, age_low, age_high,
                         _cohort_codes(admissions, codes), listed_only=True)
    return totals.select(F.col("_listed").alias("diag_count"), "zip")


def admission_count_by_zip(admissions: DataFrame, beneficiaries: DataFrame,
                           enrollments: DataFrame, year: int, age_low: int,
                           age_high: int) -> DataFrame:
    """``admin_count, zip``: all admissions."""
    totals = _zip_totals(admissions, beneficiaries, enrollments, year, age_low, age_high, None)
    return totals.select(F.col("_admissions").alias("admin_count"), "zip")


def diag_share_of_admissions(admissions: DataFrame, beneficiaries: DataFrame,
                             enrollments: DataFrame, year: int, age_low: int,
                             age_high: int, codes: Iterable[str] | None = None) -> DataFrame:
    """``diag_vs_all_diag, diag_count, admin_count, zip``, share descending,
    NULL last.

    The source joins two aggregates of the same rows; here both counts come
    from one pass. ``diag_count`` is NULL where the source's left join finds
    no match: no listed admission in the zip, or a NULL zip.
    """
    totals = _zip_totals(admissions, beneficiaries, enrollments, year, age_low, age_high,
                         _cohort_codes(admissions, codes))
    diag_count = F.when(F.col("zip").isNotNull() & (F.col("_listed") > 0), F.col("_listed"))
    return (totals.withColumn("diag_count", diag_count)
            .select(share("diag_count", "_admissions").alias("diag_vs_all_diag"),
                    "diag_count", F.col("_admissions").alias("admin_count"), "zip")
            .orderBy(F.col("diag_vs_all_diag").desc_nulls_last(), F.col("zip").asc_nulls_last()))


def diag_share_of_enrolled(admissions: DataFrame, beneficiaries: DataFrame,
                           enrollments: DataFrame, year: int, age_low: int,
                           age_high: int, codes: Iterable[str] | None = None) -> DataFrame:
    """``diag_vs_all_enroll, diag_final, enroll_count, zip`` per zip with
    enrolled people in the band; zips without listed admissions give 0.

    Age here is ``year - year(dob)`` on both sides (not the age at admission),
    restated as a ``dob`` range so it reaches the Parquet scan. The share can
    exceed 1: its numerator counts admissions, its denominator enrollments.

    Each enrollment row of a person in a zip adds the person's listed admissions to the
    numerator and 1 to the denominator, so one ``groupBy(zip)`` yields both, in place of two
    aggregates and a join.
    """
    codes = _cohort_codes(admissions, codes)
    listed = admissions.where((F.col("year") == int(year)) & has_any("diagnosis", codes)).select(
        "bene_id", F.lit(int(year)).alias("adm_year"), F.lit(True).alias("listed"))
    people = beneficiaries.where(dob_for_age_in_year(year, age_low, age_high)).select("bene_id")
    agg = _zip_rows(listed, enrollments, people, year).groupBy("zip").agg(
        F.sum("n").cast("long").alias("enroll_count"),
        F.sum(F.col("n") * F.coalesce(F.col("_l"), F.lit(0))).cast("long").alias("_listed"))
    diag_final = F.when(F.col("zip").isNull(), F.lit(0).cast("long")).otherwise(F.col("_listed"))
    return (agg.withColumn("diag_final", diag_final)
            .select(share("diag_final", "enroll_count").alias("diag_vs_all_enroll"),
                    "diag_final", "enroll_count", "zip"))
