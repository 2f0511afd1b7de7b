"""Cohort assembly: person and enrollment joins, year filters, age bands.

All joins are equi-joins on ``bene_id`` (and ``year``). No broadcast hint is
placed on a claims table: Spark broadcasts a side only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time), and
otherwise shuffles both sides on the key. A person holding a large share of the
admissions is split over many tasks at run time (``dxcohort.operators.skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxcohort.functions.expr import age_at_admission

Band = tuple[int, int]


def with_person(admissions: DataFrame, beneficiaries: DataFrame,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Inner join admissions to people on ``bene_id`` (admissions without a
    person row are dropped). ``columns`` limits the person columns carried
    (``bene_id`` is always kept)."""
    people = beneficiaries if columns is None else beneficiaries.select(
        "bene_id", *[c for c in columns if c != "bene_id"])
    return admissions.join(people, "bene_id")


def with_age(df: DataFrame, name: str = "age") -> DataFrame:
    """Add the age at admission (calendar-year difference)."""
    return df.withColumn(name, age_at_admission())


def with_enrollment(admissions: DataFrame, enrollments: DataFrame,
                    year: int | None = None) -> DataFrame:
    """Join each admission to the enrollment rows of its own year.

    With ``year`` set, both tables are first restricted to that year (the
    constraint reaches both Parquet scans). Several enrollment rows for one
    person and year multiply the admission, as in the source SQL; admissions
    without an enrollment that year are dropped.
    """
    if year is not None:
        admissions = admissions.where(F.col("year") == int(year))
        enrollments = enrollments.where(F.col("year") == int(year))
    return admissions.join(enrollments, ["bene_id", "year"])


def enrolled_people(enrollments: DataFrame, beneficiaries: DataFrame,
                    year: int) -> DataFrame:
    """Enrollment rows of ``year`` with the person's columns."""
    return enrollments.where(F.col("year") == int(year)).join(beneficiaries, "bene_id")


def one_enrollment_per_year(enrollments: DataFrame) -> DataFrame:
    """Optional clean-up (off by default everywhere): keep one row per person
    and year, the smallest zip (NULL last), so joins no longer fan out."""
    return (enrollments.groupBy("bene_id", "year")
            .agg(F.min("zip").alias("zip")))


def _band_array(bands: Sequence[Band]) -> Column:
    return F.array(*[F.struct(F.lit(int(lo)).alias("age_low"),
                              F.lit(int(hi)).alias("age_high")) for lo, hi in bands])


def with_bands(df: DataFrame, bands: Sequence[Band], age: str = "age") -> DataFrame:
    """Keep rows whose age falls in a band, tagged ``age_low``/``age_high``.

    Bands may overlap (0-18 holds 0-12 and 13-18), so a row is repeated once per
    band it falls in: a generator over a literal array of at most a few bands,
    never a join. The overall range is applied first as a plain filter, which
    Catalyst pushes below joins and into scans.
    """
    bands = list(dict.fromkeys((int(lo), int(hi)) for lo, hi in bands))
    if not bands:
        raise ValueError("at least one age band is required")
    lo_all = min(lo for lo, _ in bands)
    hi_all = max(hi for _, hi in bands)
    df = df.where(F.col(age).between(lo_all, hi_all))
    if len(bands) == 1:
        lo, hi = bands[0]
        return df.withColumn("age_low", F.lit(lo)).withColumn("age_high", F.lit(hi))
    a = F.col(age)
    matching = F.filter(_band_array(bands),
                        lambda b: (a >= b["age_low"]) & (a <= b["age_high"]))
    return (df.withColumn("_band", F.explode(matching))
            .withColumn("age_low", F.col("_band.age_low"))
            .withColumn("age_high", F.col("_band.age_high"))
            .drop("_band"))


def normalize_bands(bands: Band | Sequence[Band]) -> list[Band]:
    """Accept one ``(low, high)`` pair or a list of them (a band given twice counts once)."""
    if len(bands) == 2 and all(isinstance(x, int) for x in bands):
        return [(int(bands[0]), int(bands[1]))]
    return list(dict.fromkeys((int(lo), int(hi)) for lo, hi in bands))
