"""One row per person with all that their admissions need from elsewhere: demographics,
the zips of each year, and the running admission number at each day.

The listed admissions of a person are counted per (year, day) and their enrollments per
(year, zip), both combined on the map side, so a history holds at most as many entries as
there are days and zips, however many rows lie behind them. The histories of all tables
share one distribution, by person, and the running number is worked out inside a history:
the admissions themselves are joined once, to one row per person, and need no second
evaluation for day totals and no shuffle on (person, day).

Working the numbers out takes the square of a person's days (not rows), once a person.

On tables bucketed by person nothing here is shuffled but the finished histories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERSON_COLUMNS = ("dob", "sex", "race_ethnicity_code")


def counted_per_person(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """``bene_id``, ``out``: the distinct values of ``columns`` with their number of rows
    ``n``, as an array; and the key again as ``person``."""
    return (df.groupBy("bene_id", *columns).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bene_id").agg(F.collect_list(F.struct(*columns, "n")).alias(out),
                                    F.max("bene_id").alias("person")))


def histories(listed: DataFrame, beneficiaries: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per row of ``beneficiaries`` with listed admissions: ``person``, its demographics,
    ``homes`` (year, zip, n), and parallel arrays ``days`` and ``upto``: the rows of
    listed admissions x enrollments of their year (x rows of the person) at or before each
    day; ``total`` counts those without a day, too, as they come last.

    ``listed`` needs ``bene_id``, ``year`` and ``admission_date``.
    """
    days = counted_per_person(listed, ["year", "admission_date"], "_days")
    homes = counted_per_person(enrollments, ["year", "zip"], "homes").drop("person")
    people = counted_per_person(beneficiaries, PERSON_COLUMNS, "_people").drop("person")
    # an admission counts once for each enrollment of its year and row of its person
    copies = "aggregate(_people, 0L, (s, p) -> s + p.n)"
    in_year = "aggregate(homes, 0L, (s, h) -> s + if(h.year = d.year, h.n, 0L))"
    weighed = f"""filter(transform(_days, d -> named_struct(
        'day', d.admission_date, 'n', d.n * {in_year} * {copies})), d -> d.n > 0)"""
    upto = """transform(_w, d -> aggregate(_w, 0L, (s, x) ->
        s + if(d.day is null or x.day <= d.day, x.n, 0L)))"""
    # the key comes from an aggregate, so the join to admissions shuffles both sides, and
    # adaptive execution can split a person with very many of them
    return (days.join(homes, "bene_id").join(people, "bene_id")
            .withColumn("_w", F.expr(weighed))
            .select("person", "homes", F.expr("transform(_w, d -> d.day)").alias("days"),
                    F.expr(upto).alias("upto"),
                    F.expr("aggregate(_w, 0L, (s, d) -> s + d.n)").alias("total"),
                    F.explode(F.expr("flatten(transform(_people, p -> array_repeat(p, cast(p.n as int))))"))
                    .alias("_p"))
            .select("person", "homes", "days", "upto", "total",
                    *[F.col(f"_p.{c}").alias(c) for c in PERSON_COLUMNS]))


def with_history(admissions: DataFrame, history: DataFrame,
                 out: str = "n_th_admission") -> DataFrame:
    """Admissions x the enrollments of their year x people, with the running number.

    A row for each enrollment of the admission's own year; admissions without one, or
    without a person, are dropped.
    """
    zips = """flatten(transform(filter(homes, h -> h.year = year),
        h -> array_repeat(h.zip, cast(h.n as int))))"""
    number = "coalesce(get(upto, cast(array_position(days, admission_date) as int) - 1), total)"
    return (admissions.join(history, F.col("bene_id") == F.col("person"))
            .select("*", F.explode(F.expr(zips)).alias("zip"))
            .select(*[F.col(f"`{c}`") for c in admissions.columns], "zip", *PERSON_COLUMNS,
                    F.expr(number).alias(out)))
