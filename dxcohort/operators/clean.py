"""Blank contradictory demographics: a person recorded with several sexes, or
with several (or an invalid) race codes, gets NULL instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dxcohort.functions.expr import blank_if_in, blank_if_matches

# Sex values that mix categories, and the race pattern (a comma,
# or a zero anywhere - so "10" is blanked too).
AMBIGUOUS_SEX = ("M,U", "F,U", "F,M", "F,M,U")
AMBIGUOUS_RACE_PATTERN = ",|0"


def blank_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.withColumn(column, blank_if_in(column, values))


def blank_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.withColumn(column, blank_if_matches(column, pattern))


def blank_ambiguous_demographics(df: DataFrame, sex: str = "sex",
                                 race: str = "race_ethnicity_code") -> DataFrame:
    """Idempotent; column order and all other columns unchanged."""
    return blank_matching(blank_values(df, sex, AMBIGUOUS_SEX), race, AMBIGUOUS_RACE_PATTERN)
