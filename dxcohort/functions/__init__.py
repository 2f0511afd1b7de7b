"""Column expressions (built-in Spark functions only)."""

from dxcohort.functions.expr import (
    age_at_admission,
    age_in_year,
    blank_if_in,
    blank_if_matches,
    code_in,
    disease_flags,
    dob_for_age_in_year,
    flag,
    has_any,
    in_band,
    positional_codes,
    primary_code,
    primary_code_in,
    secondary_codes,
    secondary_has_any,
    share,
    zero_fill,
)

__all__ = [
    "age_at_admission", "age_in_year", "blank_if_in", "blank_if_matches", "code_in",
    "disease_flags", "dob_for_age_in_year", "flag", "has_any", "in_band",
    "positional_codes", "primary_code", "primary_code_in", "secondary_codes",
    "secondary_has_any", "share", "zero_fill",
]
