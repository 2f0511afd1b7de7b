"""Column expressions: ages, positional codes, code-list membership, flags,
shares and blanking. All are built-in Spark expressions (JVM side, no UDF).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dxcohort.schema import N_POSITIONAL

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- ages -------------------------------------------------------------------

def age_at_admission(admission_date: ColumnOrName = "admission_date",
                     dob: ColumnOrName = "dob") -> Column:
    """Difference of calendar years (not completed years): born 31 Dec and
    admitted 1 Jan of the next year is age 1. NULL when ``dob`` is NULL."""
    return (F.year(_col(admission_date)) - F.year(_col(dob))).cast("int")


def age_in_year(year: int, dob: ColumnOrName = "dob") -> Column:
    """Age reached in calendar ``year``: ``year - year(dob)``."""
    return (F.lit(int(year)) - F.year(_col(dob))).cast("int")


def dob_for_age_in_year(year: int, low: int, high: int,
                        dob: ColumnOrName = "dob") -> Column:
    """``age_in_year(year) BETWEEN low AND high`` restated on ``dob`` alone, so
    the predicate reaches the Parquet scan as a min/max range filter."""
    clamp = lambda y: min(max(y, _dt.MINYEAR), _dt.MAXYEAR)
    first = _dt.date(clamp(int(year) - int(high)), 1, 1)
    last = _dt.date(clamp(int(year) - int(low)), 12, 31)
    # ISO text, cast: the gateway cannot pass dates before year 1000.
    return _col(dob).between(F.lit(first.isoformat()).cast("date"),
                             F.lit(last.isoformat()).cast("date"))


def in_band(age: ColumnOrName, low: int, high: int) -> Column:
    """Closed age range ``low <= age <= high`` (NULL age is out)."""
    return _col(age).between(int(low), int(high))


# --- positional codes ---------------------------------------------------------

def primary_code(diagnosis: ColumnOrName = "diagnosis") -> Column:
    """First element, NULL for a NULL or empty array (never raises)."""
    return F.get(_col(diagnosis), F.lit(0))


def secondary_codes(diagnosis: ColumnOrName = "diagnosis") -> Column:
    """All elements but the first, order kept; NULL for a NULL array."""
    d = _col(diagnosis)
    return F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0)))


def positional_codes(diagnosis: ColumnOrName = "diagnosis",
                     n: int = N_POSITIONAL) -> list[Column]:
    """``diag1`` .. ``diag{n}``; positions past the array end are NULL."""
    d = _col(diagnosis)
    return [F.get(d, F.lit(i)).alias(f"diag{i + 1}") for i in range(n)]


# --- code-list membership -------------------------------------------------------

def _codes(codes: Iterable[str]) -> list[str]:
    if isinstance(codes, str):
        raise TypeError("codes must be a collection of code strings, not one string")
    return sorted({str(c) for c in codes})


def _sql_literals(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
                     for v in values)


def _sql_ref(c: ColumnOrName) -> str | None:
    """SQL text for a plain column name, else None."""
    if isinstance(c, str) and "`" not in c:
        return ".".join(f"`{part}`" for part in c.split("."))
    return None


# Large code lists are emitted as one SQL expression, parsed once on the JVM:
# building ``isin`` from Python costs one gateway call per code.
def _array_has_any_sql(array_sql: str, values: Sequence[str]) -> Column:
    return F.expr(f"CASE WHEN {array_sql} IS NULL THEN NULL ELSE coalesce("
                  f"exists({array_sql}, x -> x IN ({_sql_literals(values)})), false) END")


def has_any(diagnosis: ColumnOrName, codes: Iterable[str]) -> Column:
    """True when the array holds at least one of ``codes`` (exact match).

    ``exists`` over an ``IN`` set is a hash lookup per element, evaluated inside
    the scan stage: no join, no shuffle. Three-valued like PostgreSQL's
    ``&&``: NULL for a NULL array, false when nothing matches even if the array
    holds NULL elements (``exists`` alone would give NULL there). An empty list
    overlaps nothing.
    """
    values = _codes(codes)
    ref = _sql_ref(diagnosis)
    d = _col(diagnosis)
    if not values:
        return F.when(d.isNotNull(), F.lit(False))
    if ref is not None:
        return _array_has_any_sql(ref, values)
    return F.when(d.isNotNull(),
                  F.coalesce(F.exists(d, lambda x: x.isin(values)), F.lit(False)))


def secondary_has_any(diagnosis: str, codes: Iterable[str]) -> Column:
    """``has_any(secondary_codes(diagnosis), codes)`` for a named column."""
    values = _codes(codes)
    ref = _sql_ref(diagnosis)
    if ref is None or not values:
        return has_any(secondary_codes(diagnosis), values)
    return _array_has_any_sql(f"slice({ref}, 2, greatest(size({ref}) - 1, 0))", values)


def primary_code_in(diagnosis: str, codes: Iterable[str]) -> Column:
    """``code_in(primary_code(diagnosis), codes)`` for a named column."""
    values = _codes(codes)
    ref = _sql_ref(diagnosis)
    if ref is None or not values:
        return code_in(primary_code(diagnosis), values)
    return F.expr(f"get({ref}, 0) IN ({_sql_literals(values)})")


def code_in(code: ColumnOrName, codes: Iterable[str]) -> Column:
    """Scalar membership ``code IN (...)``; an empty list matches nothing."""
    values = _codes(codes)
    if not values:
        return F.lit(False)
    ref = _sql_ref(code)
    if ref is not None:
        return F.expr(f"{ref} IN ({_sql_literals(values)})")
    return _col(code).isin(values)


def flag(diagnosis: ColumnOrName, codes: Iterable[str]) -> Column:
    """1 when the array holds a listed code, else 0 (NULL array gives 0)."""
    return F.when(has_any(diagnosis, codes), F.lit(1)).otherwise(F.lit(0))


def disease_flags(code_lists: dict[str, Sequence[str]], names: Sequence[str],
                  diagnosis: ColumnOrName = "diagnosis") -> list[Column]:
    """One 0/1 flag column per named list, in the order of ``names``."""
    return [flag(diagnosis, code_lists[name]).alias(name) for name in names]


# --- arithmetic -----------------------------------------------------------------

def share(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """A fraction (not a percentage) in double precision."""
    return _col(numerator).cast("double") / _col(denominator).cast("double")


def zero_fill(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c), F.lit(0))


# --- blanking ---------------------------------------------------------------------

def blank_if_in(c: ColumnOrName, values: Sequence[str]) -> Column:
    """NULL when the value is one of ``values``; a NULL stays NULL."""
    col = _col(c)
    return F.when(col.isin(list(values)), F.lit(None).cast("string")).otherwise(col)


def blank_if_matches(c: ColumnOrName, pattern: str) -> Column:
    """NULL when the value matches the regular expression anywhere."""
    col = _col(c)
    return F.when(col.rlike(pattern), F.lit(None).cast("string")).otherwise(col)
