"""Code-level operators: unnest by position, count per code, top-k, ordering
and small-cell suppression.

Counting is a ``groupBy`` with ``count``: Spark aggregates partially on the map
side, so only one row per (task, code) crosses the shuffle however hot a code
is. The counts table is bounded by the number of distinct codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxcohort.functions.expr import primary_code, secondary_codes

POSITIONS = ("all", "primary", "secondary")


def explode_codes(df: DataFrame, position: str = "all",
                  diagnosis: str = "diagnosis", out: str = "diag") -> DataFrame:
    """One row per code at the chosen positions, with its 0-based ``pos``.

    ``all``: every element (``unnest(diagnosis)``); NULL or empty arrays give no
    row, NULL elements give a NULL code. ``secondary``: elements 2.. only
    (``unnest(diagnosis[2:])``). ``primary``: exactly one row per input row,
    the first element or NULL (``diagnosis[1]``).
    """
    if position == "all":
        return df.select("*", F.posexplode(diagnosis).alias("pos", out))
    if position == "secondary":
        return (df.select("*", F.posexplode(secondary_codes(diagnosis)).alias("_p", out))
                .withColumn("pos", F.col("_p") + 1).drop("_p"))
    if position == "primary":
        return df.withColumn(out, primary_code(diagnosis)).withColumn("pos", F.lit(0))
    raise ValueError(f"position must be one of {POSITIONS}, got {position!r}")


def code_counts(rows: DataFrame, group_cols: Sequence[str] = (), code: str = "diag",
                out: str = "diag_count") -> DataFrame:
    """``COUNT(code) ... GROUP BY code``: a NULL code is a group with count 0."""
    return rows.groupBy(*group_cols, code).agg(F.count(code).alias(out))


def count_order(code: str = "diag", count: str = "diag_count"):
    """Descending count; ties broken by code so results are reproducible."""
    return [F.col(count).desc(), F.col(code).asc_nulls_last()]


def ordered(counts: DataFrame, code: str = "diag", count: str = "diag_count") -> DataFrame:
    return counts.orderBy(*count_order(code, count))


def top_k(counts: DataFrame, k: int, group_cols: Sequence[str] = (),
          code: str = "diag", count: str = "diag_count") -> DataFrame:
    """The ``k`` most frequent codes (per group when ``group_cols`` is set).

    Without groups this is sort + limit, planned as ``TakeOrderedAndProject``
    (a per-task top-k, then a final merge). With groups it is a ranking window
    over the small counts table.
    """
    if not group_cols:
        return counts.orderBy(*count_order(code, count)).limit(int(k))
    w = Window.partitionBy(*group_cols).orderBy(*count_order(code, count))
    return (counts.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= int(k)).drop("_rank"))


def suppress_small_cells(df: DataFrame, count: str = "diag_count",
                         min_cell: int = 10) -> DataFrame:
    """Disclosure rule: keep only counts strictly greater than ``min_cell``."""
    return df.where(F.col(count) > int(min_cell))


# --- code lists held as tables --------------------------------------------------

def checked_code_table(codes: DataFrame, code: str = "code",
                       max_codes: int | None = None) -> DataFrame:
    """Distinct codes of a code-list table, after checking it holds at most
    ``max_codes`` (default: the code-list bound) so it may be broadcast."""
    from dxcohort.sources.codelists import MAX_LIST_CODES
    bound = MAX_LIST_CODES if max_codes is None else int(max_codes)
    table = codes.select(F.col(code).alias("_code")).where(F.col("_code").isNotNull()).distinct()
    if table.limit(bound + 1).count() > bound:
        raise ValueError(f"code table holds more than {bound} codes; not a code list")
    return table


def codes_in_table(rows: DataFrame, codes: DataFrame, code: str = "diag") -> DataFrame:
    """Rows whose ``code`` is in a code-list table: a broadcast left-semi join
    (``code IN (SELECT code FROM list)``), evaluated map-side."""
    table = checked_code_table(codes)
    return rows.join(F.broadcast(table), rows[code] == table["_code"], "left_semi")


def rows_with_listed_code(df: DataFrame, codes: DataFrame,
                          diagnosis: str = "diagnosis") -> DataFrame:
    """Rows of ``df`` whose array holds a code of a code-list table
    (``diagnosis && list`` with the list as a table).

    The list is read (its size is checked, as for every code list) and becomes
    literals of the array test, so the rows of ``df`` are neither exploded nor
    shuffled.
    """
    from dxcohort.functions.expr import has_any
    listed = [r["_code"] for r in checked_code_table(codes).collect()]
    return df.where(has_any(diagnosis, sorted(listed)))
