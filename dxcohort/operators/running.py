"""Running count per person: ``count(*) OVER (PARTITION BY bene_id ORDER BY
admission_date)``.

The SQL has no frame clause, so the frame is RANGE UNBOUNDED PRECEDING .. CURRENT
ROW: rows on the same date are peers and share the larger number.

A plain window would sort each person's whole history inside one task, and one
person may hold a large share of all rows. Instead:

1. count rows per (person, date): partial aggregation shrinks every person to
   at most one row per calendar day before the shuffle;
2. run the cumulative sum over those day rows (per person, bounded by the
   number of days in the data span);
3. join the day totals back on (person, date), nulls matching nulls. The join spreads
   a person over their dates; a single day with very many rows is split by adaptive
   execution (``dxcohort.operators.skew``).

The result is that of the RANGE window for every input, ties and nulls included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_count(df: DataFrame, key: str = "bene_id", order: str = "admission_date",
                  out: str = "n_th_admission") -> DataFrame:
    """Add ``out``: rows of the same ``key`` with ``order`` at or before this
    row's (a NULL ``order`` comes last, a NULL ``key`` is a person of its own)."""
    per_day = df.groupBy(F.col(key).alias("_rk"), F.col(order).alias("_ro")).agg(
        F.count(F.lit(1)).alias("_n_day"))
    w = (Window.partitionBy("_rk").orderBy(F.col("_ro").asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = per_day.select("_rk", "_ro", F.sum("_n_day").over(w).cast("long").alias(out))
    same = F.col(key).eqNullSafe(F.col("_rk")) & F.col(order).eqNullSafe(F.col("_ro"))
    return df.join(totals, same).drop("_rk", "_ro")
