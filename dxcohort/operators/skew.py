"""Keys that hold a large share of the rows.

Joins of claims tables are plain equi-joins. When both sides are shuffled, adaptive
execution splits a reducer that is far larger than the others into several tasks, each
of which reads some map outputs of the large side and the whole matching side
(``spark.sql.adaptive.skewJoin``). The split goes by map output, not by value, so equal
rows spread as well, no key needs to be found or counted first, and nothing is capped.

It applies where the stage above the join does not need a key's rows together. So
everything that groups by a join key is reduced before the join (per person and year,
per person and day), or groups by other columns after it, as the count per code does.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Session settings the plans count on; on by default in Spark, stated for clarity.
SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def holds_map(dt: T.DataType) -> bool:
    """Whether a type has a map in it (maps cannot be hashed)."""
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return holds_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(holds_map(f.dataType) for f in dt.fields)
    return False
