"""Claims tables derived, by a fixed formula, from the TPC-H-like test tables.

``customer`` gives beneficiaries and enrollments; ``orders`` + ``lineitem``
give admissions with a ranked ``diagnosis`` array. The formula is the one in
``FIXTURES.md``; the same text, written for DuckDB, heads every oracle query
(``FIXTURE_CTE``), so both engines see identical claims tables.
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = tuple(range(1995, 2002))


class Claims(NamedTuple):
    admissions: DataFrame
    beneficiaries: DataFrame
    enrollments: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def beneficiaries_from_customer(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    dob = (F.when(k % 53 == 0, F.lit(None).cast("date"))
           .otherwise(F.make_date((F.lit(1978) + k % 20).cast("int"),
                                  (F.lit(1) + k % 12).cast("int"),
                                  (F.lit(1) + k % 28).cast("int"))))
    s = k % 8
    sex = (F.when(s == 0, "M,U").when(s == 1, "F,U").when(s == 2, "F,M")
           .when(s == 3, "F,M,U").when(s == 4, "U").when(s == 5, "M").otherwise("F"))
    r = k % 9
    race = (F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "0")
            .when(r == 2, "1,2").when(r == 3, "10").otherwise(r.cast("string")))
    return customer.select(k.alias("bene_id"), dob.alias("dob"), sex.alias("sex"),
                           race.alias("race_ethnicity_code"))


def enrollments_from_customer(customer: DataFrame) -> DataFrame:
    # One row per person and year, fanned out by a generator (no join).
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    years = F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year")
    base = customer.select(k, n, years)
    y = F.col("year")

    def _zip(value: Column) -> Column:
        return F.lpad(value.cast("string"), 5, "0")

    regular = base.where((k + y) % 11 != 0).select(
        k.alias("bene_id"), y.cast("int").alias("year"),
        F.when(n == 24, F.lit(None).cast("string"))
        .otherwise(_zip(n * 397 + k % 3)).alias("zip"))
    # A second enrollment in the same year: admissions fan out (trap T5).
    extra = base.where((k + y) % 13 == 0).select(
        k.alias("bene_id"), y.cast("int").alias("year"), _zip(n * 397 + 100).alias("zip"))
    return regular.unionByName(extra)


def _code(p: Column, s: Column) -> Column:
    category = (F.lit(290) + (p + s) % 30).cast("string")
    return (F.when(p % 41 == 0, F.lit(None).cast("string"))
            .when(p % 37 == 0, F.concat(F.lit("E95"), (s % 10).cast("string")))
            .when(p % 4 == 0, (F.lit(400) + p % 100).cast("string"))
            .when(p % 3 == 0, category)
            .otherwise(F.concat(category, (s % 10).cast("string"))))


def admissions_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # collect_list drops NULL elements, so collect structs (never NULL) and
    # project the code out after sorting by line number. An order of the test tables holds 1 to 13
    # line items by the generator's design, so each collected array is bounded.
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey",
                    _code(F.col("l_partkey"), F.col("l_suppkey")).alias("code"))
    dx = (lineitem.groupBy("l_orderkey")
          .agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"])
               .alias("diagnosis")))
    return (orders.join(dx, orders.o_orderkey == dx.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("admission_id"),
                    F.col("o_custkey").alias("bene_id"),
                    F.year("o_orderdate").cast("int").alias("year"),
                    F.col("o_orderdate").cast("date").alias("admission_date"),
                    "diagnosis"))


def claims_from_testdata(spark: SparkSession, sf_dir: str) -> Claims:
    """Lazily derived claims tables (a plan over the test tables, no action)."""
    customer = _table(spark, sf_dir, "customer")
    return Claims(
        admissions=admissions_from_orders(_table(spark, sf_dir, "orders"),
                                          _table(spark, sf_dir, "lineitem")),
        beneficiaries=beneficiaries_from_customer(customer),
        enrollments=enrollments_from_customer(customer),
    )


# The same derivation as DuckDB SQL: the head of every oracle query.
FIXTURE_CTE = """WITH beneficiaries AS (SELECT c_custkey AS bene_id,
 CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE make_date(CAST(1978 + c_custkey % 20 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) END AS dob,
 CASE c_custkey % 8 WHEN 0 THEN 'M,U' WHEN 1 THEN 'F,U' WHEN 2 THEN 'F,M' WHEN 3 THEN 'F,M,U' WHEN 4 THEN 'U' WHEN 5 THEN 'M' ELSE 'F' END AS sex,
 CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '1,2' WHEN 3 THEN '10' ELSE CAST(c_custkey % 9 AS VARCHAR) END AS race_ethnicity_code FROM customer),
enrollments AS (SELECT c_custkey AS bene_id, CAST(y.yr AS INT) AS year,
 CASE WHEN c_nationkey = 24 THEN NULL ELSE lpad(CAST(c_nationkey * 397 + c_custkey % 3 AS VARCHAR), 5, '0') END AS zip
 FROM customer CROSS JOIN (VALUES (1995),(1996),(1997),(1998),(1999),(2000),(2001)) AS y(yr) WHERE (c_custkey + y.yr) % 11 <> 0
 UNION ALL
 SELECT c_custkey, CAST(y.yr AS INT), lpad(CAST(c_nationkey * 397 + 100 AS VARCHAR), 5, '0')
 FROM customer CROSS JOIN (VALUES (1995),(1996),(1997),(1998),(1999),(2000),(2001)) AS y(yr) WHERE (c_custkey + y.yr) % 13 = 0),
dx AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN concat('E95', CAST(l_suppkey % 10 AS VARCHAR))
 WHEN l_partkey % 4 = 0 THEN CAST(400 + l_partkey % 100 AS VARCHAR)
 WHEN l_partkey % 3 = 0 THEN CAST(290 + (l_partkey + l_suppkey) % 30 AS VARCHAR)
 ELSE concat(CAST(290 + (l_partkey + l_suppkey) % 30 AS VARCHAR), CAST(l_suppkey % 10 AS VARCHAR)) END ORDER BY l_linenumber, l_partkey, l_suppkey) AS diagnosis FROM lineitem GROUP BY l_orderkey),
admissions AS (SELECT o_orderkey AS admission_id, o_custkey AS bene_id, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) AS admission_date, diagnosis FROM orders LEFT JOIN dx ON o_orderkey = l_orderkey)
"""
