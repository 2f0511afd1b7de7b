"""Helpers shared by the operators: inputs, scratch tables, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import remove_folder

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows that go to Python together hold about so many bytes (a longer row goes alone).
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, spent: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives
    the loss of any executor. The folder's name is added to ``spent``, for ``discard``."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if spent is not None:
        spent.append(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """Limit the bytes that the session hands to Python at once, unless it has a limit set. It
    stays set: a result is planned and run after the function that returned it."""
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def fresh(taken: list[str], name: str) -> str:
    """A working column's name that no column of the caller has (Spark ignores case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def discard(spark: SparkSession, spent: list[str]) -> None:
    """Remove written tables that no later step reads."""
    while spent:
        remove_folder(spark, spent.pop())


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected link table with 64-bit ids.

    Alternates large-star and small-star steps (each one shuffle by node) until
    the links no longer change; every step keeps at most as many links as the
    one before. Each step is written to the shared folder. Nothing is collected
    but two sums that tell whether a step changed anything.

    Returns ``(node, root)`` for every node that has a link; ``root`` is the
    smallest id of its component, itself included.
    """
    spark, spent = links.sparkSession, []
    edges = written(links.select(F.col(left).cast("long").alias("u"),
                                 F.col(right).cast("long").alias("v"))
                    .where("u is not null and v is not null and u <> v").distinct(),
                    "links", spent)

    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select(
            "u", F.least("u", "_m").alias("_m"))
        # large star: link every larger neighbour to the smallest one
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .where("u <> v").distinct())
        large = written(large, "large", spent)
        # small star: every smaller neighbour, and the node, to the smallest one
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("_m"))
        small = (down.join(small_low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .unionByName(small_low.select("u", F.col("_m").alias("v")))
                 .where("u <> v").distinct())
        last: list[str] = []
        edges = written(small, "small", last)
        discard(spark, spent)
        spent = last
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["SPACE", "UPPER", "LOWER", "table", "scratch", "written", "limit_batches", "fresh", "discard",
           "text_of", "components"]
