"""Read and write the claims tables with explicit schemas.

Physical layout for scale (``write_claims``):

* ``admissions`` and ``enrollments`` partitioned by ``year``: the zip queries
  read one year, so the other years are pruned at planning time;
* optionally all three tables bucketed by ``bene_id`` into the same number of
  buckets (``buckets=N``, saved as tables): joins and reductions on ``bene_id``
  then run without a shuffle, and so do the reductions on person and year, zip or day
  that the person histories are made of (``dxcohort.operators.history``). A bucket is
  read by one task: this layout is for keys without very hot ones.

* optionally a summary of the codes in each file of the admissions
  (``code_summary=True``): ``read_claims(codes=...)`` then skips the files that hold no
  listed code, which no minimum and maximum of an array column could tell.

Before writing, rows are dealt out by year and a range of ``bene_id`` (bucketed
tables: by bucket), so that a year or bucket is written by few tasks.

Readers never infer a schema.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxcohort.functions.expr import code_in
from dxcohort.schema import ADMISSIONS, BENEFICIARIES, ENROLLMENTS, with_person_type
from dxcohort.session import scratch_path
from dxcohort.sources.fixture import Claims

NAMES = ("admissions", "beneficiaries", "enrollments")
SCHEMAS = {"admissions": ADMISSIONS, "beneficiaries": BENEFICIARIES,
           "enrollments": ENROLLMENTS}
PARTITION_BY = {"admissions": ("year",), "enrollments": ("year",), "beneficiaries": ()}


def table_schema(name: str, person_type: T.DataType | None = None) -> T.StructType:
    """A table's schema; ``person_type`` is the type of its person key."""
    return with_person_type(SCHEMAS[name], person_type)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast a table to its schema (column order and types). The person
    key is opaque and keeps the type it has."""
    cols = [F.col(f.name) if f.name == "bene_id" else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name].fields if f.name in df.columns]
    return df.select(*cols)


def write_claims(claims: Claims, root: str, mode: str = "overwrite",
                 buckets: int | None = None, table_prefix: str | None = None,
                 code_summary: bool = False) -> None:
    """Write the three tables under ``root`` (Parquet).

    With ``buckets`` set, tables are saved to the session catalog as
    ``{table_prefix}{name}``, bucketed and sorted by ``bene_id``. ``code_summary`` adds
    the codes of each admissions file (:func:`write_code_summary`).
    """
    for name, df in zip(NAMES, claims):
        # Within each task, rows sorted by partition column then person: one
        # open file at a time per task, and tight bene_id min/max statistics
        # in every row group (no shuffle; the sort is local to the task).
        df = conform(df, name)
        if buckets:
            df = df.repartition(int(buckets), "bene_id")
        else:
            # ties of a person are split by a row hash: no person fills a task
            df = df.repartitionByRange(*PARTITION_BY[name], "bene_id",
                                       F.xxhash64(*df.columns))
        df = df.sortWithinPartitions(*PARTITION_BY[name], "bene_id")
        path = f"{root.rstrip('/')}/{name}"
        writer = df.write.mode(mode)
        if PARTITION_BY[name]:
            writer = writer.partitionBy(*PARTITION_BY[name])
        if buckets:
            (writer.bucketBy(int(buckets), "bene_id").sortBy("bene_id")
             .option("path", path).saveAsTable(f"{table_prefix or ''}{name}"))
        else:
            writer.parquet(path)
    if code_summary:
        write_code_summary(claims[0].sparkSession, root)


SUMMARY_SCHEMA = "file string, code string"


def _file_name(file: Column) -> Column:
    """A data file's path below its table's folder, which outlives a move of the table."""
    return F.regexp_extract(file, "/admissions/(.*)$", 1)


def write_code_summary(spark: SparkSession, root: str) -> None:
    """Write ``{root}/admission_codes``: a row for each code in each file of the admissions
    (and one without a code for each file), sorted by code, so a list reads few row groups
    of it. One pass over the arrays; a file's codes are made distinct where it is read."""
    root = root.rstrip("/")
    held = (spark.read.parquet(f"{root}/admissions")
            .select(_file_name(F.col("_metadata.file_path")).alias("file"),
                    F.explode(F.concat(F.array(F.lit(None).cast("string")),
                                       F.coalesce("diagnosis", F.array().cast("array<string>")))).alias("code")))
    rows = held.distinct()
    rows.repartitionByRange("code", "file").sortWithinPartitions("code", "file") \
        .write.mode("overwrite").parquet(f"{root}/admission_codes")


def files_without(spark: SparkSession, root: str, codes: Sequence[str]) -> set[str]:
    """Names of the admissions files that the summary knows to hold no listed code.

    No more names reach the driver than there are files, which Spark's own list of the table
    holds as well. Without a summary, no file is known.
    """
    path = f"{root.rstrip('/')}/admission_codes"
    if not folder_exists(spark, path):
        return set()
    summary = spark.read.schema(SUMMARY_SCHEMA).parquet(path)
    known = summary.where(F.col("code").isNull()).select("file").distinct()
    held = summary.where(code_in("code", codes)).select("file")
    return {r["file"] for r in known.join(held, "file", "left_anti").collect()}


def read_claims(spark: SparkSession, root: str, person_type: T.DataType | None = None,
                codes: Sequence[str] | None = None) -> Claims:
    """Read tables written by :func:`write_claims` (path layout).

    ``codes`` is for queries that ask for admissions with a listed code alone: files that
    hold none by the summary are not read. The other rows of the files that are read stay,
    and the query filters them as ever. Files that the summary does not know are read.
    """
    tables = [spark.read.schema(table_schema(n, person_type)).parquet(f"{root.rstrip('/')}/{n}")
              for n in NAMES]
    skipped = files_without(spark, root, codes) if codes is not None else set()
    if skipped:
        base = f"{root.rstrip('/')}/admissions"
        files = [f for f in tables[0].inputFiles() if f.rpartition("/admissions/")[2] not in skipped]
        tables[0] = (spark.read.schema(table_schema("admissions", person_type))
                     .option("basePath", base).parquet(*files) if files else tables[0].limit(0))
    return Claims(*[t.select(*[f.name for f in SCHEMAS[n].fields]) for n, t in zip(NAMES, tables)])


def read_claims_tables(spark: SparkSession, table_prefix: str = "") -> Claims:
    """Read bucketed tables saved by :func:`write_claims` with ``buckets``."""
    return Claims(*[spark.table(f"{table_prefix}{n}")
                    .select(*[f.name for f in SCHEMAS[n].fields]) for n in NAMES])


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet",
               person_type: T.DataType | None = None) -> DataFrame:
    """One claims table from Parquet, ORC or JSON with its explicit schema."""
    return spark.read.schema(table_schema(name, person_type)).format(fmt).load(path)


def stage_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet to ``path`` (shared storage) and return a
    DataFrame reading it back.

    Used where one intermediate result feeds two branches of a plan: it is
    computed once, and a lost executor costs a re-read. The caller owns the
    folder.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once to a new folder under the shared checkpoint folder, for plans that
    read it several times (a range shuffle reads its input twice, to sample and to
    deal out). The folder goes at the end, so results must be written inside."""
    path = scratch_path(df.sparkSession, name)
    try:
        yield stage_table(df, path)
    finally:
        remove_folder(df.sparkSession, path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark writes it with."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def jdbc_ranges(lower: int, upper: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` contiguous ``[lo, hi)`` ranges covering ``[lower, upper]``."""
    parts = max(1, int(parts))
    span = int(upper) - int(lower) + 1
    step = -(-span // parts)
    return [(lo, min(lo + step, int(upper) + 1))
            for lo in range(int(lower), int(upper) + 1, step)]


def read_claims_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
                     schema_name: str, key_bounds: tuple[int, int] | Sequence[str],
                     partitions: int = 64, years: Sequence[int] = ()) -> Claims:
    """Read the claims tables from a relational warehouse through Spark's JDBC
    source, in parallel: each table is split into ``partitions`` ranges of
    ``bene_id`` (``key_bounds`` = about its min and max, or for text keys the inner bounds
    themselves, such as quantiles of a known key list) and, for the tables with a
    ``year`` column, also by each of ``years`` - so a person with a large
    share of the admissions is read by as many tasks as they have years, and
    no single connection carries a table. The arguments only split the read:
    every row is read once, whatever its id and year, nulls included. Columns are
    cast to the explicit schemas; a ``text[]`` diagnosis column arrives as an array.

    Needs the database's JDBC driver on the classpath. The tests do not
    exercise it, since no database is started here.
    """
    claims = []
    for name in NAMES:
        predicates = jdbc_predicates(key_bounds, partitions,
                                     years if "year" in PARTITION_BY[name] else ())
        df = spark.read.jdbc(url, f"{schema_name}.{name}" if schema_name else name,
                             predicates=predicates, properties=properties)
        claims.append(conform(df, name))
    return Claims(*claims)


def jdbc_predicates(key_bounds: tuple[int, int] | Sequence[str], partitions: int,
                    years: Sequence[int] = ()) -> list[str]:
    """One WHERE clause per read task, which together hold every row once:
    ``bene_id`` ranges (the first and the last open, NULL with the first), times
    each of ``years`` and any other year. Of text bounds there are one less than
    ranges, whatever ``partitions`` says; a range takes what lies below its bound and
    below none before it, so every row is read once in any collation."""
    text = any(isinstance(b, str) for b in key_bounds)
    if text:
        inner = ["'" + str(b).replace("'", "''") + "'" for b in sorted(set(key_bounds))]
    else:
        inner = [hi for _, hi in jdbc_ranges(*key_bounds, partitions)[:-1]]
    lower = [inner[:i] if text else inner[max(0, i - 1):i] for i in range(len(inner) + 1)]
    keys = [" AND ".join([f"bene_id >= {lo}" for lo in below] + [f"bene_id < {hi}"] * (hi is not None))
            for below, hi in zip(lower, [*inner, None])]
    keys[0] = f"({keys[0]} OR bene_id IS NULL)" if keys[0] else "1 = 1"
    if not years:
        return keys
    listed = ", ".join(str(int(y)) for y in sorted(set(years)))
    when = [f"year = {int(y)}" for y in sorted(set(years))] \
        + [f"(year NOT IN ({listed}) OR year IS NULL)"]
    return [f"{k} AND {w}" for k in keys for w in when]
