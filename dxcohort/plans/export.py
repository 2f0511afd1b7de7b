"""Write results as CSV and read the extract back.

Writes are distributed (one file per task, no ``coalesce(1)``). CSV cannot
hold arrays, so ``diagnosis`` is written as JSON text, which keeps NULL
elements. Several age bands / positions go to one output partitioned by
those columns instead of one file name per run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxcohort.plans.extract import EXTRACT_COLUMNS
from dxcohort.schema import EXTRACT, EXTRACT_CSV, with_person_type
from dxcohort.sources.tables import stage_table, staged


def _encode_arrays(df: DataFrame) -> DataFrame:
    cols = [F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def _tiebreak(df: DataFrame):
    """A deterministic row hash used as the last sort key: rows that tie on
    the sort keys (one person-day with a large share of the rows) can then
    fall into different range partitions instead of one task."""
    from dxcohort.operators.skew import holds_map
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields
                        if not holds_map(f.dataType)])


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (),
              null_value: str | None = None, mode: str = "overwrite",
              sort_by: Sequence[str] = ()) -> None:
    """Header row, no index column. ``null_value='NA'`` writes R-style
    missing values. ``sort_by`` orders rows globally (a range shuffle; ties
    are split by a row hash so no sort key can pin a third of the rows on one
    task). The rows are staged first, so that the range shuffle samples a table and
    ``df`` is evaluated once."""
    out = _encode_arrays(df)
    with staged(out, "csv-rows") if sort_by else nullcontext(out) as out:
        if sort_by:
            out = out.orderBy(*[F.col(c).asc_nulls_last() for c in sort_by], _tiebreak(out))
        _csv_writer(out, partition_by, null_value, mode).csv(path)


def _csv_writer(out: DataFrame, partition_by: Sequence[str], null_value: str | None, mode: str):
    writer = out.write.mode(mode).option("header", True)
    if null_value is not None:
        writer = writer.option("nullValue", null_value)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_extract(extract: DataFrame, path: str, sort: bool = True,
                  partition_by: Sequence[str] = (), null_value: str | None = None,
                  mode: str = "overwrite") -> None:
    """The extract ordered by person and admission date (optional)."""
    write_csv(extract, path, partition_by, null_value, mode,
              sort_by=("bene_id", "admission_date") if sort else ())


def read_extract(spark: SparkSession, path: str, null_value: str | None = None,
                 person_type: T.DataType | None = None) -> DataFrame:
    """Read an extract CSV with the explicit schema (never inferred: zips keep
    leading zeros, an all-``F`` sex column stays text). ``person_type`` is the type
    of the person key where it is no number."""
    reader = spark.read.schema(with_person_type(EXTRACT_CSV, person_type)).option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    df = reader.csv(path)
    diag_type = EXTRACT["diagnosis"].dataType
    return df.withColumn("diagnosis", F.from_json("diagnosis", diag_type)).select(*EXTRACT_COLUMNS)


def run_and_export(build: Callable[..., DataFrame], bands: Sequence[tuple[int, int]],
                   path: str, partition_by: Sequence[str] = ("age_low", "age_high"),
                   **kwargs) -> None:
    """Run a band-aware query for all bands in one pass and write one output,
    partitioned by band (one action, no driver-side loop over bands)."""
    write_csv(build(bands=bands, **kwargs), path, partition_by)


def export_code_counts(admissions: DataFrame, beneficiaries: DataFrame,
                       bands: Sequence[tuple[int, int]], path: str,
                       codes: Sequence[str] | None = None,
                       positions: Sequence[str] = ("all", "primary", "secondary")) -> None:
    """All positions and bands of the code counts in one output
    ``position=.../age_low=.../age_high=...``, each part ordered by count.

    The counts come from one pass over the admissions
    (:func:`dxcohort.plans.counts.code_counts_by_position`); each part holds
    at most one row per distinct code, so one task writes it in order.
    """
    from dxcohort.plans.counts import code_counts_by_position
    out = code_counts_by_position(admissions, beneficiaries, bands, codes, positions)
    out = out.repartition("position", "age_low", "age_high").sortWithinPartitions(
        "position", "age_low", "age_high", F.col("diag_count").desc(),
        F.col("diag").asc_nulls_last())
    write_csv(out, path, ("position", "age_low", "age_high"))


def export_individual_records(admissions: DataFrame, beneficiaries: DataFrame,
                              enrollments: DataFrame, codes: Sequence[str],
                              flag_lists: Mapping[str, Sequence[str]],
                              bands: Sequence[tuple[int, int]], path: str,
                              blank_ambiguous: bool = False, null_value: str | None = None,
                              stage: str | None = None) -> None:
    """The individual extract for several bands from one pass, written as one
    output ``age_low=.../age_high=...``; rows in each band ordered by person
    and admission date (a range shuffle on the band and sort keys, so no
    task holds a whole band). The extract is staged in the shared checkpoint folder, so it
    is evaluated once; ``stage`` names another folder, which then stays."""
    from dxcohort.plans.extract import individual_extract_bands
    out = individual_extract_bands(admissions, beneficiaries, enrollments, codes, flag_lists,
                                   bands, blank_ambiguous=blank_ambiguous)
    with nullcontext(stage_table(out, stage)) if stage else staged(out, "records") as out:
        keys = [F.col("age_low"), F.col("age_high"), F.col("bene_id").asc_nulls_last(),
                F.col("admission_date").asc_nulls_last(), _tiebreak(out)]
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
        write_csv(out, path, ("age_low", "age_high"), null_value)


def read_individual_records(spark: SparkSession, path: str, null_value: str | None = None,
                            person_type: T.DataType | None = None) -> DataFrame:
    """Read an output of :func:`export_individual_records` (bands as columns)."""
    schema = T.StructType(with_person_type(EXTRACT_CSV, person_type).fields + [T.StructField("age_low", T.IntegerType()),
                                                T.StructField("age_high", T.IntegerType())])
    df = read_csv(spark, path, schema, null_value)
    diag_type = EXTRACT["diagnosis"].dataType
    return df.withColumn("diagnosis", F.from_json("diagnosis", diag_type))


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             null_value: str | None = None,
             options: Mapping[str, str] | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.csv(path)
