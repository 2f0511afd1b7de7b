"""Named queries over the claims tables derived from a test-data folder.

Each builder takes ``(spark, claims)`` and returns a DataFrame. Building starts no job
but bounded reads of code lists; only the round trips through files (``FILE_QUERIES``)
write while they are built.
``queries()`` binds them to the claims derived from a test-data folder.
Parameters follow the source queries' own runs: year 1998 for the zip queries (a
year present in the data), bands 0-18, 0-12 and 13-18, the current lists for
cohort queries and the older 290-319 list for list-restricted code counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxcohort.functions.expr import (
    age_at_admission,
    age_in_year,
    has_any,
    positional_codes,
    primary_code,
    secondary_codes,
)
from dxcohort.operators.clean import (
    AMBIGUOUS_RACE_PATTERN,
    AMBIGUOUS_SEX,
    blank_ambiguous_demographics,
    blank_matching,
    blank_values,
)
from dxcohort.operators.codes import code_counts as count_codes, explode_codes, suppress_small_cells
from dxcohort.operators.cohort import enrolled_people, with_person
from dxcohort.operators.hierarchy import (
    ICD9_ALL_PARENTS,
    STANDARD_RULES,
    build_code_lists,
    codes_in_admissions,
    expand_children,
    expand_range,
)
from dxcohort.operators.running import running_count
from dxcohort.plans import counts as C
from dxcohort.plans import extract as X
from dxcohort.plans import rates as R
from dxcohort.schema import FLAG_LISTS
from dxcohort.sources.codelists import standard_lists
from dxcohort.sources.fixture import Claims, claims_from_testdata

ZIP_YEAR = 1998
FULL_BAND = (0, 18)
BANDS = {"": (0, 18), "_0_12": (0, 12), "_13_18": (13, 18)}
ALL_BANDS = [(0, 18), (0, 12), (13, 18)]
COHORT_LIST = "icd9_all"
RANGE_LIST = "icd9"

# Queries that write files (or a sorted table) while they are built.
FILE_QUERIES = {"csv_round_trip", "run_and_export", "export_individual_records",
                "scan_admissions", "scan_beneficiaries", "scan_enrollments",
                "listed_admissions_from_files", "code_list_file",
                "one_named_list", "parent_codes", "code_table_round_trip",
                "disease_flags_from_file", "code_counts_order", "zip_share_order", "extract_order"}

Query = Callable[[SparkSession, str], DataFrame]
Builder = Callable[[SparkSession, Claims], DataFrame]


def claims(spark: SparkSession, sf_dir: str) -> Claims:
    """Claims tables derived from the test tables in ``sf_dir`` (lazy)."""
    return claims_from_testdata(spark, sf_dir)


def _lists(spark: SparkSession) -> dict[str, list[str]]:
    return standard_lists(spark)


def _zip_query(fn, with_codes: bool = True) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        args = [c.admissions, c.beneficiaries, c.enrollments, ZIP_YEAR, *FULL_BAND]
        if with_codes:
            args.append(_lists(spark)[COHORT_LIST])
        return fn(*args)
    return run


def _top(position: str, list_name: str | None, code_col: str = "diag") -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        codes = _lists(spark)[list_name] if list_name else None
        return C.top_codes(c.admissions, c.beneficiaries, *FULL_BAND, position, codes,
                           20, code_col)
    return run


def _counts(position: str, band, list_name: str | None = None) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        codes = _lists(spark)[list_name] if list_name else None
        return C.code_counts_in_band(c.admissions, c.beneficiaries, *band, position, codes)
    return run


def _first_counts(position: str, band, list_name: str | None) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        codes = _lists(spark)[list_name] if list_name else None
        return C.first_admission_counts_in_band(c.admissions, c.beneficiaries, *band,
                                                position, codes)
    return run


def _first_total(position: str, band) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        return C.first_admission_total_in_band(c.admissions, c.beneficiaries, *band, position)
    return run


def _extract(band, blank: bool = False) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        lists = _lists(spark)
        return X.individual_extract(c.admissions, c.beneficiaries, c.enrollments, *band,
                                    lists[COHORT_LIST], lists, FLAG_LISTS, blank)
    return run


def _counts_all_bands(position: str, list_name: str | None = None) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        codes = _lists(spark)[list_name] if list_name else None
        return C.code_counts(c.admissions, c.beneficiaries, ALL_BANDS, position, codes)
    return run


def _first_counts_all_bands(position: str, list_name: str | None) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        codes = _lists(spark)[list_name] if list_name else None
        return C.first_admission_counts(c.admissions, c.beneficiaries, ALL_BANDS, position,
                                        codes)
    return run


def _extract_all_bands(spark: SparkSession, c: Claims) -> DataFrame:
    lists = _lists(spark)
    return X.individual_extract_bands(c.admissions, c.beneficiaries, c.enrollments,
                                      lists[COHORT_LIST], lists, ALL_BANDS, FLAG_LISTS)


# --- operator-level queries --------------------------------------------------------

def _age_at_admission(spark, c):
    return (with_person(c.admissions, c.beneficiaries, ["dob"])
            .select("admission_id", age_at_admission().alias("age")))


def _age_in_year(spark, c):
    return (enrolled_people(c.enrollments, c.beneficiaries, ZIP_YEAR)
            .select("bene_id", "zip", age_in_year(ZIP_YEAR).alias("age")))


def _primary_code(spark, c):
    return c.admissions.select(
        "admission_id", primary_code().alias("primary_diag"))


def _secondary_codes(spark, c):
    return c.admissions.select(
        "admission_id", secondary_codes().alias("secondary_diag"))


def _positional_codes(spark, c):
    return c.admissions.select("admission_id", *positional_codes())


def _has_any_code(spark, c):
    codes = _lists(spark)[COHORT_LIST]
    return c.admissions.select(
        "admission_id", has_any("diagnosis", codes).alias("has_code"))


def _disease_flags(spark, c):
    return X.admission_flags(c.admissions, _lists(spark), FLAG_LISTS)


def _running_admission_number(spark, c):
    rows = X.numbered_admissions(c.admissions, c.beneficiaries, c.enrollments,
                                 _lists(spark)[COHORT_LIST])
    return rows.select("bene_id", "year", "admission_date", "zip", "n_th_admission")


def _first_per_person(spark, c):
    return C.first_admission_rows(c.admissions, c.beneficiaries, FULL_BAND, "secondary",
                                  _lists(spark)[RANGE_LIST]).drop("age_low", "age_high")


def _suppress_small_cells(spark, c):
    """Cells of code and age over all admissions, many of which are small."""
    rows = explode_codes(with_person(c.admissions, c.beneficiaries, ["dob"]), "all").select(
        "diag", age_at_admission().alias("age"))
    return suppress_small_cells(count_codes(rows, ["age"]), "diag_count", 10)


def _data_codes(spark, c):
    return codes_in_admissions(c.admissions)


def _expand_children(spark, c):
    parents = spark.createDataFrame([(p, p) for p in ICD9_ALL_PARENTS],
                                    "parent string, root string")
    return expand_children(_data_codes(spark, c), parents).select("root", "code")


def _expand_range(spark, c):
    return expand_range(_data_codes(spark, c), "E950", "E959").select("code")


def _code_lists(spark, c):
    return build_code_lists(spark, _data_codes(spark, c), STANDARD_RULES)


def _code_list_usage(spark, c):
    """The packaged lists with the number of code rows of each code in the claims."""
    from dxcohort.sources.codelists import icd9_codes
    used = (c.admissions.select(F.explode("diagnosis").alias("code")).groupBy("code")
            .agg(F.count(F.lit(1)).alias("n_rows")))
    lists = build_code_lists(spark, icd9_codes(spark), STANDARD_RULES)
    return lists.join(used, "code", "left").select(
        "list_name", "code", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# --- tables and lists written to files and read again

def _scanned(name: str) -> Builder:
    def run(spark: SparkSession, c: Claims) -> DataFrame:
        from dxcohort.session import scratch_path
        from dxcohort.sources.tables import read_claims, write_claims
        root = scratch_path(spark, "claims")
        write_claims(c, root)
        return getattr(read_claims(spark, root), name)
    return run


def _listed_from_files(spark, c):
    """Admissions with a code of a rare list, from the files that hold one."""
    from dxcohort.session import scratch_path
    from dxcohort.sources.tables import read_claims, write_claims
    root, codes = scratch_path(spark, "claims"), _lists(spark)["depression"]
    write_claims(c, root, code_summary=True)
    found = read_claims(spark, root, codes=codes).admissions
    return found.where(has_any("diagnosis", codes)).select("admission_id", "bene_id", "year")


def _list_file(spark, c, own: DataFrame | None = None) -> str:
    """The lists over the data's codes (and ``own`` ones) as one double-encoded JSON file."""
    from dxcohort.session import scratch_path
    from dxcohort.sources.codelists import LISTS_KEY
    path = scratch_path(spark, "lists-json")
    lists = _code_lists(spark, c)
    if own is not None:
        lists = lists.unionByName(own)
    lists = lists.groupBy("list_name").agg(
        F.sort_array(F.collect_list("code")).alias("codes"))      # bounded by the classification
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("list_name", "codes"))).alias("m"))
    text = F.to_json(F.array(F.to_json(F.struct(F.col("m").alias(LISTS_KEY)))))
    whole.select(text.alias("value")).write.text(path)
    return path


def _code_list_file(spark, c):
    from dxcohort.sources.codelists import read_code_lists
    return read_code_lists(spark, _list_file(spark, c))


def _one_named_list(spark, c):
    from dxcohort.sources.codelists import code_list, read_code_lists
    codes = code_list(read_code_lists(spark, _list_file(spark, c)), "depression")
    return spark.createDataFrame([(x,) for x in codes], "code string")


def _flags_from_file(spark, c):
    """A flag for every list of a file but the cohorts': the five, and one of our own."""
    from dxcohort.sources.codelists import code_list_dict, read_code_lists
    own = expand_range(_data_codes(spark, c), "E950", "E959").select(
        F.lit("self_harm").alias("list_name"), "code")
    lists = code_list_dict(read_code_lists(spark, _list_file(spark, c, own)))
    return X.admission_flags(c.admissions, lists)


def _parent_codes(spark, c):
    """The categories of the data's codes as comma-separated text, read again."""
    from dxcohort.session import scratch_path
    from dxcohort.sources.codelists import read_parent_codes
    path = scratch_path(spark, "parents-txt")
    parents = _data_codes(spark, c).select(F.substring("code", 1, 3).alias("p")).distinct()
    parents.agg(F.array_join(F.sort_array(F.collect_list("p")), ", ").alias("value")).write.text(path)
    return read_parent_codes(spark, path)


def _code_table_round_trip(spark, c):
    from dxcohort.session import scratch_path
    from dxcohort.sources.codelists import read_code_table, write_code_lists
    path = scratch_path(spark, "lists-table")
    write_code_lists(_code_lists(spark, c), path)
    return read_code_table(spark, path)


# --- sorted results with the place of each row

def _placed(ordered: DataFrame, name: str) -> DataFrame:
    """Add ``place``: a row's place (from 1) in the order of a sorted result.

    The sorted rows are written with their partition; a partition's rows come after
    all of the partitions before it.
    """
    from pyspark.sql import Window

    from dxcohort.session import scratch_path
    spark = ordered.sparkSession
    path = scratch_path(spark, name)
    ordered.withColumns({"_part": F.spark_partition_id(),
                         "_row": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))                # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_row"))
    return (rows.withColumn("_w", within).join(counts.withColumn("_b", before), "_part")
            .withColumn("place", F.col("_b") + F.col("_w")).drop("_part", "_row", "_n", "_b", "_w"))


def _code_counts_order(spark, c):
    return _placed(_counts("secondary", FULL_BAND)(spark, c), "counts-order")


def _zip_share_order(spark, c):
    return _placed(_zip_query(R.diag_share_of_admissions)(spark, c), "zip-order").select(
        "zip", "diag_vs_all_diag", "place")


def _extract_order(spark, c):
    """First place and rows of each person and day in the sorted extract."""
    rows = X.order_extract(_extract(FULL_BAND)(spark, c).select("bene_id", "admission_date", "zip"))
    return _placed(rows, "extract-order").groupBy("bene_id", "admission_date").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("n_rows"))


# --- keys that are no numbers, and keys that are missing

def _extract_text_ids(spark, c):
    tables = [t.withColumn("bene_id", F.concat(F.lit("P"), F.col("bene_id"))) for t in c]
    return _extract(FULL_BAND)(spark, Claims(*tables))


def _running_number_null_keys(spark, c):
    rows = c.admissions.select(
        "admission_id", F.when(F.col("admission_id") % 13 != 0, F.col("bene_id")).alias("person"),
        F.when(F.col("admission_id") % 11 != 0, F.col("admission_date")).alias("day"))
    return running_count(rows, "person", "day")


def _standard_code_table(spark, name: str):
    from dxcohort.sources.codelists import icd9_codes
    lists = build_code_lists(spark, icd9_codes(spark), STANDARD_RULES)
    return lists.where(F.col("list_name") == name).select("code")


def _code_counts_by_table(spark, c):
    return C.code_counts_in_band(c.admissions, c.beneficiaries, *FULL_BAND, "secondary",
                                 _standard_code_table(spark, RANGE_LIST))


def _listed_admissions_by_table(spark, c):
    from dxcohort.operators.codes import rows_with_listed_code
    return rows_with_listed_code(c.admissions, _standard_code_table(spark, COHORT_LIST)).select(
        "admission_id", "bene_id")


def _blank_sex(spark, c):
    b = c.beneficiaries
    return blank_values(b, "sex", AMBIGUOUS_SEX).select("bene_id", "sex")


def _blank_race(spark, c):
    b = c.beneficiaries
    return blank_matching(b, "race_ethnicity_code", AMBIGUOUS_RACE_PATTERN).select(
        "bene_id", "race_ethnicity_code")


def _blank_beneficiaries(spark, c):
    return blank_ambiguous_demographics(c.beneficiaries)


def _csv_round_trip(spark, c):
    from dxcohort.plans.export import write_extract, read_extract
    from dxcohort.session import scratch_path
    path = scratch_path(spark, "extract-csv")
    write_extract(_extract(FULL_BAND)(spark, c), path)
    return read_extract(spark, path)


def _counts_by_position(spark, c, list_name: str | None, band=FULL_BAND):
    codes = _lists(spark)[list_name] if list_name else None
    return C.code_counts_by_position(c.admissions, c.beneficiaries, band, codes).drop(
        "age_low", "age_high")


def _counts_by_position_bands(spark, c):
    """L12 in one pass: every position and every band."""
    return C.code_counts_by_position(c.admissions, c.beneficiaries, ALL_BANDS)


def _code_counts_290_319(spark, c):
    """L13 as one output: every position, band 0-18, the 290-319 list."""
    return _counts_by_position(spark, c, RANGE_LIST)


def _run_and_export(spark, c):
    """L18: all positions x all bands written as one partitioned CSV output,
    read back with an explicit schema."""
    from dxcohort.plans.export import export_code_counts, read_csv
    from dxcohort.session import scratch_path
    path = scratch_path(spark, "code-counts-csv")
    export_code_counts(c.admissions, c.beneficiaries, ALL_BANDS, path)
    schema = "diag string, diag_count long, position string, age_low int, age_high int"
    return read_csv(spark, path, schema)


def _export_individual_records(spark, c):
    """L18 for the extract: all bands, cleaned demographics, R-style NA,
    written as one partitioned CSV output and read back."""
    from dxcohort.plans.export import export_individual_records, read_individual_records
    from dxcohort.session import scratch_path
    lists = _lists(spark)
    path = scratch_path(spark, "records-csv")
    export_individual_records(c.admissions, c.beneficiaries, c.enrollments,
                              lists[COHORT_LIST], {n: lists[n] for n in FLAG_LISTS}, ALL_BANDS,
                              path, blank_ambiguous=True, null_value="NA")
    return read_individual_records(spark, path, null_value="NA")


def builders() -> dict[str, Builder]:
    """Every named query as ``(spark, claims) -> DataFrame``."""
    q: dict[str, Builder] = {
        "diag_count_by_zip": _zip_query(R.diag_count_by_zip),
        "admission_count_by_zip": _zip_query(R.admission_count_by_zip, with_codes=False),
        "diag_share_of_admissions": _zip_query(R.diag_share_of_admissions),
        "diag_share_of_enrolled": _zip_query(R.diag_share_of_enrolled),
        "top_codes_all": _top("all", None),
        "top_codes_primary": _top("primary", None, "primary_diag"),
        "top_codes_primary_in_list": _top("primary", RANGE_LIST),
    }
    for suffix, band in BANDS.items():
        q[f"first_admission_secondary_in_list{suffix}"] = _first_counts("secondary", band, RANGE_LIST)
        q[f"first_admission_secondary_all{suffix}"] = _first_counts("secondary", band, None)
        q[f"first_admission_secondary_total{suffix}"] = _first_total("secondary", band)
        q[f"first_admission_primary_in_list{suffix}"] = _first_counts("primary", band, RANGE_LIST)
        q[f"first_admission_primary_all{suffix}"] = _first_counts("primary", band, None)
        q[f"first_admission_primary_total{suffix}"] = _first_total("primary", band)
        for position in ("all", "primary", "secondary"):
            q[f"code_counts_{position}{suffix}"] = _counts(position, band)
            q[f"code_counts_290_319_{position}{suffix}"] = _counts(position, band, RANGE_LIST)
        q[f"individual_extract{suffix}"] = _extract(band)
    q.update({
        "code_counts_all_bands": _counts_all_bands("all"),
        "code_counts_by_position_bands": _counts_by_position_bands,
        "code_counts_secondary_290_319_bands": _counts_all_bands("secondary", RANGE_LIST),
        "first_admission_secondary_in_list_bands": _first_counts_all_bands("secondary", RANGE_LIST),
        "individual_extract_bands": _extract_all_bands,
        "disease_flags": _disease_flags,
        "blank_ambiguous_demographics": _extract(FULL_BAND, blank=True),
        "blank_beneficiaries": _blank_beneficiaries,
        "code_lists": _code_lists,
        "build_code_lists": _code_list_usage,
        "code_counts_290_319": _code_counts_290_319,
        "run_and_export": _run_and_export,
        "export_individual_records": _export_individual_records,
        "age_at_admission": _age_at_admission,
        "age_in_year": _age_in_year,
        "primary_code": _primary_code,
        "secondary_codes": _secondary_codes,
        "positional_codes": _positional_codes,
        "has_any_code": _has_any_code,
        "running_admission_number": _running_admission_number,
        "first_per_person": _first_per_person,
        "suppress_small_cells": _suppress_small_cells,
        "expand_children": _expand_children,
        "expand_range": _expand_range,
        "code_counts_290_319_secondary_by_table": _code_counts_by_table,
        "listed_admissions_by_table": _listed_admissions_by_table,
        "blank_sex": _blank_sex,
        "blank_race": _blank_race,
        "csv_round_trip": _csv_round_trip,
        "scan_admissions": _scanned("admissions"),
        "scan_beneficiaries": _scanned("beneficiaries"),
        "scan_enrollments": _scanned("enrollments"),
        "listed_admissions_from_files": _listed_from_files,
        "code_list_file": _code_list_file,
        "one_named_list": _one_named_list,
        "parent_codes": _parent_codes,
        "code_table_round_trip": _code_table_round_trip,
        "disease_flags_from_file": _flags_from_file,
        "code_counts_order": _code_counts_order,
        "zip_share_order": _zip_share_order,
        "extract_order": _extract_order,
        "individual_extract_text_ids": _extract_text_ids,
        "running_number_null_keys": _running_number_null_keys,
    })
    return q


def queries() -> dict[str, Query]:
    """Every named query as ``(spark, sf_dir) -> DataFrame`` over the claims
    tables derived from the test tables in ``sf_dir``."""
    def bind(build: Builder) -> Query:
        return lambda spark, sf_dir: build(spark, claims(spark, sf_dir))
    return {name: bind(b) for name, b in builders().items()}
