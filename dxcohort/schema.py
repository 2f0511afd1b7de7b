"""Explicit schemas of the claims tables and of the outputs (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

ADMISSIONS = T.StructType([
    # ``admission_id`` is optional; it is used only to break ties in "first
    # admission" selection when two admissions share a person and a date.
    T.StructField("admission_id", T.LongType(), True),
    T.StructField("bene_id", T.LongType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("admission_date", T.DateType(), False),
    # Ranked codes: element 1 is the primary diagnosis. Elements may be NULL.
    T.StructField("diagnosis", T.ArrayType(T.StringType(), True), True),
])

BENEFICIARIES = T.StructType([
    T.StructField("bene_id", T.LongType(), False),
    T.StructField("dob", T.DateType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("race_ethnicity_code", T.StringType(), True),
])

ENROLLMENTS = T.StructType([
    T.StructField("bene_id", T.LongType(), False),
    T.StructField("year", T.IntegerType(), False),
    # Text, never numeric: zip codes keep their leading zeros.
    T.StructField("zip", T.StringType(), True),
])

CODE_LISTS = T.StructType([
    T.StructField("list_name", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
])

CODES = T.StructType([T.StructField("code", T.StringType(), False)])

# The five disease flags of the individual extract, in output order.
FLAG_LISTS = ("depression", "anxiety", "emotion_disturb", "adole_reaction",
              "disturb_conduct")

N_POSITIONAL = 9

# The 23 columns of the individual extract, in output order.
EXTRACT = T.StructType(
    [T.StructField(f"diag{i + 1}", T.StringType(), True) for i in range(N_POSITIONAL)]
    + [
        T.StructField("diagnosis", T.ArrayType(T.StringType(), True), True),
        T.StructField("year", T.IntegerType(), True),
        T.StructField("admission_date", T.DateType(), True),
        T.StructField("bene_id", T.LongType(), True),
        T.StructField("n_th_admission", T.LongType(), True),
    ]
    + [T.StructField(name, T.IntegerType(), True) for name in FLAG_LISTS]
    + [
        T.StructField("zip", T.StringType(), True),
        T.StructField("race_ethnicity_code", T.StringType(), True),
        T.StructField("sex", T.StringType(), True),
        T.StructField("age", T.IntegerType(), True),
    ]
)

# CSV cannot hold arrays: on disk ``diagnosis`` is its JSON text.
EXTRACT_CSV = T.StructType([
    T.StructField(f.name, T.StringType(), True) if f.name == "diagnosis" else f
    for f in EXTRACT.fields
])


def with_person_type(schema: T.StructType, person_type: T.DataType | None = None) -> T.StructType:
    """``schema`` with another type of the person key ``bene_id``, which is opaque:
    it is only compared and sorted, and text keys serve as well as numbers."""
    if person_type is None:
        return schema
    return T.StructType([T.StructField(f.name, person_type, f.nullable) if f.name == "bene_id" else f
                         for f in schema.fields])
