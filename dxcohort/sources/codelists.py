"""Code lists and the code dimension: read, write, and turn into literals.

File formats read:

* the list file as written by the R tooling: a JSON array holding one string
  that is itself JSON, ``["{\\"icd_cust_range\\": {name: [codes]}}"]``;
* the same object written once (``{"icd_cust_range": {name: [codes]}}``);
* JSON lines ``{"list_name": ..., "code": ...}`` as written by
  :func:`write_code_lists`.

A code list is configuration bounded by the size of the classification
(ICD-9-CM has about 15 thousand codes, ICD-10-CM about 72 thousand), not data
that grows with the claims. :func:`code_list` brings one list to the driver
behind that bound so that membership runs as an in-stage hash-set lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxcohort.schema import CODE_LISTS, CODES
from dxcohort.session import app_id

LISTS_KEY = "icd_cust_range"
# More codes than any diagnosis classification holds: a list above this is
# not a code list, and the call fails instead of shipping it to every task.
MAX_LIST_CODES = 200_000
MAX_LISTS = 64

_NESTED = f"struct<{LISTS_KEY}:map<string,array<string>>>"


def read_code_lists(spark: SparkSession, path: str) -> DataFrame:
    """Read list files (double-encoded or plain nested JSON) into
    ``(list_name, code)``; several files may match ``path``. A file of another
    form fails the read."""
    raw = spark.read.text(path, wholetext=True)
    text = F.trim(F.col("value"))
    # A leading '[' marks the double encoding: unwrap the one string first.
    inner = F.when(text.startswith("["), F.from_json(text, "array<string>")[0]).otherwise(text)
    lists = F.from_json(inner, _NESTED)[LISTS_KEY]
    parsed = raw.select(F.when(lists.isNotNull(), lists).otherwise(F.raise_error(F.concat(
        F.lit("not a code-list file: "), F.substring(text, 1, 80)))).alias("lists"))
    return (parsed.select(F.explode("lists").alias("list_name", "codes"))
            .select("list_name", F.explode("codes").alias("code"))
            .where(F.col("code").isNotNull()))


def write_code_lists(code_lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``(list_name, code)`` as JSON lines, one plain encoding."""
    code_lists.select("list_name", "code").write.mode(mode).json(path)


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON lines written by :func:`write_code_lists`."""
    return spark.read.schema(CODE_LISTS).json(path)


def read_parent_codes(spark: SparkSession, path: str) -> DataFrame:
    """Read a comma-separated text list of parent codes into ``parent``."""
    return (spark.read.text(path)
            .select(F.explode(F.split(F.col("value"), ",")).alias("parent"))
            .select(F.trim("parent").alias("parent"))
            .where(F.col("parent") != ""))


def packaged_codes() -> list[str]:
    """The packaged code dimension as a list (read on the driver; small)."""
    text = resources.files("dxcohort").joinpath("data", "icd9cm_codes.txt").read_text()
    return [line.strip() for line in text.splitlines()
            if line.strip() and not line.startswith("#")]


def icd9_codes(spark: SparkSession) -> DataFrame:
    """The packaged ICD-9-CM code dimension (categories 290-319, E950-E959).

    A small packaged file, read on the driver and shipped inside the plan, so
    it needs no shared storage.
    """
    return spark.createDataFrame([(c,) for c in packaged_codes()], CODES)


def code_list(code_lists: DataFrame, name: str,
              max_codes: int = MAX_LIST_CODES) -> list[str]:
    """The codes of one named list as a sorted Python list (size-checked).

    A name without codes in the table is an error, as a lookup of it would be.
    """
    rows = (code_lists.where(F.col("list_name") == name).select("code").distinct()
            .limit(max_codes + 1).collect())
    if len(rows) > max_codes:
        raise ValueError(f"list {name!r} holds more than {max_codes} codes")
    if not rows:
        raise KeyError(f"no code list named {name!r}")
    return sorted(r.code for r in rows)


def code_list_dict(code_lists: DataFrame, names: Sequence[str] | None = None,
                   max_codes: int = MAX_LIST_CODES) -> dict[str, list[str]]:
    """Several named lists at once (one small job), size-checked per list.

    At most ``max_codes`` codes per list and ``MAX_LISTS`` lists are read; one of
    ``names`` that the table lacks is an error.
    """
    df = code_lists.select("list_name", "code").distinct()
    if names is not None:
        df = df.where(F.col("list_name").isin(list(names)))
    total_max = max_codes * (len(names) if names is not None else MAX_LISTS)
    rows = df.limit(total_max + 1).collect()
    if len(rows) > total_max:
        raise ValueError("code lists exceed the size bound")
    out: dict[str, list[str]] = {n: [] for n in (names or [])}
    for r in rows:
        out.setdefault(r.list_name, []).append(r.code)
    for n, codes in out.items():
        if len(codes) > max_codes:
            raise ValueError(f"list {n!r} holds more than {max_codes} codes")
        if not codes:
            raise KeyError(f"no code list named {n!r}")
        codes.sort()
    return out


_STANDARD_CACHE: dict[str, dict[str, tuple[str, ...]]] = {}


def standard_lists(spark: SparkSession) -> dict[str, list[str]]:
    """The six current lists and the older ``icd9`` (290-319) list, built by
    rule from the packaged dimension (computed once per application)."""
    from dxcohort.operators.hierarchy import STANDARD_RULES, build_code_lists
    key = app_id(spark)
    if key not in _STANDARD_CACHE:
        lists = build_code_lists(spark, icd9_codes(spark), STANDARD_RULES)
        _STANDARD_CACHE[key] = {k: tuple(v) for k, v in code_list_dict(lists).items()}
    return {k: list(v) for k, v in _STANDARD_CACHE[key].items()}
