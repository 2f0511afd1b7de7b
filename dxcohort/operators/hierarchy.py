"""Code-list construction from a code dimension: expand parents to all their
descendants, expand category ranges, add single codes, and assemble named
lists ``code_lists(list_name, code)``.

ICD-9 codes are hierarchical by prefix (``296`` > ``2962`` > ``29620``), so
"a parent and all its descendants" is an equi-join of each code's prefixes
with the parent codes. The code dimension (all valid codes) is an input; the
packaged one covers the categories the named lists need.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxcohort.schema import CODE_LISTS


@dataclass(frozen=True)
class Rule:
    """One line of a list definition.

    kind ``children``: ``a`` and every code below it; ``range``: every code
    whose category lies between ``a`` and ``b`` inclusive (same kind of code
    on both ends); ``exact``: the single code ``a``, whether or not it is in
    the dimension.
    """
    list_name: str
    kind: str
    a: str
    b: str | None = None


# The definitions of the named lists. Parents of ``icd9_all``:
# 296, 299, 300, 308, 309, 311, 312, 313, 314, 315, 317, 318, plus the range
# E950-E959. depression: 2962, 2963. anxiety: 3000, and the codes 30029, 3004.
# emotion_disturb: 313. adole_reaction: 309. disturb_conduct: 312. The older
# list keyed ``icd9`` is the category range 290-319.
ICD9_ALL_PARENTS = ("296", "299", "300", "308", "309", "311", "312", "313", "314",
                    "315", "317", "318")
ICD9_ALL_RANGE = ("E950", "E959")

STANDARD_RULES: tuple[Rule, ...] = (
    *(Rule("icd9_all", "children", p) for p in ICD9_ALL_PARENTS),
    Rule("icd9_all", "range", *ICD9_ALL_RANGE),
    Rule("depression", "children", "2962"),
    Rule("depression", "children", "2963"),
    Rule("anxiety", "children", "3000"),
    Rule("anxiety", "exact", "30029"),
    Rule("anxiety", "exact", "3004"),
    Rule("emotion_disturb", "children", "313"),
    Rule("adole_reaction", "children", "309"),
    Rule("disturb_conduct", "children", "312"),
    Rule("icd9", "range", "290", "319"),
)


def category(code: Column) -> Column:
    """ICD-9 category: first 4 characters of an ``E`` code, else first 3."""
    return F.when(code.startswith("E"), F.substring(code, 1, 4)).otherwise(
        F.substring(code, 1, 3))


def code_kind(code: Column) -> Column:
    """``E`` or ``V`` for supplementary codes, ``N`` for numeric ones."""
    first = F.substring(code, 1, 1)
    return F.when(first.isin("E", "V"), first).otherwise(F.lit("N"))


def _kind_of(text: str) -> str:
    return text[0] if text[:1] in ("E", "V") else "N"


def code_prefixes(codes: DataFrame) -> DataFrame:
    """``(code, prefix)`` for every leading substring of each code, itself included."""
    c = F.col("code")
    return codes.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(c)),
                                                 lambda n: F.substring(c, 1, n)))
                        .alias("prefix"))


def expand_children(codes: DataFrame, parents: DataFrame) -> DataFrame:
    """Every code of the dimension that is a parent or lies below one.

    ``parents`` has a ``parent`` column and may carry more columns (such as
    ``list_name``), which are kept. The join is an equi-join on the prefix;
    Spark broadcasts the parents when they are small, which it measures.
    """
    return (code_prefixes(codes)
            .join(parents, F.col("prefix") == F.col("parent"), "inner")
            .drop("prefix", "parent"))


def expand_range(codes: DataFrame, low: str, high: str) -> DataFrame:
    """Every code whose category lies in ``[low, high]`` (``E950``-``E959``,
    ``290``-``319``); both ends must be the same kind of code."""
    if _kind_of(low) != _kind_of(high):
        raise ValueError(f"range ends differ in kind: {low!r}, {high!r}")
    c = F.col("code")
    return codes.where((code_kind(c) == _kind_of(low))
                       & category(c).between(F.lit(low), F.lit(high)))


def range_categories(low: str, high: str) -> list[str]:
    """The categories from ``low`` to ``high`` inclusive, by rule: an optional
    letter (``E``, ``V``) then a zero-padded number of fixed width
    (``290``-``319``: 30 categories; ``E950``-``E959``: 10)."""
    if _kind_of(low) != _kind_of(high):
        raise ValueError(f"range ends differ in kind: {low!r}, {high!r}")
    lead = low[0] if low[:1].isalpha() else ""
    width = len(low) - len(lead)
    first, last = int(low[len(lead):]), int(high[len(lead):])
    return [f"{lead}{n:0{width}d}" for n in range(first, last + 1)]


def build_code_lists(spark: SparkSession, codes: DataFrame,
                     rules: Iterable[Rule] = STANDARD_RULES) -> DataFrame:
    """Assemble named lists ``(list_name, code)`` from rules, without repeats.

    A category range is every code below one of its categories, so children
    and range rules together become one table of (list, parent) pairs and
    one broadcast equi-join of the codes' prefixes: the code dimension is read
    once, however many rules there are (it may be derived from the claims).
    Exact codes are added as given.
    """
    rules = list(rules)
    unknown = {r.kind for r in rules} - {"children", "range", "exact"}
    if unknown:
        raise ValueError(f"unknown rule kinds: {sorted(unknown)}")
    pairs = [(r.list_name, r.a) for r in rules if r.kind == "children"]
    pairs += [(r.list_name, cat) for r in rules if r.kind == "range"
              for cat in range_categories(r.a, r.b)]
    exact = [(r.list_name, r.a) for r in rules if r.kind == "exact"]
    out = spark.createDataFrame(exact, CODE_LISTS)
    if pairs:
        parents = spark.createDataFrame(pairs, "list_name string, parent string")
        out = expand_children(codes.select("code"), parents).select("list_name", "code") \
            .unionByName(out)
    return out.dropDuplicates(["list_name", "code"])


def codes_in_admissions(admissions: DataFrame, diagnosis: str = "diagnosis") -> DataFrame:
    """The code dimension seen in the data: distinct non-NULL codes."""
    return (admissions.select(F.explode(diagnosis).alias("code"))
            .where(F.col("code").isNotNull()).distinct())


def rules_from_parents(list_name: str, parents: Sequence[str],
                       ranges: Sequence[tuple[str, str]] = ()) -> list[Rule]:
    """Rules for one list: parents with descendants plus category ranges."""
    return ([Rule(list_name, "children", p) for p in parents]
            + [Rule(list_name, "range", lo, hi) for lo, hi in ranges])
