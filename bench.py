"""Benchmark the headline queries.

Reads the test tables at ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``),
derives the claims tables once and writes them as Parquet (admissions and
enrollments partitioned by year) under the shared checkpoint folder - the
layout a cluster job reads - then runs every headline query to completion
(``noop`` sink: full execution, nothing collected) on ``local[$BENCH_CPUS]``.

Prints one JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``;
``value`` is the sum of the per-query times (best of ``$BENCH_REPEAT`` runs); ``first``
holds each query's first run. Automatic broadcast joins are off, as they would be
for tables of cluster size, so the joins that are timed shuffle.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "diag_count_by_zip",
    "admission_count_by_zip",
    "diag_share_of_admissions",
    "diag_share_of_enrolled",
    "top_codes_all",
    "top_codes_primary",
    "top_codes_primary_in_list",
    "code_counts_all",
    "code_counts_primary",
    "code_counts_secondary",
    "code_counts_290_319_secondary",
    "code_counts_all_bands",
    "code_counts_by_position_bands",
    "first_admission_secondary_in_list",
    "first_admission_secondary_all",
    "first_admission_secondary_total",
    "first_admission_primary_in_list",
    "first_admission_secondary_in_list_bands",
    "individual_extract",
    "individual_extract_bands",
    "disease_flags",
    "code_lists",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE

    from pyspark.sql import SparkSession

    from dxcohort.plans import catalog
    from dxcohort.session import local_session, scratch_path
    from dxcohort.sources.codelists import standard_lists
    from dxcohort.sources.tables import read_claims, write_claims

    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", 2 * n))
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra |= {"spark.eventLog.enabled": "true",
                  "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark: SparkSession = local_session(cores=cpus, shuffle_partitions=partitions,
                                        app_name="dxcohort-bench", memory="16g",
                                        extra_conf=extra)

    t0 = time.perf_counter()
    root = scratch_path(spark, "claims")
    write_claims(catalog.claims(spark, sf_dir), root)
    claims = read_claims(spark, root)
    standard_lists(spark)
    prepare = time.perf_counter() - t0

    build = catalog.builders()
    # Warm the JVM (code generation, class loading) outside the timings.
    build["code_counts_all"](spark, claims).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    first: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        best = float("inf")
        try:
            for _ in range(repeat):
                t = time.perf_counter()
                build[name](spark, claims).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - t
                first.setdefault(name, round(took, 3))
                best = min(best, took)
            times[name] = round(best, 3)
        except Exception as exc:  # keep timing the others; report the failure
            errors[name] = f"{type(exc).__name__}: {exc}"[:300]

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "first": first,
        "sf": float(m.group(1)) if m else sf_dir,
        "prepare_sec": round(prepare, 3),
        "cpus": cpus,
        "spark": spark.version,
        "repeat": repeat,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
