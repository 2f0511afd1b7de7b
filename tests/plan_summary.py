"""Summarise the physical plans of the headline queries as a cluster would
run them: claims tables written as Parquet (partitioned by year), automatic
broadcast of claims tables disabled. Prints a Markdown table.

Usage: ``python tests/plan_summary.py [sf_dir]``.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(text: str) -> dict[str, object]:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning", text)),
        "range": len(re.findall(r"Exchange rangepartitioning", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "scans": len(re.findall(r"FileScan parquet", text)),
        "partition filter": "yes" if re.search(r"PartitionFilters: \[[^\]]*= ", text) else "",
        "python": "yes" if re.search(r"(BatchEval|ArrowEval)Python|InPandas", text) else "no",
        "top-k": "yes" if "TakeOrderedAndProject" in text else "",
            }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import bench
    from dxcohort.plans import catalog
    from dxcohort.session import local_session, scratch_path
    from dxcohort.sources.tables import read_claims, write_claims
    spark = local_session()
    root = scratch_path(spark, "plan-claims")
    write_claims(catalog.claims(spark, sf_dir), root)
    claims = read_claims(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    build = catalog.builders()
    print("| query | shuffles | range | broadcasts | scans | year pruned | top-k |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in bench.HEADLINE:
        s = summarise(build[name](spark, claims)._jdf.queryExecution().executedPlan().toString())
        assert s["python"] == "no"
        print(f"| {name} | {s['shuffles']} | {s['range']} | {s['broadcasts']} | {s['scans']} "
              f"| {s['partition filter']} | {s['top-k']} |")


if __name__ == "__main__":
    main()
