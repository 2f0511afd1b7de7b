import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from dxcohort.plans import export
from dxcohort.plans import extract as X
from dxcohort.session import scratch_path


def test_extract_csv_round_trip_keeps_nulls_and_zips(spark, claims, lists):
    df = X.individual_extract(*claims, 0, 18, lists["icd9_all"], lists)
    path = scratch_path(spark, "t-extract")
    export.write_extract(df, path)
    back = export.read_extract(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert rows(back) == rows(df)
    # leading zeros kept; a NULL element inside diagnosis survives
    assert "02138" in {r.zip for r in back.collect()}
    assert [None, "311"] in [r.diagnosis for r in back.collect()]


def test_r_style_na_output(spark, claims, lists):
    df = X.individual_extract(*claims, 0, 18, lists["icd9_all"], lists, blank_ambiguous=True)
    path = scratch_path(spark, "t-na")
    export.write_extract(df, path, null_value="NA")
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert ",NA," in text
    back = export.read_extract(spark, path, null_value="NA")
    assert rows(back) == rows(df)


def test_export_code_counts_partitioned_by_position_and_band(spark, claims):
    a, b, _ = claims
    path = scratch_path(spark, "t-counts")
    export.export_code_counts(a, b, [(0, 18), (0, 12), (13, 18)], path)
    df = spark.read.option("header", True).csv(path)
    assert set(df.columns) == {"diag", "diag_count", "position", "age_low", "age_high"}
    assert {r.position for r in df.select("position").distinct().collect()} == {
        "all", "primary", "secondary"}
    n = df.where("position = 'all' AND age_low = 0 AND age_high = 18").count()
    assert n == len({c for x in [r for r in claims.admissions.collect()] for c in (x.diagnosis or [])
                     if c is not None and x.bene_id != 7})


def test_sorted_extract_file_order(spark, claims, lists):
    df = X.individual_extract(*claims, 0, 18, lists["icd9_all"], lists)
    path = scratch_path(spark, "t-sorted")
    export.write_extract(df, path, sort=True)
    back = export.read_extract(spark, path).collect()
    keys = [(r.bene_id, r.admission_date or dt.date.max) for r in back]
    assert keys == sorted(keys)


def test_run_and_export_all_bands_one_output(spark, claims):
    from functools import partial
    from dxcohort.plans import counts as C
    a, b, _ = claims
    path = scratch_path(spark, "t-bands")
    export.run_and_export(partial(C.code_counts, a, b, position="all"), [(0, 18), (0, 12), (13, 18)], path)
    df = spark.read.option("header", True).csv(path)
    got = {(int(r.age_low), int(r.age_high))
           for r in df.select("age_low", "age_high").distinct().collect()}
    assert got == {(0, 18), (0, 12), (13, 18)}


def test_bucketed_layout_round_trip(spark, small_claims):
    from dxcohort.sources.tables import read_claims_tables, write_claims
    root = scratch_path(spark, "t-bucketed")
    write_claims(small_claims, root, buckets=4, table_prefix="t_bucketed_")
    back = read_claims_tables(spark, "t_bucketed_")
    for before, after in zip(small_claims, back):
        assert after.count() == before.count()
    # co-bucketed tables join on bene_id without a shuffle of either side
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = back.admissions.join(back.beneficiaries, "bene_id")._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan


def test_export_individual_records_all_bands(spark, claims, lists):
    path = scratch_path(spark, "t-records")
    bands = [(0, 18), (0, 12), (13, 18)]
    export.export_individual_records(*claims, lists["icd9_all"], lists, bands, path,
                                     blank_ambiguous=True, null_value="NA")
    back = export.read_individual_records(spark, path, null_value="NA")
    want = X.individual_extract_bands(*claims, lists["icd9_all"], lists, bands,
                                      blank_ambiguous=True)
    cols = want.columns
    assert rows(back, *cols) == rows(want, *cols)
    # each band's files are ordered by person and date
    for lo, hi in bands:
        part = spark.read.option("header", True).csv(f"{path}/age_low={lo}/age_high={hi}")
        keys = [(int(r.bene_id), r.admission_date) for r in part.collect()]
        assert keys == sorted(keys)


def test_order_extract_splits_ties(spark, claims, lists):
    df = X.individual_extract(*claims, 0, 18, lists["icd9_all"], lists)
    ordered = X.order_extract(df)
    keys = [(r.bene_id, r.admission_date) for r in ordered.collect()]
    assert keys == sorted(keys)
    assert "xxhash64" in ordered._jdf.queryExecution().executedPlan().toString()


def test_jdbc_ranges_cover_the_key_space():
    from dxcohort.sources.tables import jdbc_ranges
    for lo, hi, parts in [(1, 100, 7), (0, 0, 4), (5, 9, 10), (-50, 50, 3)]:
        ranges = jdbc_ranges(lo, hi, parts)
        assert ranges[0][0] == lo and ranges[-1][1] == hi + 1
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        assert len(ranges) <= max(1, parts)


def test_jdbc_predicates_hold_every_row_once():
    import sqlite3
    from dxcohort.sources.tables import jdbc_predicates
    ids = [None, -5, 0, 1, 5, 6, 10, 11, 10**9]
    years = [None, 1990, 1999, 2000, 2050]
    con = sqlite3.connect(":memory:")                      # in this process only
    con.execute("CREATE TABLE t (bene_id, year)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, y) for i in ids for y in years])
    for predicates in (jdbc_predicates((1, 10), 2, [1999, 2000]), jdbc_predicates((1, 10), 4),
                       jdbc_predicates((1, 10), 1), jdbc_predicates((5, 5), 3, [2000])):
        got = [r for p in predicates for r in con.execute(f"SELECT rowid FROM t WHERE {p}")]
        assert len(got) == len(set(got)) == len(ids) * len(years)


def test_jdbc_predicates_of_text_keys():
    import sqlite3
    from dxcohort.sources.tables import jdbc_predicates
    ids = [None, "", "A", "P1", "P2", "P25", "O'Neil", "p1", "z"]
    con = sqlite3.connect(":memory:")                      # in this process only
    con.execute("CREATE TABLE t (bene_id TEXT COLLATE NOCASE, year)")     # not the order of the bounds
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, y) for i in ids for y in (None, 1999, 2000)])
    for bounds in (["P2", "O'N"], ["P1"], ["a", "P1", "P1", "~"]):
        predicates = jdbc_predicates(bounds, 99, [1999])
        assert len(predicates) == 2 * (len(set(bounds)) + 1)
        got = [r for p in predicates for r in con.execute(f"SELECT rowid FROM t WHERE {p}")]
        assert len(got) == len(set(got)) == 3 * len(ids)


def test_code_summary_skips_files(spark, small_claims, tmp_path):
    from dxcohort.functions.expr import has_any
    from dxcohort.sources.tables import read_claims, write_claims
    a, b, e = small_claims
    rare = a.limit(3).select("admission_id", "bene_id", "year", "admission_date",
                             F.array(F.lit("V999"), F.lit(None)).alias("diagnosis"))
    odd = spark.createDataFrame([(-1, 1, 1998, None, None), (-2, 1, 1998, None, []), (-3, 1, 1998, None, [None])],
                                a.schema)
    root = str(tmp_path / "claims")
    write_claims(type(small_claims)(a.unionByName(rare).unionByName(odd), b, e), root, code_summary=True)
    every = read_claims(spark, root).admissions

    def read(codes):
        return read_claims(spark, root, codes=codes).admissions

    for codes in (["V999"], ["V999", "nothing"], ["2962", "29620"], ["nothing"], []):
        want = every.where(has_any("diagnosis", codes))
        assert rows(read(codes).where(has_any("diagnosis", codes))) == rows(want)
    assert 0 < len(read(["V999"]).inputFiles()) < len(every.inputFiles())
    assert read(["nothing"]).count() == 0 and read(["V999"]).columns == every.columns
    # the year still prunes folders, and files that the summary does not know are read
    year = rare.first()["year"]
    assert read(["V999"]).where(F.col("year") == year).count() > 0
    odd.withColumn("diagnosis", F.array(F.lit("V888"))).write.mode("append").partitionBy("year").parquet(
        f"{root}/admissions")
    assert read(["V888"]).where(has_any("diagnosis", ["V888"])).count() == 3
    # without a summary, everything is read
    write_claims(small_claims, str(tmp_path / "plain"))
    plain = read_claims(spark, str(tmp_path / "plain"), codes=["V999"]).admissions
    assert plain.count() == a.count()


def test_partitioned_write_makes_few_files(spark, small_claims, tmp_path):
    from dxcohort.sources.tables import write_claims
    write_claims(small_claims, str(tmp_path))
    for year in (tmp_path / "admissions").glob("year=*"):
        assert len(list(year.glob("part-*"))) <= 4


def test_no_scratch_folder_on_a_cluster(spark):
    from types import SimpleNamespace
    from dxcohort.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d, set=None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
