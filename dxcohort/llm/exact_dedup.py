"""Exact deduplication by a keyed streaming state on disk (operator 8).

Texts are equal when they are byte for byte the same after every run of ASCII
white space is replaced by one space. Everything runs in DataFrame operations:

1. every row is reduced once to its digest, its stable identifier (``doc_id``)
   and a content locator (input file and row), written as a small table;
2. a Structured Streaming job (``availableNow``) reads that table and keeps, in
   RocksDB state without expiry, per digest the smallest identifier, its locator
   and the number of rows. The streaming aggregation combines on the map side,
   so a digest with a third of all rows sends one row a task;
3. the state is read back with the state data source and joined to the rows;
4. the full bytes are compared: the distinct normalised texts of every digest
   are gathered (one, unless the digest collides; combined on the map side). A
   digest with several texts is split by text.

Defined results: null text is empty text; rows with a null ``doc_id`` are kept
apart from numbered ones (any numbered row stays before them) and compare by
text like all others; a repeated ``doc_id`` is two rows, of which one stays,
chosen by locator; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, scratch, text_of, written

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no files of a fixed least size for each of many small stores
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.numRecentProgressUpdates": "2",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def state_of(spark: SparkSession, digests: str, schema, checkpoint: str,
             files_per_batch: int = 1000) -> DataFrame:
    """Run the stateful stream over the digest table; return its keyed state.

    Started again with the same ``checkpoint`` after more files have been added
    to ``digests``, it reads only those and updates the state.
    """
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = (spark.readStream.schema(schema)
                .option("maxFilesPerTrigger", files_per_batch).parquet(digests))
        state = rows.groupBy("_digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row"))
            .alias("keep"), F.count("*").alias("group_size"))
        (state.writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        read = spark.read.format("statestore").load(checkpoint)
        value = read.schema["value"].dataType.fieldNames()
        return written(read.select(
            F.col("key")["_digest"].alias("_digest"),
            F.col("value")[value[0]].alias("_keep"),
            F.col("value")[value[1]].alias("_size")), "state")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    ``digest`` may be any function of the normalised text: equal texts must have
    equal digests, and different texts with the same digest are told apart by
    their bytes.
    """
    spark = docs.sparkSession
    path = scratch(spark, "digests")
    (docs.select("doc_id", digest(normalised(text_of())).alias("_digest"),
                 F.input_file_name().alias("_file"),
                 F.monotonically_increasing_id().alias("_row"))
     .write.option("compression", "zstd").parquet(path))
    rows = spark.read.parquet(path)
    state = state_of(spark, path, rows.schema, scratch(spark, "dedup-state"))

    texts = docs.select("doc_id", normalised(text_of()).alias("_norm"))
    clash = written(texts.withColumn("_digest", digest(F.col("_norm")))
                    .groupBy("_digest").agg(F.collect_set("_norm").alias("_texts"))
                    .where(F.size("_texts") > 1).select("_digest"), "clash")
    out = _classes(rows.join(state, "_digest"))
    if clash.isEmpty():
        return out
    # A digest of several texts: its rows are told apart by the texts themselves.
    apart = (docs.select("doc_id", normalised(text_of()).alias("_norm"),
                         F.input_file_name().alias("_file"),
                         F.monotonically_increasing_id().alias("_row"))
             .withColumn("_digest", digest(F.col("_norm"))).join(clash, "_digest", "left_semi"))
    apart = written(apart, "apart")
    split = apart.groupBy("_digest", "_norm").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row"))
        .alias("_keep"), F.count("*").alias("_size"))
    return (_classes(rows.join(clash, "_digest", "left_anti").join(state, "_digest"))
            .unionByName(_classes(apart.join(split, ["_digest", "_norm"]))))


def _classes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        ((F.col("_file") == F.col("_keep._file")) & (F.col("_row") == F.col("_keep._row")))
        .alias("kept"), F.col("_digest").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = (exact_dedup(docs).where("kept")
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")))
    keyed = docs.withColumn("__digest", sha256(normalised(text_of())))
    joined = keyed.alias("d").join(
        kept.alias("k"), (F.col("d.__digest") == F.col("k._digest"))
        & F.col("d.doc_id").eqNullSafe(F.col("k._id")), "left_semi")
    # rows that repeat an identifier and a text
    return joined.dropDuplicates(["__digest", "doc_id"]).select(*docs.columns)
