"""License scan by diagonal voting (operator 3), in DataFrame functions.

Every text is cut into lower-case words; all its rolling 3-word grams are joined
by hash to the grams of the license templates (a fixed list, broadcast). The
join also compares the gram itself, so that a hash collision never votes. Each
match votes for the diagonal ``document position - template position``. A
diagonal on which every gram of a template matches is a verified place of the
whole phrase. Diagonals at most ``SLACK`` words apart (inserted or lost words)
merge into one span, scored by the share of the template's grams that it holds.

Rows are reduced to the few matching grams (and one row for each document)
before the only shuffle, by document; a phrase that a third of all documents
hold is therefore no hot key.

Defined results: null and empty texts have no words and score 0; repeated rows are
scanned as one and given as often as they occur; ties of spans do not matter, as
only sums, extremes and label sets are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

K = 3
SLACK = 2
MIN_COVERAGE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places count (base), and the longer texts of the method.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are "
              "permitted provided that the following conditions are met"),
]


#: At each space: the K words after it (a match is empty, so that grams overlap).
ROLLING = "(?= (" + " ".join(["[^ ]+"] * K) + "))"


def spaced_words(text: Column) -> Column:
    """The words, each after one space: runs outside ASCII punctuation, white
    space and controls; A-Z lower-cased. ``lower`` also changes other letters, but
    never where words begin or end, and no template has such a letter."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), SEPARATORS, " ")


def template_grams(spark: SparkSession, base: list[tuple[str, str]],
                   templates: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for i, (is_base, (label, phrase)) in enumerate(
            [(True, p) for p in base] + [(False, p) for p in templates]):
        words = phrase.split()
        if len(words) < K:
            raise ValueError(f"a phrase needs at least {K} words: {phrase!r}")
        rows += [(i, label, is_base, len(words) - K + 1, j, " ".join(words[j:j + K]))
                 for j in range(len(words) - K + 1)]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, grams int, tpos int, gram string"
    ).withColumn("hash", F.xxhash64("gram"))


def document_grams(docs: DataFrame) -> DataFrame:
    """One row for each rolling gram, and one with position -1 for each document,
    whose gram is its number of words. Only small columns stand beside the
    exploded array, as each is copied to every row; an outer explode is used
    because for an inner one the optimizer adds a filter that evaluates the whole
    array a second time."""
    text = text_of()
    words = F.rtrim(spaced_words(text))
    n_words = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    grams = F.expr("regexp_extract_all(_s, _r, 1)")
    return (docs.select("doc_id", F.xxhash64(text).alias("_h"), F.length(text).alias("_n"),
                        words.alias("_s"), n_words.cast("string").alias("_c"),
                        F.lit(ROLLING).alias("_r"))
            .select("doc_id", "_h", "_n", F.concat(F.array("_c"), grams).alias("_g"))
            .select("doc_id", "_h", "_n", F.posexplode_outer("_g").alias("_p", "_gram"))
            .withColumn("_p", F.col("_p") - 1))


def license_spans(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES,
                  templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Spans per document: label, base, start and end word, coverage; plus one
    row without a template for each document (n_words, copies of the row)."""
    side = F.broadcast(template_grams(docs.sparkSession, base, templates))
    grams = document_grams(docs)
    voted = (grams.join(side, (F.xxhash64("_gram") == F.col("hash"))
                        & (F.col("_gram") == F.col("gram")) & (F.col("_p") >= 0), "left")
             .where("_p < 0 or template is not null")
             .select("doc_id", "_h", "_n", F.when(F.col("_p") < 0, F.col("_gram").cast("long"))
                     .alias("n_words"), "template", "label", "base", "grams",
                     "tpos", (F.col("_p") - F.col("tpos")).alias("diagonal"))
             .repartition("doc_id", "_h", "_n"))
    document = ["doc_id", "_h", "_n"]
    lines = voted.groupBy(*document, "template", "label", "base", "grams", "diagonal").agg(
        F.array_sort(F.collect_set("tpos")).alias("tpos"), F.count("*").alias("rows"), F.max("n_words").alias("n_words"))
    order = Window.partitionBy(*document, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order)) > SLACK
    # a base phrase has to stand whole on one diagonal: its diagonals never merge
    spans = lines.withColumn("_new", F.when(F.col("base") | F.coalesce(apart, F.lit(True)), 1)
                             .otherwise(0)).withColumn("span", F.sum("_new").over(order))
    return spans.groupBy(*document, "template", "label", "base", "grams", "span").agg(
        F.min(F.col("diagonal") + F.element_at("tpos", 1)).alias("start"),
        (F.max(F.col("diagonal") + F.element_at("tpos", -1)) + K).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("votes"),
        F.max("rows").alias("rows"), F.max("n_words").alias("n_words")).withColumn(
            "coverage", F.col("votes") / F.col("grams")).withColumn(
            "verified", F.when(F.col("base"), F.col("votes") == F.col("grams"))
            .otherwise(F.col("coverage") >= MIN_COVERAGE))


def license_scan(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES,
                 templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    spans = license_spans(docs, base, templates)
    place = F.col("base") & F.col("verified")

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans.groupBy("doc_id", "_h", "_n").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"), joined(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified") | ~F.col("base"), F.col("coverage"))),
                   F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("_copies"),
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
             "score", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c")
             ).drop("_c")
