"""A small table of documents with every awkward case: nulls in any column, empty and
long texts, copies, near copies, repeated rows, and columns whose names clash with
working columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("key", T.StringType()), T.StructField("_text", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    T.StructField("n", T.IntegerType()), T.StructField("rep", T.LongType()),
])


def vocabulary(n=400, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
            for _ in range(n)]


def texts(seed=5):
    rnd = random.Random(seed)
    words = vocabulary()

    def some(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passage, base = some(45), some(120)
    near = base.split()
    near[60] = "changed"
    out = [some(rnd.randint(1, 90)) for _ in range(40)]
    out += [base, base, "  ".join(base.split(" ")), " ".join(near), base.upper()]
    out += [some(30) + "\n" + passage + "\t" + some(20) for _ in range(6)]
    out += [None, "", " \n\t ", "one", "one two", "one two three", "é ß \u2003 日本 😀 İ K",
            "Released under the MIT License.", some(6000)]
    return out


def rows():
    out = []
    for i, text in enumerate(texts()):
        out.append((i * 3 + 1, text, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}",
                    None if text is None or i % 4 == 0 else len(text), "k", "other", 0.5, None, i, -i))
    out.append(out[2])                                    # a repeated row
    out.append((None, out[3][1], *out[3][2:]))            # no identifier
    out.append((out[4][0], "another text of the same identifier", *out[4][2:]))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
