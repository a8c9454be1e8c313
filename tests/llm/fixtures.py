"""Rows that every operator of the folder has to get through, and the smallest table."""

from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def rows(*texts, start=1):
    return [(start + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def prose(words, seed=0):
    """Made-up words, the same for the same seed."""
    out, state = [], seed * 7919 + 1
    for _ in range(words):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("".join(chr(97 + (state >> s) % 26) for s in (3, 9, 14, 20)[: 2 + state % 3]))
    return " ".join(out)


def edges():
    """Nulls, empty and long texts, repeated rows and ids, ties."""
    text = prose(80)
    data = rows("", None, " \n\t ", "one", text, text, prose(30, 3) + " " + text, "É ß ünï ÀB " + text.upper(), "a" * 5000, start=10)
    data += [(None, text, None, None, None), (None, None, None, None, None), (None, "lonely words without an id", None, None, None)]
    data += [data[4], data[4], (14, prose(40, 9), "fr", "src1", len(prose(40, 9))), (-5, prose(60, 4), "de", "src0", len(prose(60, 4)))]
    data += rows(prose(30000, 5), start=99)
    return data
