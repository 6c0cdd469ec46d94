"""Rows that every operator must take: nulls, empty and long texts, ties,
repeated rows, and extra columns whose names the operators use themselves."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the cat sat on the mat and the dog lay by the door while rain fell on the old roof of the house " * 4
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "word", "en", None, 4),
    (5, GOOD, "en", "a", len(GOOD)), (5, GOOD, "en", "a", len(GOOD)), (6, GOOD, "de", "b", len(GOOD)),
    (None, GOOD, "en", "b", len(GOOD)), (None, None, None, None, None), (7, "x y " * 40_000, "en", "b", 160_000),
    (8, "é中😀 <|endoftext|> it's ### !!", "fr", "c", 30), (9, "one two three four", "en", "c", 18),
    (10, "one two three four", "en", "c", 18),
]
CLASHING = ("size", "rate", "k", "cell", "side", "trusted", "gram", "kept", "score", "n", "chunk", "words", "_doc", "c")


def documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("extra"))
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((5, 1, 0), (6, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (5, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
