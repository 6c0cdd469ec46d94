"""Dates in text against pandas' mixed format."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlet.operators import clean as CL
from martlet.operators import dates as D

TEXTS = [
    "13/05/2024", "05/13/2024", "5/6/24", "06-05-2024", "2024.05.06", "Monday, May 6, 2024", "6 May 24", "6-May-24",
    "20240506T101112", "20240506", "20240506101112", "2024-05-06", "2024-05-06T10:11:12", "2024-05-06 10:11:12.345678",
    "2024/5/6", "2024 5 6", "May 2024", "may 2024", "6-May-2024", "6 May 2024", "May 6, 2024", "May 6 2024", "Sept 6, 2024",
    "Sep. 6, 2024", "6th May 2024", "May 6th, 2024", "2024-05", "2024/05", "2024", "5/6/2024 2:05 PM", "5/6/2024 12:00 AM",
    "5/6/2024 12:30 pm", "31/12/1999", "12/31/99", "2024-05-06 10:00", "06.05.2024", "13.05.2024", "2024 May 6",
    "May 6, 2024 10:11", "Mon 6 May 2024 10:11:12", "1/1/76", "1/1/75",
]
NO_DATES = ["", "not recorded", "2024-13-45", "45/67/2024", "2024-02-30", "hello 2024 world", "123.45", "12345678", "99",
            "ref-12", "1,234.56", "10:00 maybe", "5/6/2024 25:00", "5/6/2024 13:05 PM", "marching 5, 2024", "x" * 70 + "2024"]


def parsed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    shapes = D.census(df, {"t": F.col("t")})["t"]
    rows = df.select("i", D.parse(F.col("t"), D.plans_of(shapes), **options).alias("d")).collect()
    return [r["d"] for r in sorted(rows, key=lambda r: r["i"])]


def test_spellings_equal_pandas(spark):
    want = pd.to_datetime(pd.Series(TEXTS), errors="coerce", format="mixed")
    got = parsed(spark, TEXTS)
    assert {t: None if g is None else str(pd.Timestamp(g)) for t, g in zip(TEXTS, got)} == {
        t: None if pd.isna(w) else str(w) for t, w in zip(TEXTS, want)}


def test_no_dates(spark):
    assert parsed(spark, NO_DATES) == [None] * len(NO_DATES)


def test_offsets_are_instants(spark):
    texts = ["2024-05-06T10:00:00Z", "2024-05-06T10:00:00+02:00", "2024-05-06 10:00:00-0530", "2024-05-06T10:00:00.5 UTC"]
    want = [pd.Timestamp(pd.to_datetime(t, utc=True)).tz_localize(None) for t in texts]
    assert [pd.Timestamp(g) for g in parsed(spark, texts)] == want


def test_random_dates_equal_pandas(spark):
    rng = random.Random(6)
    formats = ["%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%d-%b-%Y", "%B %d, %Y", "%d %B %Y %H:%M", "%m-%d-%Y %I:%M %p", "%Y%m%d",
               "%a, %d %b %Y %H:%M:%S", "%A, %B %d, %Y", "%m.%d.%Y", "%d.%m.%Y", "%Y/%m/%d %H:%M:%S.%f"]
    texts = [pd.Timestamp(rng.randint(0, 4_000_000_000), unit="s").strftime(rng.choice(formats)) for _ in range(400)]
    want = pd.to_datetime(pd.Series(texts), errors="coerce", format="mixed")
    got = parsed(spark, texts)
    assert [(t, pd.Timestamp(g) if g else None) for t, g in zip(texts, got)] == [
        (t, None if pd.isna(w) else w) for t, w in zip(texts, want)]


def test_the_column_may_decide_the_order(spark):
    df = spark.createDataFrame([("5/6/2024", "5/6/2024"), ("25/6/2024", "6/25/2024")], "eu string, us string")
    shapes = D.census(df, {c: F.col(c) for c in df.columns})
    assert D.day_comes_first(shapes["eu"]) and not D.day_comes_first(shapes["us"])
    row = df.select(*[D.parse(F.col(c), D.plans_of(shapes[c]), D.day_comes_first(shapes[c])).alias(c) for c in df.columns]).first()
    assert (row["eu"].month, row["us"].month) == (6, 5)


def test_shapes_that_come_to_the_driver_are_bounded_by_the_grammar(spark):
    df = spark.range(3000).selectExpr("concat(id, ' words of free text no ', id * 7919) AS t")
    assert D.census(df, {"t": F.col("t")}) == {"t": {}}


@pytest.mark.parametrize("day_first", [False, "evidence"])
def test_coercion_uses_the_census(spark, day_first):
    rows = [("13/05/2024", "1"), ("01/05/2024", "2"), ("5/6/24 10:00", "3"), (None, "4")]
    df = spark.createDataFrame(rows, "when_at string, n string")
    coerced, decisions = CL.coerce_types(df, day_first=day_first)
    assert {d.column: d.decision for d in decisions} == {"when_at": "date", "n": "number"}
    got = [None if r[0] is None else str(r[0]) for r in coerced.collect()]
    assert got == ["2024-05-13 00:00:00", "2024-05-01 00:00:00" if day_first else "2024-01-05 00:00:00",
                   "2024-06-05 10:00:00" if day_first else "2024-05-06 10:00:00", None]
