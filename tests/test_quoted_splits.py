"""Quoted newlines across splits: the same rows whatever the split size."""

import csv
import random

import pytest

from martlet.sources import files as SRC
from martlet.sources import quoted


def write(path, rows, end="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def cells(df):
    return sorted(tuple(r[c] or "" for c in df.columns) for r in df.collect())


@pytest.mark.parametrize("split_bytes", [37, 200, 5000, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_do_not_depend_on_the_splits(spark, tmp_path, split_bytes, end):
    rng = random.Random(split_bytes)
    text = lambda: "".join(rng.choice('ab,"\n\r é') for _ in range(rng.choice([0, 3, 30, 400])))
    names, want = ["id", "note", "more"], []
    (tmp_path / "t").mkdir()
    for k in range(3):
        rows = [[str(i), text(), "x" + text() + "x"] for i in range(rng.choice([1, 40, 120]))]
        write(tmp_path / "t" / f"{k}.csv", [names, *rows], end)
        want += [tuple(r) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df, encoding, sep = SRC.read_delimited(spark, str(tmp_path / "t"))
        got = cells(df)
        found = quoted.splits(spark, str(tmp_path / "t"))
        assert found.count() > 20 or split_bytes > 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (df.columns, encoding, sep) == (names, "UTF-8", ",")
    assert got == sorted(want)


def test_one_field_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i} \"quoted\"" for i in range(500))
    write(tmp_path / "t.csv", [["a", "b"], ["1", long], ["2", "plain"], ["3", long + "\n"]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = cells(SRC.read_delimited(spark, str(tmp_path / "t.csv"))[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("1", long), ("2", "plain"), ("3", long + "\n")])


def test_quoted_newlines_in_latin_1(spark, tmp_path):
    write(tmp_path / "t.csv", [["größe", "b"], ["é", "ü\nö"], ["x", "y"]], encoding="latin-1")
    df, encoding, _ = SRC.read_delimited(spark, str(tmp_path / "t.csv"))
    assert encoding == "ISO-8859-1" and df.columns == ["größe", "b"] and cells(df) == sorted([("é", "ü\nö"), ("x", "y")])


def test_rows_with_other_field_counts(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2\n3,4,5\n')
    df, _, _ = SRC.read_delimited(spark, str(tmp_path / "t.csv"))
    assert cells(df) == [("1", "x\ny"), ("2", ""), ("3", "4")] and SRC.malformed_rows(spark, str(tmp_path / "t.csv")) == 2


def test_plan_has_no_unsplit_file(spark, tmp_path):
    write(tmp_path / "t.csv", [["a"], ["x\ny"]])
    df, _, _ = SRC.read_delimited(spark, str(tmp_path / "t.csv"))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in p and "FileScan text" in p
