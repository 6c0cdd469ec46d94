"""Sources: delimited files with delimiter and encoding detection, parquet
or CSV by suffix, and named tables.

The delimited reader stays on Spark's splittable CSV source, and on split
lines where quoted fields hold newlines (``quoted``). Detection reads a bounded
head sample (the first lines) plus ONE scan that counts, per split, the lines
that aren't UTF-8 and the quotes; no file is loaded through the driver.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.sources import quoted

SAMPLE_LINES = 50


def sniff_delimiter(lines: list[str]) -> str:
    """Candidate with the same non-zero field count on most sample lines
    (quotes respected); ties go to the earlier candidate."""
    best, best_score = ",", (-1, -1)
    for sep in fixed.DELIMITERS:
        counts = [len(row) for row in csv.reader(io.StringIO("\n".join(lines)), delimiter=sep)]
        if not counts or counts[0] < 2:
            continue
        agree = sum(1 for c in counts if c == counts[0])
        score = (agree, counts[0])
        if score > best_score:
            best, best_score = sep, score
    return best


def pandas_style_names(header: list[str]) -> list[str]:
    """Repeated headers become ``name``, ``name.1``, ``name.2`` ..."""
    seen: dict[str, int] = {}
    used: set[str] = set()
    out = []
    for h in header:
        k = seen.get(h, 0)
        name = h
        while name in used:
            k += 1
            name = f"{h}.{k}"
        seen[h] = k
        used.add(name)
        out.append(name)
    return out


CORRUPT = "_corrupt_record"
#: The dialect of quoted fields (RFC 4180), shared with ``sinks.export_csv``:
#: a quote inside a quoted field is doubled.
QUOTED = {"quote": '"', "escape": '"'}


def detect(spark: SparkSession, path: str) -> tuple[str, bool, DataFrame]:
    """Encoding (UTF-8 when every line is valid UTF-8, else latin-1, which
    decodes any byte), whether a quoted field goes on in the next line (a line
    holds an odd number of quotes), and the counts of each split, from one scan."""
    found = quoted.splits(spark, path)
    seen = found.agg(F.sum("not_utf8").alias("bad"), F.sum("odd_lines").alias("odd")).first()
    return ("ISO-8859-1" if seen["bad"] else "UTF-8"), bool(seen["odd"]), found


def read_delimited(spark: SparkSession, path: str, multi_line: bool | None = None,
                   sample_lines: int = SAMPLE_LINES) -> tuple[DataFrame, str, str]:
    """SRC-1: all-string DataFrame with the file's header names; returns
    (df, encoding, delimiter). Raises ValueError on a file without columns.

    Quoted fields follow RFC 4180. Where they hold newlines, records are put
    together from split lines (``quoted``); ``multi_line=True`` takes Spark's
    multi-line reader instead, one task a file, and False reads each line as a
    record. ``sample_lines`` bounds the head sample that
    decides the delimiter. Rows with more or fewer fields than the header are
    kept as far as they fit; ``malformed_rows`` counts them."""
    df, encoding, sep = _read_marked(spark, path, multi_line, sample_lines)
    return df.drop(CORRUPT), encoding, sep


def malformed_rows(spark: SparkSession, path: str, multi_line: bool | None = None) -> int:
    """Number of rows whose field count differs from the header's."""
    df, _, _ = _read_marked(spark, path, multi_line, SAMPLE_LINES)
    # the record column alone can't be read without a parsed one
    return df.select(F.col(f"`{CORRUPT}`").isNotNull().alias("bad"), *[F.col(f"`{c}`") for c in df.columns[:-1]]) \
        .agg(F.count_if("bad"), *[F.count(F.col(f"`{c}`")) for c in df.columns[:-1]]).first()[0]


def _read_marked(spark: SparkSession, path: str, multi_line: bool | None,
                 sample_lines: int) -> tuple[DataFrame, str, str]:
    encoding, newlines, found = detect(spark, path)
    first = spark.read.text(path).select(quoted.decoded(F.col("value"), encoding).alias("value"))
    head = [r["value"] for r in first.limit(sample_lines).collect()]
    head = [h for h in head if h.strip()]
    if not head:
        raise ValueError("CSV parsed to a table with no columns.")
    head[0] = head[0].lstrip("\ufeff")
    sep = sniff_delimiter(head)
    header = next(csv.reader(io.StringIO(head[0]), delimiter=sep))
    if not header or all(not h.strip() for h in header):
        raise ValueError("CSV parsed to a table with no columns.")
    names = pandas_style_names([h.strip() if h.strip() else f"Unnamed: {i}" for i, h in enumerate(header)])
    schema = ", ".join([f"c{i} string" for i in range(len(names))] + [f"{CORRUPT} string"])
    options = {**QUOTED, "sep": sep, "columnNameOfCorruptRecord": CORRUPT}
    if multi_line is None and newlines:
        df = quoted.read_records(spark, path, encoding, found, schema, options)
    else:
        df = (spark.read.schema(schema).options(**options).option("header", True).option("encoding", encoding)
              .option("multiLine", bool(multi_line)).option("mode", "PERMISSIVE").csv(path))
    return df.toDF(*names, CORRUPT), encoding, sep


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: parquet when the path ends in ``.parquet``, else a delimited file
    with a header row, typed as a reader types it (CLN-12)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    from martlet.operators.clean import infer_column_types
    return infer_column_types(read_delimited(spark, path)[0])


def scan(spark: SparkSession, table: str) -> DataFrame:
    """SRC-3: a registered table or view by name."""
    return spark.table(table)
