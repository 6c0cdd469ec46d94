"""Distributed least-significant-digit radix sort: final positions of all rows
in the order of composite integer keys, without a range partitioner, samples of
the data or a sort of all rows anywhere.

The keys are laid out as one bit string of just as many bits as their ranges
need (one aggregate finds them) and cut into digits of at most ``DIGIT_BITS``.
Each pass is a stable counting sort by one digit, the last digit first:

1. rows lie in blocks, ordered by block and position; each block counts its
   digits (combined on the map side);
2. global prefix sums over (digit, block) give where each block's rows of each
   digit begin;
3. in its block, a row's destination is that beginning plus the number of rows
   of its digit before it; destinations give the blocks of the next pass.

After the last pass the destination is the rank. Rows with equal keys keep the
order in which they were first written, so their ranks are consecutive and any
of the equal orders; callers who want one order add keys until ties are equal rows.

Scale: a pass shuffles the rows once by block and writes them, so a lost
executor costs no more than that pass; a block has ``block_rows`` rows whatever
the keys are, so equal keys (a third of all rows or all of them) load no task
more than others. The counts of a pass have at most ``2 ** DIGIT_BITS`` rows per
block; only the totals per digit (``2 ** DIGIT_BITS`` rows) meet in one task.
Blocks of the first pass are the input's partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import materialise

DIGIT_BITS = 11
LEAST_BLOCK = 1 << 14
MOST_BLOCK = 1 << 18
_LOW_BITS = 1 << 33  # monotonically_increasing_id: position within the partition


def fields_of(rows: DataFrame, keys: list[str]) -> tuple[int, list[tuple[Column, int]]]:
    """The number of rows, and non-negative columns that order as ``keys`` do
    (nulls last) with the bits that each needs, the most significant first."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(k)).alias(f"{name}{i}") for i, k in enumerate(keys)
                                                    for name, f in (("low", F.min), ("high", F.max), ("there", F.count))]).first()
    out = []
    for i, k in enumerate(keys):
        low, high = seen[f"low{i}"], seen[f"high{i}"]
        if seen[f"there{i}"] < seen["n"]:
            out.append((F.col(k).isNull().cast("bigint"), 1))
        if low is None or low == high:
            continue
        if high - low < 1 << 63:
            out.append((F.coalesce(F.col(k) - F.lit(low).cast("bigint"), F.lit(0)), (high - low).bit_length()))
        else:  # as unsigned numbers: the sign bit turned over
            out.append((F.coalesce(F.col(k).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), F.lit(0)), 64))
    return seen["n"], out


def digit(fields: list[tuple[str, int]], low: int, width: int) -> Column:
    """Bits ``low`` to ``low + width`` of the bit string of ``fields`` (names
    and bits, the most significant first)."""
    begin, parts = 0, []
    for name, bits in reversed(fields):
        a, b = max(begin, low), min(begin + bits, low + width)
        if a < b:
            part = F.shiftrightunsigned(name, a - begin).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
            parts.append(F.shiftleft(part, a - low))
        begin += bits
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out.cast("int")


def begins(counts: DataFrame) -> DataFrame:
    """``block, digit, begin`` from ``block, digit, n``: global prefix sums in
    the order of digit and block."""
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("digit").agg(F.sum("n").alias("all"))
    totals = totals.select("digit", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "digit")
            .select("block", "digit", (F.col("below") + F.col("own")).alias("begin")))


def _placer(block_rows: int):
    def place(rows: pa.Table, starts: pa.Table) -> pa.Table:
        """Destinations of a block's rows by a stable counting sort of its digits."""
        order = np.argsort(rows["seq"].to_numpy(), kind="stable")
        digits = rows["digit"].to_numpy()[order]
        begin = np.zeros(int(digits.max()) + 1, np.int64)
        begin[starts["digit"].to_numpy()] = starts["begin"].to_numpy()
        count = np.bincount(digits)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        by_digit = np.argsort(digits, kind="stable")
        to = np.empty(len(digits), np.int64)
        to[order[by_digit]] = (begin - first)[digits[by_digit]] + np.arange(len(digits))
        rows = rows.drop_columns(["block", "seq", "digit"])
        return (rows.append_column("block", pa.array(to // block_rows, pa.int64()))
                .append_column("seq", pa.array(to, pa.int64())))
    return place


def ranked(rows: DataFrame, keys: list[str], rank: str = "rank", digit_bits: int = DIGIT_BITS,
           block_rows: int | None = None) -> DataFrame:
    """``rows`` with ``rank``, 0, 1, ... in ascending order of the integer
    columns ``keys`` (nulls last). ``block_rows`` defaults to the rows over the
    session's shuffle partitions, within fixed bounds; ranks don't depend on it
    but among equal keys."""
    names = rows.columns
    written = materialise(rows.select(
        F.struct("*").alias("row"), F.spark_partition_id().cast("bigint").alias("block"),
        (F.monotonically_increasing_id() % F.lit(_LOW_BITS)).alias("seq")), "radix0")
    n, found = fields_of(written, [f"row.`{k}`" for k in keys])
    if block_rows is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block_rows = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // parts)))
    state = written.select("row", *[c.cast("bigint").alias(f"f{i}") for i, (c, _) in enumerate(found)], "block", "seq")
    fields = [(f"f{i}", bits) for i, (_, bits) in enumerate(found)]
    total = sum(bits for _, bits in fields)
    passes = max(1, -(-total // digit_bits))
    width = -(-total // passes)
    kind = ", ".join([f"`row` {state.schema['row'].dataType.simpleString()}", *[f"`{f}` bigint" for f, _ in fields],
                      "block bigint", "seq bigint"])
    for p in range(passes):
        low = p * width
        # without any key (or row) one pass with a digit of 0 numbers the rows as they lie
        now = state.withColumn("digit", digit(fields, low, min(width, total - low)) if total else F.lit(0))
        counts = materialise(now.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")), f"counts{p}")
        state = materialise(now.groupBy("block").cogroup(begins(counts).groupBy("block"))
                            .applyInArrow(_placer(block_rows), kind), f"radix{p + 1}")
    return state.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("seq").alias(rank))
