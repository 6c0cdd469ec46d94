"""Join planning helpers.

Broadcasting is only ever forced for a side whose size has been proven small:
one aggregate counts its rows and sums their serialized size (JSON text of the
rows, an over-estimate of the in-memory size), and the side is broadcast only if
it has at most ``max_rows`` rows AND at most ``max_bytes`` bytes. Each task sends
two numbers; no row is moved to be counted. Anything larger is left to
Catalyst's size-based choice and to AQE, which re-plans on real shuffle sizes
and splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION_ROW_BOUND = 1_000_000
BROADCAST_BYTE_BOUND = 64 << 20


def size_probe(df: DataFrame) -> DataFrame:
    """One row: ``n`` rows and ``b`` bytes, counted on the map side."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(row)).alias("b"))


def _plainly_large(df: DataFrame, max_bytes: int) -> bool:
    """A scan with nothing on it but projections whose files are far beyond the
    bound needs no job to be told so."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {m[1] for m in map(re.compile(r"[\s:+-]*(\w+)").match, plan.toString().splitlines()) if m}
    return nodes <= {"Project", "Relation", "Union"} and int(str(plan.stats().sizeInBytes())) > 64 * max_bytes


def fits_broadcast(df: DataFrame, max_rows: int = DIMENSION_ROW_BOUND,
                   max_bytes: int = BROADCAST_BYTE_BOUND) -> bool:
    """Whether ``df`` is proven to be within both bounds."""
    if _plainly_large(df, max_bytes):
        return False
    probe = size_probe(df).first()
    return probe["n"] <= max_rows and (probe["b"] or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = DIMENSION_ROW_BOUND,
                         max_bytes: int = BROADCAST_BYTE_BOUND) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` is proven within both bounds,
    else ``df`` unchanged (shuffle join, AQE may still broadcast it)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df
