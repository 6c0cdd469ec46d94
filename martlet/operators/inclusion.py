"""PRF-9, foreign keys: which column's values all occur in a key of another
table (unary inclusion dependencies).

The catalogue lists declared foreign keys; Parquet declares none, so they are
found from the values, without joining any pair of columns:

1. One scan of every table sketches its columns (``sketches``). A pair (child,
   parent) of one class is dropped as soon as the difference of the two sketches
   holds an entry: below the common threshold sketches are complete, so such
   a value is certainly missing. Every pair that isn't true but for a few
   values goes here; what is left follows the schema, not the data.
2. One pass over the remaining columns turns every value into the set of columns
   that hold it: rows are exploded into (class, value), grouped, and the sets are
   bit masks combined on the map side, so a value that a third of all rows share
   is one row per task. Per pair it counts the values whose set has the child and
   not the parent, and per parent its distinct values, in one aggregate.

A parent must be a key: without nulls and with a different value in every row.
Nulls in a child refer to nothing. Floating, boolean and nested columns take no
part. A column without values is no child.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators.sketches import estimate, may_be_key, plain_value, value_class, warehouse_sketches

CLASSES = ("integer", "text", "time", "instant", "decimal")
_BITS = 62
SCHEMA = ("child_table string, child_column string, parent_table string, parent_column string, "
          "child_values bigint, parent_values bigint")


def possible_pairs(sketches: DataFrame) -> list:
    """(child ti, ci; parent ti, ci, rows) that the sketches don't refute. The
    join is of columns with columns: its size is the schema's."""
    known = sketches.where(F.col("class").isin(*CLASSES) & (F.col("non_null") > 0))
    child = known.select("class", F.col("ti").alias("cti"), F.col("ci").alias("cci"), F.col("sketch").alias("cs"))
    parent = known.where(may_be_key(estimate("sketch"))).select(
        "class", F.col("ti").alias("pti"), F.col("ci").alias("pci"), F.col("sketch").alias("ps"), "rows")
    missing = F.theta_sketch_estimate(F.theta_difference("cs", "ps"))
    pairs = child.join(parent, "class").where((F.col("cti") != F.col("pti")) | (F.col("cci") != F.col("pci")))
    return pairs.where(missing == 0).select("cti", "cci", "pti", "pci", "rows").collect()


def _memberships(tables: list[DataFrame], used: list[tuple[int, int]]) -> DataFrame:
    """``kind, l, s`` and masks ``m0, m1, ...``: every value of the columns
    ``used`` with the set of columns that hold it."""
    words = -(-len(used) // _BITS)
    bit = {c: (k // _BITS, 1 << (k % _BITS)) for k, c in enumerate(used)}
    rows = None
    for ti, df in enumerate(tables):
        items = []
        for ci, f in enumerate(df.schema.fields):
            if (ti, ci) not in bit:
                continue
            kind, (word, mask) = value_class(f.dataType), bit[ti, ci]
            number, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
            if kind in ("integer", "instant"):
                number = plain_value(f)
            else:
                text = plain_value(f)
            items.append(F.struct(F.lit(kind).alias("kind"), number.alias("l"), text.alias("s"),
                                  *[F.lit(mask if w == word else 0).cast("bigint").alias(f"m{w}") for w in range(words)]))
        if items:
            one = df.select(F.explode(F.array(*items)).alias("e")).select("e.*")
            rows = one if rows is None else rows.unionByName(one)
    there = rows.where(F.col("l").isNotNull() | F.col("s").isNotNull())
    return there.groupBy("kind", "l", "s").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)])


def foreign_keys(tables: dict[str, DataFrame], sketches: DataFrame | None = None) -> DataFrame:
    """PRF-9: (child_table, child_column, parent_table, parent_column,
    child_values, parent_values) of every inclusion in a key; the last two are
    the numbers of distinct values."""
    names, frames = list(tables), list(tables.values())
    spark = frames[0].sparkSession
    pairs = possible_pairs(warehouse_sketches(tables) if sketches is None else sketches)
    if not pairs:
        return spark.createDataFrame([], SCHEMA)
    used = sorted({(p["cti"], p["cci"]) for p in pairs} | {(p["pti"], p["pci"]) for p in pairs})
    place = {c: k for k, c in enumerate(used)}

    def holds(k: int):
        return F.col(f"m{k // _BITS}").bitwiseAND(F.lit(1 << (k % _BITS)).cast("bigint")) != 0

    found = _memberships(frames, used).agg(
        *[F.count_if(holds(k)).alias(f"n{k}") for k in range(len(used))],
        *[F.count_if(holds(place[p["cti"], p["cci"]]) & ~holds(place[p["pti"], p["pci"]])).alias(f"x{i}")
          for i, p in enumerate(pairs)]).first()
    rows = []
    for i, p in enumerate(pairs):
        child, parent = (p["cti"], p["cci"]), (p["pti"], p["pci"])
        if found[f"x{i}"] == 0 and found[f"n{place[parent]}"] == p["rows"]:
            rows.append((names[child[0]], frames[child[0]].columns[child[1]], names[parent[0]],
                         frames[parent[0]].columns[parent[1]], found[f"n{place[child]}"], found[f"n{place[parent]}"]))
    return spark.createDataFrame(sorted(rows), SCHEMA)
