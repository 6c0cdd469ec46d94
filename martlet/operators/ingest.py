"""Upload -> star schema: cleaning, profiling, roles, blueprint, then the
fact table and one dimension table per low-cardinality column.

Lineage: the cleaned frame is written once as the fact table (a table in
the shared folder, not a cache), then read back for the profile and the
dimensions, so a lost executor never re-runs the cleaning plan.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators import clean as CL
from martlet.operators import profile as PR
from martlet.session import scratch_run
from martlet.sources.sinks import write_table


@dataclass
class StarResult:
    blueprint: PR.Blueprint
    rename_map: dict[str, str]
    decisions: list[CL.Coercion]
    tables: dict[str, str]          # table name -> written path
    report: CL.CleaningReport


def build_star(raw: DataFrame, prefix: str, out_dir: str) -> StarResult:
    """PRF-5: CLN-1..14 -> PRF-1..4 -> fact and dimensions written.

    Scans: the input twice (typing aggregate, which also counts the rows
    read; the deduplicating write), the deduplicated rows for the coercion
    counts and for the fact write, the fact's open texts once for their roles
    and its dimension columns once for ALL dimensions together."""
    with scratch_run(raw.sparkSession):  # everything is written to ``out_dir`` when it ends
        return _build_star(raw, prefix, out_dir)


def _build_star(raw: DataFrame, prefix: str, out_dir: str) -> StarResult:
    spark = raw.sparkSession
    if not raw.columns:
        raise ValueError("CSV parsed to a table with no columns.")
    cleaned, rename_map, decisions, rows_read, kept = CL.clean_and_coerce(raw)
    if kept == 0:
        raise ValueError("No data remains after cleaning — the file may be empty or consist "
                         "entirely of duplicate rows.")
    fact_path = os.path.join(out_dir, PR.fact_table_name(prefix))
    write_table(cleaned, fact_path, "overwrite")
    fact = spark.read.parquet(fact_path)
    bp, _ = PR.build_blueprint(PR.column_roles(fact), prefix)
    tables = {bp.fact_table: fact_path}
    dim_cols = list(bp.dim_tables.values())
    # dimension columns hold <= MAX_DIMENSION_CARDINALITY values (exact
    # sketches), so all of them come from one grouping-sets pass
    values = PR.dimension_values(fact, dim_cols) if dim_cols else None
    for dim_table, column in bp.dim_tables.items():
        path = os.path.join(out_dir, dim_table)
        dim = (PR.dimension_table(values, dim_cols, column) if values is not None
               else PR.extract_dimension(fact, column))
        write_table(dim, path, "overwrite")
        tables[dim_table] = path
    return StarResult(bp, rename_map, decisions, tables,
                      CL.CleaningReport(rows_read, kept, rows_read - kept))


def star_counts(result: StarResult, spark) -> DataFrame:
    """(table_name, kind, rows) of the written tables, read back."""
    parts = []
    for name, path in result.tables.items():
        kind = "fact" if name == result.blueprint.fact_table else "dimension"
        parts.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("table_name"), F.lit(kind).alias("kind"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
