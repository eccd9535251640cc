"""Data diff of two fingerprint sets (one row per table on each side).

A table on both sides changed when its digest differs; a table only on the current side
changed when it has rows; a table only on the base side always changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import signed_text


def compare_data(base_fp: DataFrame, cur_fp: DataFrame) -> DataFrame:
    """DF[schema, table, base_rows, curr_rows, has_change] (full outer join on schema, table)."""
    b = base_fp.select("schema", "table", F.col("row_count").alias("_b_rows"), F.col("checksum").alias("_b_sum"))
    c = cur_fp.select("schema", "table", F.col("row_count").alias("_c_rows"), F.col("checksum").alias("_c_sum"))
    j = b.join(c, ["schema", "table"], "full_outer")
    has_change = (F.when(F.col("_b_sum").isNull(), F.col("_c_rows") > 0)
                  .when(F.col("_c_sum").isNull(), F.lit(True))
                  .otherwise(F.col("_b_sum") != F.col("_c_sum")))
    return j.select("schema", "table",
                    F.coalesce("_b_rows", F.lit(0).cast("long")).alias("base_rows"),
                    F.coalesce("_c_rows", F.lit(0).cast("long")).alias("curr_rows"),
                    has_change.alias("has_change"))


def data_change_lines(changes: DataFrame) -> DataFrame:
    """Changed tables only, with the report line ``  ~ s.t (a -> b rows, +d)``."""
    d = F.col("curr_rows") - F.col("base_rows")
    return (changes.filter("has_change")
            .select("schema", "table", "base_rows", "curr_rows",
                    (d).alias("row_diff"),
                    F.format_string("  ~ %s.%s (%d -> %d rows, %s)", "schema", "table", "base_rows",
                                    "curr_rows", signed_text(d)).alias("line")))


def format_data_changes(changes: DataFrame) -> str:
    """Report text; collects one short line per changed table (the report itself)."""
    rows = data_change_lines(changes).orderBy("schema", "table").select("line").collect()
    if not rows:
        return "No data changes."
    return f"Data changes ({len(rows)} tables modified):\n" + "".join(r.line + "\n" for r in rows)


def divergent_tables(main_fp: DataFrame, branch_fp: DataFrame) -> DataFrame:
    """Tables on both sides whose digests differ: DF[schema, table, main_rows, branch_rows]."""
    m = main_fp.select("schema", "table", F.col("row_count").alias("main_rows"), F.col("checksum").alias("_m"))
    b = branch_fp.select("schema", "table", F.col("row_count").alias("branch_rows"), F.col("checksum").alias("_b"))
    return m.join(b, ["schema", "table"], "inner").filter(F.col("_m") != F.col("_b")) \
        .select("schema", "table", "main_rows", "branch_rows")
