"""What schema changes mean for the rows: how many a change touches, and how many would not survive it.

One scan per touched table counts its rows and, for each change of a column, the values that the new type
can't hold or the NULLs that a NOT NULL forbids. Only the change list (one row per changed object) is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.local import local_frame
from .fingerprint import union_all

KEY = ["object_kind", "object_name", "parent", "change_rank"]
SCHEMA = "object_kind string, object_name string, parent string, change_rank int, rows_affected long, rows_failing long"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_impact(changes: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``changes`` with rows_affected and rows_failing, counted in ``tables`` (0 for tables that aren't there)."""
    by_table: dict[str, list] = {}
    for r in changes.select(*KEY, "change_type", "new_value").distinct().collect():
        by_table.setdefault(r.parent, []).append(r)
    parts = []
    for name, rows in sorted(by_table.items()):
        df = tables.get(name)
        if df is None:
            continue
        failing = []
        for r in rows:
            column = r.object_name.rsplit(".", 1)[-1]
            bad = F.lit(False)
            if r.object_kind == "column" and r.change_type == "modified" and column in df.columns:
                if r.change_rank == 0:
                    bad = F.col(_q(column)).isNotNull() & F.col(_q(column)).try_cast(r.new_value).isNull()
                elif r.change_rank == 1 and r.new_value == "false":
                    bad = F.col(_q(column)).isNull()
            failing.append(F.count_if(bad))
        counted = df.agg(F.count(F.lit(1)).alias("n"), *(f.alias(f"f{k}") for k, f in enumerate(failing)))
        lines = F.array(*(F.struct(*(F.lit(r[c]).cast(t).alias(c) for c, t in zip(KEY, ("string", "string", "string", "int"))),
                                   F.col("n").alias("rows_affected"), F.col(f"f{k}").alias("rows_failing"))
                          for k, r in enumerate(rows)))
        parts.append(counted.select(F.explode(lines).alias("r")).select("r.*"))
    counts = union_all(parts) if parts else local_frame(changes.sparkSession, [], SCHEMA)
    return changes.join(counts, KEY, "left").fillna(0, ["rows_affected", "rows_failing"])


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """DF[table, column, row_count, null_count] of every column; one scan per table."""
    parts = []
    for name, df in sorted(tables.items()):
        counted = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(_q(c)).isNull()).alias(f"c{k}")
                                                         for k, c in enumerate(df.columns)))
        lines = F.array(*(F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col("n").alias("row_count"),
                                   F.col(f"c{k}").alias("null_count")) for k, c in enumerate(df.columns)))
        parts.append(counted.select(F.explode(lines).alias("r")).select("r.*"))
    return union_all(parts)
