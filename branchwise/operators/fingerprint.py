"""Order-independent table fingerprints (row count + digest) in one scan per table.

Digest = md5 of the decimal text of the exact sum of all signed 64-bit row hashes, so
duplicate rows count and row order does not. An empty table gives md5('0').

The exact sum is kept as four 16-bit limb sums in plain ``long`` aggregates (codegen'd,
partial-aggregated on every task, no decimal arithmetic per row): each limb sum stays
below 2**63 for up to 2**47 rows per table. The limbs are combined into one decimal(38,0)
only once per table, after the final aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import split_name
from ..functions.rowtext import row_hash

_LIMB_BITS = 16
_LIMB_MASK = (1 << _LIMB_BITS) - 1
_LIMBS = ("_s0", "_s1", "_s2", "_s3")


def limb_columns(h: Column) -> list[Column]:
    """Split a signed 64-bit hash into three unsigned 16-bit limbs and one signed top limb."""
    return [
        (h.bitwiseAND(F.lit(_LIMB_MASK))).alias("_s0"),
        (F.shiftright(h, 16).bitwiseAND(F.lit(_LIMB_MASK))).alias("_s1"),
        (F.shiftright(h, 32).bitwiseAND(F.lit(_LIMB_MASK))).alias("_s2"),
        F.shiftright(h, 48).alias("_s3"),
    ]


def limb_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("row_count")] + [F.sum(n).alias(n) for n in _LIMBS]


def checksum_from_limbs(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """md5 of the decimal text of s3*2^48 + s2*2^32 + s1*2^16 + s0 (NULL sums count as 0)."""
    d = "decimal(38,0)"
    total = F.lit(0).cast(d)
    for s, shift in ((s3, 48), (s2, 32), (s1, 16), (s0, 0)):
        total = total + F.coalesce(s, F.lit(0)).cast(d) * F.lit(1 << shift).cast(d)
    return F.md5(total.cast(d).cast("string"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """DF[row_count long, checksum string] of one table (one scan)."""
    # Hash once, then split: Catalyst keeps the two projections apart rather than repeating md5.
    agg = df.select(row_hash(df, columns).alias("_h")).select(*limb_columns(F.col("_h"))).agg(*limb_aggs())
    return agg.select("row_count", checksum_from_limbs(*[F.col(n) for n in _LIMBS]).alias("checksum"))


def fingerprint_all(tables: Mapping[str, DataFrame], only: Iterable[str] | None = None,
                    columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """DF[schema, table, row_count, checksum] for every table, as one job.

    All tables' row hashes go through one grouped aggregate keyed by table: every scan task
    pre-aggregates to one row per table, so the single shuffle carries a handful of rows per
    task whatever the table sizes. One zero-weight row per table keeps empty tables in the
    result (row count 0, digest md5('0')).
    ``only`` limits the tables before anything is read (skipped tables are never scanned).
    ``columns`` optionally fingerprints a subset of a table's columns (common columns).
    """
    keep = None if only is None else set(only)
    parts, names = [], []
    for name in sorted(tables):
        schema, table = split_name(name)
        if keep is not None and name not in keep and f"{schema}.{table}" not in keep:
            continue
        df = tables[name]
        names.append((schema, table))
        hashed = df.select(row_hash(df, (columns or {}).get(name)).alias("_h"))
        parts.append(hashed.select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(1).alias("_w"),
                                   *limb_columns(F.col("_h"))))
    spark = next(iter(tables.values())).sparkSession if tables else None
    if not parts:
        return _empty_fingerprints(spark)
    zeros = local_frame(spark, [(s, t, 0, 0, 0, 0, 0) for s, t in names],
                        "schema string, table string, _w int, _s0 long, _s1 long, _s2 long, _s3 long")
    u = union_all(parts + [zeros])
    agg = u.groupBy("schema", "table").agg(F.sum("_w").cast("long").alias("row_count"),
                                          *[F.sum(n).alias(n) for n in _LIMBS])
    return agg.select("schema", "table", "row_count",
                      checksum_from_limbs(*[F.col(n) for n in _LIMBS]).alias("checksum"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Balanced union: its depth grows with the logarithm of the number of parts."""
    while len(parts) > 1:
        parts = [reduce(DataFrame.unionByName, parts[k:k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]


def _empty_fingerprints(spark):
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    return local_frame(spark, [], "schema string, table string, row_count long, checksum string")
