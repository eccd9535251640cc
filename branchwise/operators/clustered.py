"""Key-clustered tables and an anti join that reads only the ranges of keys that it needs.

``clustered`` deals rows into files by ranges of the key and sorts each file, so a file's (and row group's) least and largest key
bound a narrow range. ``key_ranges`` finds the ranges that a table's keys lie in: the least and largest key of each file and partition of its scan, an
aggregate that each task does for itself, joined where they meet. ``new_rows`` gives them to main's scan as a filter on the key,
which Parquet pushes down to files and row groups, so main is read only where the branch has keys at all. Rows that the filter
keeps out can't match a branch row, so the result is that of the plain anti join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows as R

#: Ranges that a filter names, at most.
RANGES = 32


def clustered(df: DataFrame, keys: Sequence[str], files: int) -> DataFrame:
    """Rows dealt by ranges of ``keys`` into at most ``files`` partitions, sorted within."""
    columns = [F.col(R._q(k)) for k in keys]
    return df.repartitionByRange(max(1, files), *columns).sortWithinPartitions(*columns)


def join_ranges(ranges: list[tuple], most: int) -> list[tuple]:
    """Ranges (low, high) in order, overlapping ones joined, then neighbours until there are ``most`` at most."""
    out: list[list] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    step = -(-len(out) // most) if out else 1
    return [(out[k][0], out[min(k + step, len(out)) - 1][1]) for k in range(0, len(out), step)]


def key_ranges(df: DataFrame, key: str, most: int = RANGES) -> tuple[list[tuple], bool]:
    """Ranges that hold all of a column's values, and whether it has NULLs. One row per file and partition of the scan comes to the driver."""
    k = F.col(R._q(key))
    found = df.select(k.alias("k"), F.spark_partition_id().alias("p"), F.input_file_name().alias("f")).groupBy("p", "f").agg(F.min("k").alias("low"), F.max("k").alias("high"),
                                                                        F.count_if(F.col("k").isNull()).alias("nulls")).collect()
    return join_ranges([(r.low, r.high) for r in found if r.low is not None], most), any(r.nulls for r in found)


def in_ranges(key: str, ranges: list[tuple], nulls: bool) -> Column:
    k = F.col(R._q(key))
    parts = [k.between(F.lit(low), F.lit(high)) for low, high in ranges] + ([k.isNull()] if nulls else [])
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def pruned(main: DataFrame, branch: DataFrame, key: str, most: int = RANGES) -> DataFrame:
    """``main`` where ``branch`` has values of ``key`` near by."""
    return main.where(in_ranges(key, *key_ranges(branch, key, most)))


def new_rows(branch: DataFrame, main: DataFrame, pk: Sequence[str], most: int = RANGES) -> DataFrame:
    """What ``rows.new_rows`` returns; of main only the ranges of the first key column in which the branch has keys are read."""
    pk = list(pk)
    if branch.schema[pk[0]].dataType != main.schema[pk[0]].dataType:
        return R.new_rows(branch, main, pk)
    return R.new_rows(branch, pruned(main.select(*[R._q(k) for k in pk]), branch, pk[0], most), pk)
