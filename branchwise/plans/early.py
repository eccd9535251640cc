"""Does anything differ, or conflict? Answered with as little reading as the answer takes.

Tables that are the same files on both sides don't differ. Then row counts are compared, which Parquet has in its footers, all
tables in one job. Only if these agree are rows read: table by table, those with the fewest bytes that no stored sums cover first, until
one differs. A full diff reads every table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filesums import list_files
from ..operators.fingerprint import union_all
from ..sources.namespace import Namespace
from .merge import _ns, _same_files, side_fingerprints


def _counts(ns: Namespace, names: list[str]) -> dict[str, int]:
    parts = [ns.tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n") for n in names]
    return {r.t: r.n for r in union_all(parts).collect()} if parts else {}  # one row per table


def _unread(spark, main: Namespace, branch: Namespace, names: list[str]) -> dict[str, int]:
    """Bytes of each table's files, on both sides, that no stored sums cover."""
    known = [ns.sums.select("file", "size", "modified") for ns in (main, branch) if ns.sums is not None]
    parts = [list_files(spark, ns.paths[n]).withColumn("t", F.lit(n)) for ns in (main, branch) for n in names if n in ns.paths]
    if not parts:
        return {}
    files = union_all(parts)
    if known:
        files = files.join(union_all(known).distinct(), ["file", "size", "modified"], "left_anti")
    return {r.t: r.bytes for r in files.groupBy("t").agg(F.sum("size").alias("bytes")).collect()}


def first_difference(main, branch, names: Iterable[str] | None = None, read: list[str] | None = None) -> str | None:
    """A table whose rows differ between the sides (one that only one side has differs), or None. ``read`` collects the files read."""
    main, branch = _ns(main), _ns(branch)
    every = sorted(set(main.tables) | set(branch.tables) if names is None else set(names))
    for n in every:
        if (n in main.tables) != (n in branch.tables):
            return n
    every = [n for n in every if n in main.tables and not _same_files(main, branch, n)]
    if not every:
        return None
    a, b = _counts(main, every), _counts(branch, every)
    for n in every:
        if a[n] != b[n]:
            return n
    spark = main.tables[every[0]].sparkSession
    unread = _unread(spark, main, branch, every)
    for n in sorted(every, key=lambda n: (unread.get(n, 0), n)):
        before, now, files = side_fingerprints(main, branch, [n])
        if read is not None and files is not None:
            read += files.read
        if _digest(before) != _digest(now):
            return n
    return None


def _digest(fp: DataFrame) -> tuple:
    r = fp.first()
    return (r.row_count, r.checksum)


def first_conflict(base_fp: DataFrame, main, branch, names: Iterable[str] | None = None, read: list[str] | None = None) -> str | None:
    """A table whose rows both sides changed since the branch point, and not alike; or None.

    ``base_fp`` are the branch point's fingerprints (schema, table, row_count, checksum: one row per table). A side whose count differs from
    the branch point's changed the table, so its rows need not be read for that.
    """
    main, branch = _ns(main), _ns(branch)
    base = {f"{r.schema}.{r.table}": (r.row_count, r.checksum) for r in base_fp.collect()}
    both = [n for n in sorted(base if names is None else set(names) & set(base)) if n in main.tables and n in branch.tables
            and not _same_files(main, branch, n)]
    if not both:
        return None
    a, b = _counts(main, both), _counts(branch, both)
    if sure := [n for n in both if a[n] != b[n] and a[n] != base[n][0] and b[n] != base[n][0]]:
        return sure[0]
    unread = _unread(main.tables[both[0]].sparkSession, main, branch, both)
    for n in sorted(both, key=lambda n: (unread.get(n, 0), n)):
        before, now, files = side_fingerprints(main, branch, [n])
        if read is not None and files is not None:
            read += files.read
        x, y = _digest(before), _digest(now)
        if x != y and x != base[n] and y != base[n]:
            return n
    return None
