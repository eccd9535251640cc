"""Fingerprints kept per data file, so that a file that was summed once is never read again.

A table's digest is a sum over its rows (``fingerprint``), so it is the sum of its files' sums. ``FileSums`` lists the files of
one or more namespaces (names, sizes and times, no rows), takes what is known of them from stored sums, and reads only the
files that are left: each file once, however many tables and sides refer to it. A table's fingerprint then adds its files' rows.

Stored sums are a table with one row per file and shape: file, size, modified, shape, row_count and the four limb sums.
A file that was replaced has another size or time, a table whose columns changed another shape; neither matches, so both are
read anew. The files' metadata stays in tables; only the names of files to be read come to the driver, and where a
table has over ``NAMED`` of them it is read whole instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.local import local_frame
from ..functions.names import split_name
from ..functions.rowtext import row_hash
from ..session import scratch_path
from .fingerprint import _LIMBS, checksum_from_limbs, limb_columns, union_all

FILE = "file string, size long, modified timestamp, shape string"
SUMS_SCHEMA = f"{FILE}, row_count long, {', '.join(f'{n} long' for n in _LIMBS)}"
#: Files of one table that are named one by one in a scan's filter.
NAMED = 10_000
_KEY = ["file", "size", "modified", "shape"]


def shape_of(schema: T.StructType, columns: Sequence[str] | None = None) -> str:
    """Names the columns (in order, with types) that a file's sums cover."""
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return hashlib.md5(text.encode()).hexdigest()


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(list(paths))


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, size, modified of every data file below the paths; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_modification_time").alias("modified"))


def file_limbs(df: DataFrame, shape: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row's file and limbs; ``df`` is a plain scan."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "size"),
                                                           ("file_modification_time", "modified"))]
    hashed = df.select(*meta, row_hash(df, list(columns) if columns is not None else None).alias("_h"))
    return hashed.select("file", "size", "modified", F.lit(shape).alias("shape"), F.lit(1).cast("long").alias("row_count"),
                         *limb_columns(F.col("_h")))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class FileSums:
    """Files and their sums of the tables of some namespaces.

    ``sides`` maps a side's name to ``{table: (paths, schema, format)}``; ``known`` are stored sums; ``only`` limits the tables before
    anything is listed; ``columns`` the columns of a table that count.
    """

    def __init__(self, spark: SparkSession, sides: Mapping[str, Mapping[str, tuple]], known: DataFrame | None = None,
                 only: Iterable[str] | None = None, columns: Mapping[str, Sequence[str]] | None = None):
        keep, columns = None if only is None else set(only), columns or {}
        known = local_frame(spark, [], SUMS_SCHEMA) if known is None else known
        sources: dict[tuple, tuple] = {}  # a shape of some paths: their files are listed once for all sides
        uses = []
        for side, tables in sides.items():
            for name, (paths, schema, fmt) in sorted(tables.items()):
                if keep is None or name in keep:
                    at = (tuple(sorted(paths)), shape_of(schema, columns.get(name)))
                    place = list(sources).index(at) if at in sources else len(sources)
                    sources.setdefault(at, (paths, schema, fmt, columns.get(name)))
                    uses.append((side, *split_name(name), place))
        self.spark = spark
        self.uses = local_frame(spark, uses, "side string, schema string, table string, source int")
        if not sources:
            self.files, self.sums, self.read = local_frame(spark, [], f"source int, {FILE}"), local_frame(spark, [], SUMS_SCHEMA), []
            return
        listed = [list_files(spark, paths).withColumn("shape", F.lit(shape)).withColumn("source", F.lit(k))
                  for k, ((paths, shape)) in enumerate(sources)]
        self.files = _kept(union_all(listed).select("source", *_KEY), "files")
        known = known.select(*T.StructType.fromDDL(SUMS_SCHEMA).fieldNames()).dropDuplicates(_KEY)
        unseen = _kept(self.files.join(known, _KEY, "left_anti").groupBy(*_KEY).agg(F.min("source").alias("source")), "unseen")
        counts = {r.source: r["n"] for r in unseen.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per source
        names: dict[int, list[str]] = {k: [] for k, n in counts.items() if n <= NAMED}
        for r in unseen.where(F.col("source").isin(list(names))).select("source", "file").collect() if names else ():
            names[r.source].append(r.file)
        self.read = [f for own in names.values() for f in own]
        limbs = []
        for k, (paths, schema, fmt, cols) in enumerate(sources.values()):
            if k not in counts:
                continue
            df = read_files(spark, paths, schema, fmt)
            if k in names:
                df = df.where(F.col("_metadata.file_path").isin(names[k]))  # the other files are pruned from the scan
            limbs.append(file_limbs(df, list(sources)[k][1], cols).withColumn("source", F.lit(k)))
        # a file without rows has none to sum, so each has one of no weight; all tables go through one aggregate
        by, sums = [*_KEY, "source"], ["row_count", *_LIMBS]
        zeros = unseen.select(*_KEY, *[F.lit(0).cast("long").alias(c) for c in sums], "source")
        new = union_all([*limbs, zeros]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
        # a table that was read whole has other files as well; each file counts for the one table it was to be read for
        new = new.join(F.broadcast(unseen) if sum(counts.values()) <= NAMED else unseen, by, "left_semi").select(*_KEY, *sums)
        self.sums = _kept(self.files.select(*_KEY).distinct().join(known, _KEY).unionByName(new), "file-sums")

    def shared(self, name: str, side: str, other: str) -> list[str]:
        """Files of a side's table that the other side's has as well; none if there are too many to name."""
        schema, table = split_name(name)
        rows = self.uses.where((F.col("schema") == schema) & (F.col("table") == table)).join(self.files, "source")
        both = rows.groupBy(*_KEY).agg(F.max(F.col("side") == side).alias("a"), F.max(F.col("side") == other).alias("b")).where("a and b")
        found = both.select("file").limit(NAMED + 1).collect()
        return [r.file for r in found] if len(found) <= NAMED else []

    def fingerprints(self, side: str) -> DataFrame:
        """DF[schema, table, row_count, checksum] of a side's tables, from the sums alone."""
        rows = self.uses.where(F.col("side") == side).join(self.files, "source", "left").join(self.sums, _KEY, "left")
        added = rows.groupBy("schema", "table").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("row_count", *_LIMBS)])
        return added.select("schema", "table", "row_count", checksum_from_limbs(*[F.col(n) for n in _LIMBS]).alias("checksum"))
