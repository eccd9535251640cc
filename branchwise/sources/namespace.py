"""Namespaces of tables on storage: load, write, deep copy with proof.

A namespace written by this library is a folder with one Parquet folder per table and a
``_manifest`` (JSON lines: table, paths, schema, declared keys and constraints) written last. The manifest is the commit
point: readers load only what it lists, so a half-written folder is never read as a
namespace. A manifest entry may list several folders (for example main's unchanged files
plus the rows a merge appended), which lets a merge avoid rewriting what it did not change.

Beside it ``_sums`` holds the fingerprint sums of the data files that are known (``operators.filesums``), so the next
fingerprint, diff or merge reads only files that came since.

Tables that the library did not write are named by their paths, in any file format that Spark reads, or come from a
database of the session catalog.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.local import local_frame
from ..functions.names import qualify
from ..functions.rowtext import row_hash
from ..operators.filesums import SUMS_SCHEMA, FileSums, read_files
from ..operators.fingerprint import limb_columns
from .spec import TableSpec

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "table string, paths array<string>, schema string, spec string, format string, sums string"
SUMS = "_sums"


@dataclass
class Namespace:
    tables: dict[str, DataFrame]
    paths: dict[str, list[str]] = field(default_factory=dict)
    specs: dict[str, TableSpec] = field(default_factory=dict)
    root: str | None = None
    formats: dict[str, str] = field(default_factory=dict)  # of tables that aren't Parquet
    sums: DataFrame | None = None  # stored sums of data files

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: Mapping[str, str | list[str]],
                   specs: Mapping[str, TableSpec] | None = None, formats: Mapping[str, str] | str = "parquet",
                   schemas: Mapping[str, T.StructType] | None = None) -> "Namespace":
        """Tables by their paths; ``formats`` is one format, or one for each table that isn't Parquet. Formats without a schema of their
        own (csv, json) should be given one in ``schemas``.
        """
        tables, ps, fmts = {}, {}, {}
        for name, p in paths.items():
            lst, full = [p] if isinstance(p, str) else list(p), qualify(name)
            fmt = formats if isinstance(formats, str) else formats.get(name, formats.get(full, "parquet"))
            schema = (schemas or {}).get(name, (schemas or {}).get(full))
            reader = spark.read.format(fmt)
            tables[full] = (reader.schema(schema) if schema is not None else reader).load(lst)
            ps[full] = lst
            if fmt != "parquet":
                fmts[full] = fmt
        return cls(tables, ps, {qualify(k): v for k, v in (specs or {}).items()}, formats=fmts)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, specs: Mapping[str, TableSpec] | None = None) -> "Namespace":
        """The tables (no views) of a database of the session catalog, named ``database.table``.

        A file table's folder is known, so a merge can refer to its files. A database without tables is an empty namespace; one
        that does not exist is an error.
        """
        tables, paths, fmts = {}, {}, {}
        for t in spark.catalog.listTables(database):  # one entry per table
            if t.isTemporary or t.tableType == "VIEW":
                continue
            name = f"{database}.{t.name}"
            tables[name] = spark.table(f"`{database}`.`{t.name}`")
            told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{t.name}`").collect()}
            partitioned = any(c.isPartition for c in spark.catalog.listColumns(f"`{database}`.`{t.name}`"))
            if told.get("Location") and told.get("Provider") and not partitioned:
                paths[name] = [told["Location"]]
                if told["Provider"].lower() != "parquet":
                    fmts[name] = told["Provider"].lower()
        return cls(tables, paths, {qualify(k): v for k, v in (specs or {}).items()}, formats=fmts)

    def scans(self, names=None) -> dict[str, tuple]:
        """(paths, schema, format) of the tables whose files are known."""
        return {n: (p, self.tables[n].schema, self.formats.get(n, "parquet")) for n, p in self.paths.items()
                if n in self.tables and (names is None or n in names)}

    @classmethod
    def load(cls, spark: SparkSession, root: str, specs: Mapping[str, TableSpec] | None = None) -> "Namespace":
        """Tables and specs listed in ``root/_manifest``; raises if there is none (not committed).

        ``specs`` overrides what the manifest says of the tables it names.
        """
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}").collect()  # one row per table
        if not rows:
            raise FileNotFoundError(f"no committed namespace at {root}")
        tables, ps, known, fmts, sums = {}, {}, {}, {}, None
        for r in rows:
            known[r.table] = TableSpec.from_json(r.spec)
            schema = T.StructType.fromJson(json.loads(r.schema))
            tables[r.table] = read_files(spark, r.paths, schema, r.format or "parquet")
            ps[r.table] = list(r.paths)
            if r.format and r.format != "parquet":
                fmts[r.table] = r.format
            sums = r.sums or sums
        known.update({qualify(k): v for k, v in (specs or {}).items()})
        return cls(tables, ps, known, root, fmts, spark.read.schema(SUMS_SCHEMA).parquet(sums) if sums else None)


def table_dir(root: str, name: str) -> str:
    return f"{root}/{qualify(name)}"


def write_table(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    w = df.write.mode("errorifexists")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)


def write_manifest(spark: SparkSession, root: str, entries: Mapping[str, tuple[list[str], T.StructType]],
                   specs: Mapping[str, TableSpec] | None = None, formats: Mapping[str, str] | None = None,
                   sums: DataFrame | None = None) -> None:
    """Commit a namespace: one JSON line per table, in one file. Written last, after the ``sums`` of its files."""
    specs = {qualify(k): v for k, v in (specs or {}).items()}
    kept = f"{root}/{SUMS}" if sums is not None else None
    if sums is not None:
        sums.write.mode("errorifexists").parquet(kept)
    rows = [(t, list(p), s.json(), specs.get(qualify(t), TableSpec()).to_json(), (formats or {}).get(t), kept)
            for t, (p, s) in sorted(entries.items())]
    local_frame(spark, rows, MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").json(f"{root}/{MANIFEST}")


def _checksum_py(row_count, s0, s1, s2, s3) -> str:
    import hashlib
    total = (s3 or 0) * (1 << 48) + (s2 or 0) * (1 << 32) + (s1 or 0) * (1 << 16) + (s0 or 0)
    return hashlib.md5(str(total).encode()).hexdigest()


def copy_namespace(tables: Mapping[str, DataFrame], root: str, max_records_per_file: int | None = None,
                   parallelism: int = 4, specs: Mapping[str, TableSpec] | None = None) -> DataFrame:
    """Deep copy every table to ``root``, with its declared keys and constraints, and prove it: DF[table, row_count, checksum, copied_ok].

    The source fingerprint is gathered while writing (an observation on the write job, no extra
    scan); the copy is then fingerprinted from storage, file by file, and the two are compared. The files' sums stay with the
    copy, so nothing reads it again to tell what a branch has changed since.
    """
    spark = next(iter(tables.values())).sparkSession
    source, entries = {}, {}

    def copy_one(name):
        df = tables[name]
        obs = Observation(f"copy_{qualify(name)}")
        limbs = limb_columns(F.col("__h"))
        observed = df.withColumn("__h", row_hash(df)).observe(
            obs, F.count(F.lit(1)).alias("row_count"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(limbs)])
        path = table_dir(root, name)
        write_table(observed.drop("__h"), path, max_records_per_file)
        m = list(obs.get.values())
        return name, path, m

    # Independent tables are written by concurrent jobs; each job is distributed on its own.
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for name, path, m in pool.map(copy_one, sorted(tables)):
            source[qualify(name)] = (m[0], _checksum_py(*m))
            entries[qualify(name)] = ([path], tables[name].schema)
    files = FileSums(spark, {"copy": {t: (p, s, "parquet") for t, (p, s) in entries.items()}})
    write_manifest(spark, root, entries, specs, sums=files.sums)
    fp = files.fingerprints("copy").select(F.concat_ws(".", "schema", "table").alias("table"), "row_count", "checksum")
    src = local_frame(spark, [(t, c, s) for t, (c, s) in source.items()],
                      "table string, src_rows long, src_checksum string")
    return fp.join(src, "table", "full_outer").select(
        "table", "row_count", "checksum",
        F.coalesce((F.col("row_count") == F.col("src_rows")) & (F.col("checksum") == F.col("src_checksum")),
                   F.lit(False)).alias("copied_ok"))

