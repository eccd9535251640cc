"""Schema snapshots of a namespace: tables, columns, indexes and constraints as DataFrames.

A snapshot is metadata only (one row per table, column, index or constraint); it is built
from each DataFrame's schema and the declared table specs, never from a scan of the rows.
The JSON form nests columns under their table, like the registry stores it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import split_name
from .spec import TableSpec, constraint_rows, index_rows

# Schemas that listings leave out unless told otherwise: catalogs of the system.
HIDDEN_SCHEMAS = ("pg_catalog", "information_schema")

TABLES_SCHEMA = "schema string, name string"
COLUMNS_SCHEMA = ("schema string, table string, name string, data_type string, is_nullable boolean, "
                  "column_default string, ordinal_position int")
INDEXES_SCHEMA = "schema string, table string, name string, definition string, is_unique boolean, is_primary boolean"
CONSTRAINTS_SCHEMA = "schema string, table string, name string, type string, definition string"

COLUMN_STRUCT = ("struct<name:string,data_type:string,is_nullable:boolean,column_default:string,"
                 "ordinal_position:int>")
TABLE_STRUCT = f"struct<schema:string,name:string,columns:array<{COLUMN_STRUCT}>>"
INDEX_STRUCT = ("struct<schema:string,table:string,name:string,definition:string,is_unique:boolean,"
                "is_primary:boolean>")
CONSTRAINT_STRUCT = "struct<schema:string,table:string,name:string,type:string,definition:string>"

FINGERPRINT_SCHEMA = "schema string, table string, row_count long, checksum string"
FINGERPRINT_STRUCT = "struct<schema:string,table:string,row_count:bigint,checksum:string>"

SNAPSHOT_JSON_SCHEMA = (f"tables array<{TABLE_STRUCT}>, indexes array<{INDEX_STRUCT}>, "
                        f"constraints array<{CONSTRAINT_STRUCT}>, fingerprints array<{FINGERPRINT_STRUCT}>")


@dataclass
class Snapshot:
    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    constraints: DataFrame
    fingerprints: DataFrame | None = None  # of the tables' rows at that moment, where they were taken


def take_snapshot(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None = None,
                  spark: SparkSession | None = None, hidden: Iterable[str] = HIDDEN_SCHEMAS) -> Snapshot:
    """Snapshot of a namespace ``{name: DataFrame}`` with optional ``{name: TableSpec}``.

    Tables of ``hidden`` schemas are left out. Rows come in no order; ``ordered_snapshot`` sorts for display.
    """
    hidden = set(hidden)
    specs = specs or {}
    spark = spark or (next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession())
    t_rows, c_rows, i_rows, k_rows = [], [], [], []
    for name, df in tables.items():
        schema, table = split_name(name)
        if schema in hidden:
            continue
        spec = specs.get(name) or specs.get(f"{schema}.{table}") or specs.get(table) or TableSpec()
        t_rows.append((schema, table))
        for pos, f in enumerate(df.schema.fields, start=1):
            # Nullability is declared (Parquet and Spark's inference do not keep it stable).
            c_rows.append((schema, table, f.name, f.dataType.simpleString(), spec.is_nullable(f.name),
                           spec.defaults.get(f.name), pos))
        i_rows.extend(index_rows(schema, table, spec))
        k_rows.extend(constraint_rows(schema, table, spec))
    return Snapshot(
        local_frame(spark, t_rows, TABLES_SCHEMA), local_frame(spark, c_rows, COLUMNS_SCHEMA),
        local_frame(spark, i_rows, INDEXES_SCHEMA), local_frame(spark, k_rows, CONSTRAINTS_SCHEMA),
    )


def ordered_snapshot(snap: Snapshot) -> Snapshot:
    """The snapshot in display order."""
    return Snapshot(snap.tables.orderBy("schema", "name"), snap.columns.orderBy("schema", "table", "ordinal_position"),
                    snap.indexes.orderBy("schema", "table", "name"), snap.constraints.orderBy("schema", "table", "name"),
                    snap.fingerprints.orderBy("schema", "table") if snap.fingerprints is not None else None)


def to_json(snap: Snapshot) -> DataFrame:
    """One-row DataFrame ``snapshot_data`` holding the whole snapshot as JSON."""
    cols = snap.columns.groupBy("schema", "table").agg(
        F.sort_array(F.collect_list(F.struct("ordinal_position", "name", "data_type", "is_nullable",
                                             "column_default"))).alias("cs"))
    cols = cols.select("schema", "table", F.transform("cs", lambda c: F.struct(
        c["name"].alias("name"), c["data_type"].alias("data_type"), c["is_nullable"].alias("is_nullable"),
        c["column_default"].alias("column_default"), c["ordinal_position"].alias("ordinal_position"))).alias("columns"))
    t = (snap.tables.join(cols, (snap.tables["schema"] == cols["schema"]) & (snap.tables["name"] == cols["table"]),
                          "left")
         .select(snap.tables["schema"], snap.tables["name"],
                  F.coalesce(cols["columns"], F.array().cast(f"array<{COLUMN_STRUCT}>")).alias("columns")))
    # One aggregate over a tagged union (no join of the three lists is needed).
    t_s = F.struct("schema", "name", "columns")
    i_s = F.struct(*snap.indexes.columns)
    k_s = F.struct(*snap.constraints.columns)
    f_s = F.struct("schema", "table", "row_count", "checksum")
    kinds = {"t": TABLE_STRUCT, "i": INDEX_STRUCT, "k": CONSTRAINT_STRUCT, "f": FINGERPRINT_STRUCT}
    lists = [(t, "t", t_s), (snap.indexes, "i", i_s), (snap.constraints, "k", k_s)]
    if snap.fingerprints is not None:
        lists.append((snap.fingerprints, "f", f_s))
    u = reduce(DataFrame.unionByName, [df.select(*[(s if k == own else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])
                                       for df, own, s in lists])
    agg = u.agg(F.sort_array(F.collect_list("t")).alias("tables"),
                F.sort_array(F.collect_list("i")).alias("indexes"),
                F.sort_array(F.collect_list("k")).alias("constraints"),
                F.sort_array(F.collect_list("f")).alias("fingerprints"))
    parts = ["tables", "indexes", "constraints", *(["fingerprints"] if snap.fingerprints is not None else [])]
    return agg.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("snapshot_data"))


def from_json(json_df: DataFrame, column: str = "snapshot_data") -> Snapshot:
    """Inverse of :func:`to_json` over a one-row DataFrame (e.g. a registry row)."""
    p = json_df.select(F.from_json(F.col(column), SNAPSHOT_JSON_SCHEMA).alias("s"))
    tables = p.select(F.explode("s.tables").alias("t"))
    cols = (tables.select(F.col("t.schema").alias("schema"), F.col("t.name").alias("table"),
                          F.explode("t.columns").alias("c"))
            .select("schema", "table", "c.name", "c.data_type", "c.is_nullable", "c.column_default",
                    "c.ordinal_position"))
    known = p.where("s.fingerprints is not null").limit(1).count() > 0  # a snapshot may have none
    return Snapshot(
        tables.select("t.schema", "t.name"),
        cols,
        p.select(F.explode("s.indexes").alias("i")).select("i.*"),
        p.select(F.explode("s.constraints").alias("k")).select("k.*"),
        p.select(F.explode("s.fingerprints").alias("f")).select("f.*") if known else None,
    )
