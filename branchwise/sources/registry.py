"""Branch registry: one row per branch with its branch-point snapshot, and branch creation.

The registry is a small DataFrame ``[name, db_name, parent_db, created_at, snapshot_data]``;
persist it wherever the main namespace lives, as a fresh version folder, never over the folder being read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import split_name
from .namespace import copy_namespace
from .snapshot import FINGERPRINT_SCHEMA, Snapshot, from_json, take_snapshot, to_json
from .spec import TableSpec

REGISTRY_SCHEMA = "name string, db_name string, parent_db string, created_at timestamp, snapshot_data string"


def empty_registry(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], REGISTRY_SCHEMA)


def register_branch(registry: DataFrame, name: str, db_name: str, parent_db: str, snapshot: Snapshot,
                    created_at=None) -> DataFrame:
    """Registry with one more row; the name must be new."""
    if registry.filter(F.col("name") == name).limit(1).count() > 0:
        raise ValueError(f"branch {name!r} already exists")
    row = to_json(snapshot).select(
        F.lit(name).alias("name"), F.lit(db_name).alias("db_name"), F.lit(parent_db).alias("parent_db"),
        (F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")).alias("created_at"),
        "snapshot_data")
    return registry.unionByName(row)


def list_branches(registry: DataFrame, current: str | None = None) -> DataFrame:
    """DF[name, db_name, parent_db, created_at, is_current] ordered by creation."""
    cur = F.lit(current).cast("string")
    return registry.select("name", "db_name", "parent_db", "created_at",
                           F.coalesce(F.col("name") == cur, F.lit(False)).alias("is_current")).orderBy("created_at",
                                                                                                     "name")


def list_lines(registry: DataFrame, main_db: str, current: str | None = None) -> list[str]:
    """The ``list`` report: main first, ``*`` marks the current one (collects the registry)."""
    lines = [f"  {'*' if not current else ' '} main ({main_db})"]
    for r in list_branches(registry, current).collect():
        mark = "*" if r.is_current else " "
        lines.append(f"  {mark} {r.name} ({r.db_name}) [from {r.parent_db}, {r.created_at:%Y-%m-%d %H:%M}]")
    return lines


def load_snapshot(registry: DataFrame, name: str) -> Snapshot:
    """Branch-point snapshot of ``name``; a missing branch is an error."""
    row = registry.filter(F.col("name") == name).select("snapshot_data")
    if row.limit(1).count() == 0:
        raise KeyError(f"no snapshot for branch {name!r}")
    return from_json(row)


def create_branch(registry: DataFrame, name: str, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec],
                  root: str, parent_db: str = "main", created_at=None) -> tuple[DataFrame, DataFrame]:
    """Deep-copy a namespace to ``root`` as branch ``name``.

    Returns (registry with the new row, copy proof DF[table, row_count, checksum, copied_ok]).
    Raises before anything is written if the name is taken, and after the copy if any table's
    proof fails (the registry row is added last, so a failed copy is never listed).
    """
    if registry.filter(F.col("name") == name).limit(1).count() > 0:
        raise ValueError(f"branch {name!r} already exists")
    proof = copy_namespace(tables, root, specs=specs)
    rows = proof.collect()  # one row per table
    bad = [r.table for r in rows if not r.copied_ok]
    if bad:
        raise RuntimeError(f"copy of {bad} does not match its source")
    proof = local_frame(proof.sparkSession, [tuple(r) for r in rows], proof.schema)
    snap = take_snapshot(tables, specs)
    # the copy was proved equal to its source, so these are the branch point's rows
    snap.fingerprints = local_frame(proof.sparkSession, [(*split_name(r.table), r.row_count, r.checksum) for r in rows], FINGERPRINT_SCHEMA)
    return register_branch(registry, name, root, parent_db, snap, created_at), proof
