"""Typed schema evolution of a table (add, drop, cast columns; nullability and defaults).

Column changes are column expressions on the DataFrame (no rows leave the executors). A
cast runs under ANSI rules, so a value that cannot be converted fails the job instead of
turning into NULL. Nullability and defaults live in the table spec; NOT NULL is enforced by
the constraint checks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.spec import TableSpec

ACTIONS = ("add_column", "drop_column", "cast_column", "set_nullable", "set_default")


@dataclass
class ColumnOp:
    action: str
    column: str
    data_type: str | None = None   # add_column, cast_column
    default: str | None = None     # add_column, set_default (SQL expression text; None = no default)
    nullable: bool | None = None   # add_column, set_nullable

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def evolve(df: DataFrame, ops: list[ColumnOp]) -> DataFrame:
    """Apply column ops in order. Adding a column that exists replaces its type (cast)."""
    for op in ops:
        if op.action == "add_column":
            dt = T._parse_datatype_string(op.data_type)
            if op.column in df.columns:
                df = df.withColumn(op.column, F.col(_q(op.column)).cast(dt))
            elif op.default is not None:
                df = df.withColumn(op.column, F.expr(op.default).cast(dt))
            else:
                df = df.withColumn(op.column, F.lit(None).cast(dt))
        elif op.action == "drop_column":
            df = df.drop(op.column)
        elif op.action == "cast_column":
            df = df.withColumn(op.column, F.col(_q(op.column)).cast(T._parse_datatype_string(op.data_type)))
    return df


def _drop_constraints(s: TableSpec, column: str) -> None:
    """Remove the keys, constraints and indexes that need ``column``."""
    if column in s.primary_key:
        s.primary_key = []
    named = re.compile(rf"(?<![\w`]){re.escape(column)}(?!\w)|`{re.escape(column)}`")
    s.unique = {n: cols for n, cols in s.unique.items() if column not in cols}
    s.foreign_keys = {n: fk for n, fk in s.foreign_keys.items() if column not in fk.columns}
    s.checks = {n: p for n, p in s.checks.items() if not named.search(re.sub(r"'[^']*'", "''", p))}
    s.indexes = {n: i for n, i in s.indexes.items() if column not in i.columns}


def evolve_spec(spec: TableSpec, ops: list[ColumnOp]) -> TableSpec:
    """The table spec after the same ops."""
    s = spec.copy()
    for op in ops:
        c = op.column
        if op.action == "add_column":
            if op.default is not None:
                s.defaults[c] = op.default
            if op.nullable is False and c not in s.not_null:
                s.not_null.append(c)
        elif op.action == "drop_column":
            s.defaults.pop(c, None)
            s.not_null = [x for x in s.not_null if x != c]
            _drop_constraints(s, c)
        elif op.action == "set_nullable":
            if op.nullable:
                s.not_null = [x for x in s.not_null if x != c]
            elif c not in s.not_null:
                s.not_null.append(c)
        elif op.action == "set_default":
            if op.default is None:
                s.defaults.pop(c, None)
            else:
                s.defaults[c] = op.default
    return s
