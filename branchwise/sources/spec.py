"""Declared table specs: the keys, defaults and constraints Parquet does not store."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field


@dataclass
class ForeignKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str]


@dataclass
class Index:
    columns: list[str]
    unique: bool = False


@dataclass
class TableSpec:
    """Keys and constraints of one table. Everything is optional; an empty spec is a keyless table."""

    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)      # column -> SQL expression text
    unique: dict[str, list[str]] = field(default_factory=dict)  # constraint name -> columns
    foreign_keys: dict[str, ForeignKey] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)        # constraint name -> SQL predicate
    indexes: dict[str, Index] = field(default_factory=dict)     # plain (non-constraint) indexes

    def copy(self) -> "TableSpec":
        return copy.deepcopy(self)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> "TableSpec":
        if not text:
            return cls()
        d = json.loads(text)
        d["foreign_keys"] = {n: ForeignKey(**v) for n, v in d.get("foreign_keys", {}).items()}
        d["indexes"] = {n: Index(**v) for n, v in d.get("indexes", {}).items()}
        return cls(**d)

    def is_nullable(self, column: str) -> bool:
        return column not in self.not_null and column not in self.primary_key


def pkey_name(table: str) -> str:
    return f"{table}_pkey"


def constraint_rows(schema: str, table: str, spec: TableSpec) -> list[tuple]:
    """(schema, table, name, type, definition) for every declared constraint."""
    rows = []
    if spec.primary_key:
        rows.append((schema, table, pkey_name(table), "PRIMARY KEY",
                     f"PRIMARY KEY ({', '.join(spec.primary_key)})"))
    for name, cols in spec.unique.items():
        rows.append((schema, table, name, "UNIQUE", f"UNIQUE ({', '.join(cols)})"))
    for name, fk in spec.foreign_keys.items():
        rows.append((schema, table, name, "FOREIGN KEY",
                     f"FOREIGN KEY ({', '.join(fk.columns)}) REFERENCES {fk.ref_table}({', '.join(fk.ref_columns)})"))
    for name, pred in spec.checks.items():
        rows.append((schema, table, name, "CHECK", f"CHECK (({pred}))"))
    return rows


def index_rows(schema: str, table: str, spec: TableSpec) -> list[tuple]:
    """(schema, table, name, definition, is_unique, is_primary); keys and UNIQUE carry an index."""

    def definition(name, cols, unique):
        kind = "UNIQUE INDEX" if unique else "INDEX"
        return f"CREATE {kind} {name} ON {schema}.{table} USING btree ({', '.join(cols)})"

    rows = []
    if spec.primary_key:
        n = pkey_name(table)
        rows.append((schema, table, n, definition(n, spec.primary_key, True), True, True))
    for name, cols in spec.unique.items():
        rows.append((schema, table, name, definition(name, cols, True), True, False))
    for name, idx in spec.indexes.items():
        rows.append((schema, table, name, definition(name, idx.columns, idx.unique), idx.unique, False))
    return rows
