"""Branch scenario built from the driver's test tables.

Three namespaces derived row by row from the whole test tables: ``base`` (the branch point),
``main`` and ``branch``. Each side keeps a different slice of ``orders``, ``lineitem``,
``conversations`` and ``benchmark`` and edits some statuses, which gives every merge case a
real input: new keyed rows (single and composite key), rows edited on one side, a keyless
table that differs, a table new on the branch (``labels``), a table removed on the branch
(``pages``), one removed on both sides (``embeddings``), one removed on main only (``documents``),
a table emptied on the branch (``region``), a bookkeeping table
(``benchmark``) and unchanged tables. The filters pick which rows each side holds; they do
not thin the work, every table is read whole.

Derivations are written as SQL expression text so Spark (``F.expr``) and the DuckDB oracle
(``SELECT * REPLACE``) apply literally the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Declared keys (Parquet stores none). lineitem has no key: it is the SYNC case.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

#: Columns by which ``fingerprint_by_file`` splits a table's rows into two commits.
BY_FILE_KEY = {"orders": "o_custkey", "lineitem": "l_partkey", "conversations": "conv_id"}

# side -> table -> None (absent) or (row filter, {column: replacement expression})
VARIANTS: dict[str, dict[str, tuple[str | None, dict[str, str]] | None]] = {
    "base": {
        "orders": ("o_orderkey % 10 NOT IN (3, 7)", {}),
        "lineitem": ("l_orderkey % 10 NOT IN (3, 7)", {}),
        "conversations": ("(conv_id + turn) % 5 NOT IN (1, 2)", {}),
        "benchmark": ("item_id % 4 <> 0", {}),
        "labels": None,
    },
    "main": {
        "orders": ("o_orderkey % 10 <> 3",
                   {"o_orderstatus": "CASE WHEN o_orderkey % 97 = 0 THEN 'M' ELSE o_orderstatus END"}),
        "lineitem": ("l_orderkey % 10 <> 3", {}),
        "conversations": ("(conv_id + turn) % 5 <> 1", {}),
        "benchmark": ("item_id % 4 <> 0", {}),
        "labels": None,
        "documents": None,
        "embeddings": None,
    },
    "branch": {
        "orders": ("o_orderkey % 10 <> 7",
                   {"o_orderstatus": "CASE WHEN o_orderkey % 89 = 0 THEN 'B' ELSE o_orderstatus END"}),
        "lineitem": ("l_orderkey % 10 <> 7", {}),
        "conversations": ("(conv_id + turn) % 5 <> 2", {}),
        "region": ("r_regionkey < 0", {}),
        "pages": None,
        "embeddings": None,
    },
}


_SCHEMAS: dict[str, object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a test table; its schema is looked up once per process (no footer job per read)."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def derive(df: DataFrame, rule: tuple[str | None, dict[str, str]]) -> DataFrame:
    where, repl = rule
    if where:
        df = df.filter(F.expr(where))
    if repl:
        df = df.withColumns({c: F.expr(e) for c, e in repl.items()})
    return df


def side_table(spark: SparkSession, sf_dir: str, side: str, name: str) -> DataFrame | None:
    rules = VARIANTS[side]
    if name in rules and rules[name] is None:
        return None
    df = read_table(spark, sf_dir, name)
    return derive(df, rules[name]) if name in rules else df


def namespace(spark: SparkSession, sf_dir: str, side: str) -> dict[str, DataFrame]:
    """``{'public.<table>': DataFrame}`` for one side of the scenario."""
    out = {}
    for t in TABLES:
        df = side_table(spark, sf_dir, side, t)
        if df is not None:
            out[f"public.{t}"] = df
    return out


def side_sql(side: str, name: str) -> str | None:
    """DuckDB text of the same table (a parenthesised query, or the view name)."""
    rules = VARIANTS[side]
    if name in rules and rules[name] is None:
        return None
    if name not in rules:
        return name
    where, repl = rules[name]
    sel = "*" if not repl else "* REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in repl.items()) + ")"
    return f"(SELECT {sel} FROM {name}" + (f" WHERE {where}" if where else "") + ")"


def side_tables(side: str) -> list[str]:
    return [t for t in TABLES if side_sql(side, t) is not None]


# ---------------------------------------------------------------------------------------------
# Schema side of the scenario: declared specs per side and typed column edits.

from branchwise.operators.evolve import ColumnOp, evolve, evolve_spec  # noqa: E402
from branchwise.sources.namespace import Namespace, table_dir, write_manifest, write_table  # noqa: E402
from branchwise.sources.spec import ForeignKey, Index, TableSpec  # noqa: E402


def base_specs() -> dict[str, TableSpec]:
    specs = {f"public.{t}": TableSpec(primary_key=list(k)) for t, k in KEYS.items()}
    specs["public.lineitem"] = TableSpec()
    specs["public.orders"].foreign_keys["orders_custkey_fkey"] = ForeignKey(["o_custkey"], "customer", ["c_custkey"])
    specs["public.events"].indexes["idx_events_user"] = Index(["user_id"])
    return specs


# side -> table -> column edits (applied to the side's DataFrame and spec)
COLUMN_EDITS: dict[str, dict[str, list[ColumnOp]]] = {
    "main": {
        "public.orders": [ColumnOp("add_column", "o_channel", "int")],
        "public.supplier": [ColumnOp("cast_column", "s_nationkey", "bigint")],
        "public.part": [ColumnOp("add_column", "p_note", "string")],
    },
    "branch": {
        "public.orders": [ColumnOp("add_column", "o_channel", "string", "'web'")],
        "public.supplier": [ColumnOp("cast_column", "s_nationkey", "bigint")],
        "public.customer": [ColumnOp("drop_column", "c_mktsegment")],
        "public.part": [ColumnOp("set_nullable", "p_name", nullable=False)],
        "public.events": [ColumnOp("set_default", "event_type", default="'click'")],
    },
}


def side_specs(side: str) -> dict[str, TableSpec]:
    specs = base_specs()
    if side == "base":
        return {t: s for t, s in specs.items() if t != "public.labels"}
    for t, ops in COLUMN_EDITS[side].items():
        specs[t] = evolve_spec(specs[t], ops)
    specs["public.orders"].checks["orders_price_check"] = "o_totalprice > 0"
    if side == "main":
        specs["public.lineitem"].indexes["idx_lineitem_ship"] = Index(["l_shipdate"])
        specs["public.events"].indexes.pop("idx_events_user")
    else:
        specs["public.orders"].indexes["idx_orders_cust"] = Index(["o_custkey"])
        specs["public.events"].indexes["idx_events_user"] = Index(["user_id", "ts"])
        specs["public.customer"].foreign_keys["customer_nation_fkey"] = ForeignKey(
            ["c_nationkey"], "nation", ["n_nationkey"])
    return {t: s for t, s in specs.items() if VARIANTS[side].get(t.split(".", 1)[1], ()) is not None}


def evolved_namespace(spark: SparkSession, sf_dir: str, side: str) -> dict[str, DataFrame]:
    """The side's rows (``namespace``) with the side's column edits applied."""
    ns = namespace(spark, sf_dir, side)
    for t, ops in COLUMN_EDITS.get(side, {}).items():
        if t in ns:
            ns[t] = evolve(ns[t], ops)
    return ns


#: A change log of the ``events`` table, one entry per event, and the points at which branches were taken; both in Spark and DuckDB text.
LOG_COLUMNS = {
    "branch": "concat('b', CAST(user_id % 7 AS {string}))", "id": "event_id", "event_time": "ts", "command_tag": "upper(event_type)",
    "object_type": "'table'", "schema_name": "'shop'", "object_identity": "concat('shop.', event_type, '.u', CAST(user_id AS {string}))",
    "command": "concat('ALTER TABLE shop.', event_type, '_', CAST(user_id % 40 AS {string}), ' SET props = ', coalesce(props, ''))",
}
LOG_OBJECTS = "concat('shop.', event_type, '_', CAST(user_id AS {string}))"


def log_sql(kind: str) -> str:
    """``SELECT`` of the log from ``events``; kind is the dialect's name for text."""
    return "SELECT " + ", ".join(f"{e.format(string=kind)} AS {c}" for c, e in LOG_COLUMNS.items()) + " FROM events"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*[f"{e.format(string='STRING')} AS {c}" for c, e in LOG_COLUMNS.items()])


def commit_side(spark: SparkSession, sf_dir: str, side: str, root: str) -> Namespace:
    """One side as a committed namespace: what it edits is written, the other tables refer to the given files."""
    entries = {}
    for name, df in evolved_namespace(spark, sf_dir, side).items():
        t = name.split(".", 1)[1]
        if t in VARIANTS[side] or name in COLUMN_EDITS.get(side, {}):
            write_table(df, table_dir(root, name))
            entries[name] = ([table_dir(root, name)], df.schema)
        else:
            entries[name] = ([f"{sf_dir}/{t}.parquet"], df.schema)
    write_manifest(spark, root, entries, side_specs(side))
    return Namespace.load(spark, root)
