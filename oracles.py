"""DuckDB SQL builders for the oracle side of ``__spark_entry__.oracle_sql``.

The row text follows the rule of ``branchwise.functions.rowtext``, written for DuckDB and without the
package, so the oracle and Spark fingerprints can be compared digest for digest.
"""

from __future__ import annotations

# Column names and types of the driver's test tables (in table order).
TESTDATA_SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

_SPECIAL = r'["\\(), \t\n\r\f\x0B]'


def duck_quote(x: str) -> str:
    return (f"CASE WHEN {x} = '' OR regexp_matches({x}, '{_SPECIAL}') "
            f"THEN '\"' || regexp_replace({x}, '([\"\\\\])', '\\1\\1', 'g') || '\"' ELSE {x} END")


def duck_value(c: str, t: str) -> str:
    if t == "string":
        return c
    if t in ("int", "bigint", "smallint", "tinyint", "date") or t.startswith("decimal"):
        return f"CAST({c} AS VARCHAR)"
    if t in ("double", "float"):
        # from the number's own bits (the test tables hold no subnormal numbers)
        bits = f"CAST(CAST(CAST({c} AS DOUBLE) AS BIT) AS BIGINT)"
        return (f"CASE WHEN isnan({c}) THEN 'NaN' WHEN isinf({c}) THEN CASE WHEN {c} > 0 THEN 'Infinity' ELSE '-Infinity' END "
                f"ELSE CASE WHEN {bits} < 0 THEN '-' ELSE '' END || CASE WHEN {c} = 0 THEN '0x0.0p0' ELSE '0x1.' || "
                f"coalesce(nullif(rtrim(lpad(lower(to_hex({bits} & {2**52 - 1})), 13, '0'), '0'), ''), '0') || 'p' || "
                f"CAST((({bits} >> 52) & 2047) - 1023 AS VARCHAR) END END")
    if t == "boolean":
        return f"CASE WHEN {c} THEN 't' WHEN NOT {c} THEN 'f' END"
    if t == "timestamp":
        return f"CAST(epoch_us({c}) AS VARCHAR)"
    if t == "timestamp_ntz":
        return f"CAST({c} AS VARCHAR)"
    if t.startswith("array<") and t.endswith(">"):
        et = t[len("array<"):-1]
        return (f"'[' || array_to_string(list_transform({c}, lambda x: coalesce({duck_value('x', et)}, 'NULL')), ',')"
                f" || ']'")
    raise ValueError(t)


def duck_field(c: str, t: str) -> str:
    v = duck_value(c, t)
    if t == "string":
        q = duck_quote(c)
    elif t == "timestamp_ntz":
        q = f"'\"' || {v} || '\"'"
    elif t.startswith("array<"):
        q = f"CASE WHEN len({c}) > 1 THEN '\"' || {v} || '\"' ELSE {v} END"
    else:
        q = v
    return f"coalesce({q}, '')"


def duck_row_text(cols: list[tuple[str, str]]) -> str:
    return "'(' || " + " || ',' || ".join(duck_field(c, t) for c, t in cols) + " || ')'"


def duck_row_hash(cols: list[tuple[str, str]]) -> str:
    u = f"CAST(CAST('0x' || substr(md5({duck_row_text(cols)}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)"


def duck_fingerprint(source: str, cols: list[tuple[str, str]]) -> str:
    """SELECT row_count, checksum over ``source`` (a table name or a parenthesised query)."""
    return (f"SELECT count(*) AS row_count, md5(CAST(coalesce(sum(h), 0) AS VARCHAR)) AS checksum "
            f"FROM (SELECT {duck_row_hash(cols)} AS h FROM {source} AS t) AS x")


# ---------------------------------------------------------------------------------------------
# Expected rows of the schema side of the scenario, written by hand.

#: object_kind, object_name, change_type, change_rank, detail, base_value, new_value, parent, and what became of it in the merge
#: plan: ok, same (on both sides), ddl (part of a new table), drop (goes with its table), or main's conflicting change.
CHANGES = [
    ("table", "public.embeddings", "removed", 0, "table public.embeddings removed",
     "vec_id bigint NOT NULL, embedding array<float>, label int", None, "public.embeddings", "same"),
    ("table", "public.labels", "added", 0, "table public.labels added (3 columns)", None,
     "doc_id bigint NOT NULL, quality int, toxic int", "public.labels", "ok"),
    ("table", "public.pages", "removed", 0, "table public.pages removed",
     "page_id bigint NOT NULL, url string, html string", None, "public.pages", "ok"),
    ("column", "public.customer.c_mktsegment", "removed", 0, "column public.customer.c_mktsegment removed", "string", None,
     "public.customer", "ok"),
    ("column", "public.events.event_type", "modified", 2, "column public.events.event_type default changed", None, "'click'",
     "public.events", "ok"),
    ("column", "public.orders.o_channel", "added", 0, "column public.orders.o_channel added (string)", None,
     "string DEFAULT 'web'", "public.orders", "column public.orders.o_channel added (int)"),
    ("column", "public.part.p_name", "modified", 1, "column public.part.p_name nullable changed: true -> false", "true",
     "false", "public.part", "ok"),
    ("column", "public.supplier.s_nationkey", "modified", 0, "column public.supplier.s_nationkey type changed: int -> bigint",
     "int", "bigint", "public.supplier", "same"),
    ("index", "public.embeddings_pkey", "removed", 0, "index public.embeddings_pkey removed",
     "CREATE UNIQUE INDEX embeddings_pkey ON public.embeddings USING btree (vec_id)", None, "public.embeddings", "same"),
    ("index", "public.idx_events_user", "modified", 0, "index public.idx_events_user definition changed",
     "CREATE INDEX idx_events_user ON public.events USING btree (user_id)",
     "CREATE INDEX idx_events_user ON public.events USING btree (user_id, ts)", "public.events", "index public.idx_events_user removed"),
    ("index", "public.idx_orders_cust", "added", 0, "index public.idx_orders_cust added", None,
     "CREATE INDEX idx_orders_cust ON public.orders USING btree (o_custkey)", "public.orders", "ok"),
    ("index", "public.labels_pkey", "added", 0, "index public.labels_pkey added", None,
     "CREATE UNIQUE INDEX labels_pkey ON public.labels USING btree (doc_id)", "public.labels", "ddl"),
    ("index", "public.pages_pkey", "removed", 0, "index public.pages_pkey removed",
     "CREATE UNIQUE INDEX pages_pkey ON public.pages USING btree (page_id)", None, "public.pages", "drop"),
    ("constraint", "public.customer_nation_fkey", "added", 0, "constraint public.customer_nation_fkey added (FOREIGN KEY)", None,
     "FOREIGN KEY (c_nationkey) REFERENCES nation(n_nationkey)", "public.customer", "ok"),
    ("constraint", "public.embeddings_pkey", "removed", 0, "constraint public.embeddings_pkey removed", "PRIMARY KEY (vec_id)", None,
     "public.embeddings", "same"),
    ("constraint", "public.labels_pkey", "added", 0, "constraint public.labels_pkey added (PRIMARY KEY)", None, "PRIMARY KEY (doc_id)",
     "public.labels", "ddl"),
    ("constraint", "public.orders_price_check", "added", 0, "constraint public.orders_price_check added (CHECK)", None,
     "CHECK ((o_totalprice > 0))", "public.orders", "same"),
    ("constraint", "public.pages_pkey", "removed", 0, "constraint public.pages_pkey removed", "PRIMARY KEY (page_id)", None,
     "public.pages", "drop"),
]
_SUFFIX = {"same": ("skipped", " (same on both sides)"), "ddl": ("skipped", " (included in table DDL)"),
           "drop": ("skipped", " (included in table removal)"), "ok": ("ok", "")}


def planned(resolve: str | None) -> list[tuple]:
    """kind, name, change_type, change_rank, detail, parent, new_value, description, status, main_side of each change."""
    out = []
    for kind, name, change, rank, detail, _, new, parent, fate in CHANGES:
        status, suffix = _SUFFIX.get(fate, (None, None))
        description = f"{detail}{suffix}"
        if status is None:
            status, description = {None: ("conflict", detail), "branch": ("ok", f"{detail} (branch wins)"),
                                   "main": ("skipped", f"{fate} (main wins, skipping branch change)")}[resolve]
        out.append((kind, name, change, rank, detail, parent, new, description, status, fate))
    return out


def lit(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({columns})"
