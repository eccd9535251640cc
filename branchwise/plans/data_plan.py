"""Data merge plan from the fingerprints of both sides.

For every branch table (main-only tables are left alone):

* on main with the same digest -> nothing to do;
* on main with another digest -> ``INSERT_PK`` when the table has a key (branch rows whose key
  main lacks get appended), else ``SYNC`` (reported, not applied);
* not on main and not empty -> the same two choices for a new table (INSERT_PK against an
  empty key set), if it was not there at the branch point either;
* at the branch point and gone from main -> main dropped a table whose rows the branch still has: a conflict, or
  with ``resolve='main'`` skipped, or with ``resolve='branch'`` a new table again.

With the branch point's fingerprints the plan is three-way: a table whose rows on the branch are those of the branch point was
changed by main alone, or by nobody, and is neither an operation nor a conflict, even if main dropped it; ``changed_by``
tells of the others whether main changed them as well.

With ``only_meta`` (no data merge) only bookkeeping tables are planned. The bookkeeping list
is built from the defaults, a replacement list and extras; a bare name matches the table in
any schema, a dotted name matches ``schema.table``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.names import split_name

# Migration-bookkeeping tables merged even when data merge is off.
DEFAULT_META_TABLES = ["sequelize_meta", "schema_migrations", "goose_db_version", "flyway_schema_history",
                       "knex_migrations"]

KEY_SCHEMA = "schema string, table string, pk_columns array<string>"


def resolved_meta_tables(meta_tables: Iterable[str] | None = None, meta_extra: Iterable[str] = ()) -> list[str]:
    """``None`` keeps the defaults, an empty list disables them; extras are added; blanks ignored."""
    base = DEFAULT_META_TABLES if meta_tables is None else list(meta_tables)
    out = []
    for n in list(base) + list(meta_extra):
        if n and n not in out:
            out.append(n)
    return out


def is_meta_table(schema: Column, table: Column, meta: list[str]) -> Column:
    if not meta:
        return F.lit(False)
    return table.isin(meta) | F.concat_ws(".", schema, table).isin(meta)


def key_frame(spark: SparkSession, keys: Mapping[str, list[str]]) -> DataFrame:
    """DF[schema, table, pk_columns] from ``{name: [key columns in key order]}``."""
    rows = [(*split_name(n), list(cols)) for n, cols in keys.items() if cols]
    return local_frame(spark, rows, KEY_SCHEMA)


def plan_data(main_fp: DataFrame, branch_fp: DataFrame, main_keys: DataFrame, branch_keys: DataFrame,
              meta: list[str] | None = None, only_meta: bool = False, base_tables: DataFrame | None = None,
              resolve: str | None = None, base_fp: DataFrame | None = None) -> DataFrame:
    """``base_tables`` (schema, name) are those of the branch point; without it no table counts as dropped. ``base_fp`` are its
    fingerprints.

    DF[table, schema, table_name, operation, row_key, status, pk_columns, branch_rows, main_rows, new_table, changed_by];
    changed_by is ``branch`` or ``both``, null without ``base_fp`` and for tables that the branch point did not have."""
    meta = resolved_meta_tables() if meta is None else meta
    b = branch_fp
    if only_meta:
        b = b.filter(is_meta_table(F.col("schema"), F.col("table"), meta))
    m = main_fp.select("schema", "table", F.col("row_count").alias("main_rows"), F.col("checksum").alias("m_sum"))
    j = b.select("schema", "table", F.col("row_count").alias("branch_rows"), F.col("checksum").alias("b_sum")) \
        .join(m, ["schema", "table"], "left")
    new_table = F.col("m_sum").isNull()
    j = j.filter((new_table & (F.col("branch_rows") > 0)) | (~new_table & (F.col("b_sum") != F.col("m_sum"))))
    if base_fp is None:
        j = j.withColumn("changed_by", F.lit(None).cast("string"))
    else:
        j = j.join(base_fp.select("schema", "table", F.col("checksum").alias("_o_sum")), ["schema", "table"], "left")
        j = j.filter(F.col("_o_sum").isNull() | (F.col("b_sum") != F.col("_o_sum")))
        j = j.withColumn("changed_by", F.when(F.col("_o_sum").isNull(), None).when(F.col("m_sum").eqNullSafe(F.col("_o_sum")), "branch")
                         .otherwise("both"))
    mk = main_keys.select("schema", "table", F.col("pk_columns").alias("m_pk"))
    bk = branch_keys.select("schema", "table", F.col("pk_columns").alias("b_pk"))
    j = j.join(mk, ["schema", "table"], "left").join(bk, ["schema", "table"], "left")
    pk = F.when(new_table, F.col("b_pk")).otherwise(F.col("m_pk"))
    has_key = pk.isNotNull() & (F.size(pk) > 0)
    if base_tables is None:
        j = j.withColumn("_was", F.lit(False))
    else:
        was = base_tables.select("schema", F.col("name").alias("table"), F.lit(True).alias("_was"))
        j = j.join(was, ["schema", "table"], "left")
    dropped = new_table & F.coalesce("_was", F.lit(False))
    base_key = F.when(dropped, F.concat(F.format_string("%d row(s) (dropped on main)", "branch_rows"), F.lit(
        {"branch": " (branch wins)", "main": " (main wins)"}.get(resolve, "")))) \
        .when(new_table, F.format_string("%d row(s) (new table)", "branch_rows")) \
        .otherwise(F.format_string("%d rows (branch) vs %d rows (main)", "branch_rows", "main_rows"))
    return j.select(
        F.concat_ws(".", "schema", "table").alias("table"), "schema", F.col("table").alias("table_name"),
        F.when(has_key, F.lit("INSERT_PK")).otherwise(F.lit("SYNC")).alias("operation"),
        F.when(has_key, base_key).otherwise(F.concat(base_key, F.lit(" (no primary key)"))).alias("row_key"),
        F.when(dropped, F.lit({"branch": "ok", "main": "skipped"}.get(resolve, "conflict"))).otherwise("ok").alias("status"),
        F.when(has_key, pk).otherwise(F.array().cast("array<string>")).alias("pk_columns"),
        "branch_rows", F.coalesce("main_rows", F.lit(0).cast("long")).alias("main_rows"),
        new_table.alias("new_table"), "changed_by")
