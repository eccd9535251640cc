"""Schema diff of two snapshots: tables, columns, indexes and constraints.

Each kind is a full outer join of the two snapshot DataFrames on the object key. Every change
carries, besides its report text (``detail``), the values on both sides (``base_value``,
``new_value``), so two different edits with the same report text are never taken as equal.
Output columns::

    change_type  added | removed | modified
    object_kind  table | column | index | constraint
    object_name  schema.table | schema.table.column | schema.name
    detail       report text
    base_value, new_value
    parent       owning table (schema.table) of a column, index or constraint; the table itself
    group_rank   0 tables and columns, 1 indexes, 2 constraints (report order)
    change_rank  type 0 < nullable 1 < default 2 for one column; 0 otherwise
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import Snapshot

CHANGE_COLUMNS = ["change_type", "object_kind", "object_name", "detail", "base_value", "new_value", "parent",
                  "group_rank", "change_rank"]

_CHANGE_STRUCT = ("struct<change_type:string,detail:string,base_value:string,new_value:string,"
                  "change_rank:int>")


def _change(change_type: str, detail: Column, base_value: Column, new_value: Column, rank: int = 0) -> Column:
    return F.struct(F.lit(change_type).alias("change_type"), detail.alias("detail"),
                    base_value.cast("string").alias("base_value"), new_value.cast("string").alias("new_value"),
                    F.lit(rank).alias("change_rank"))


def column_desc(p: str = "") -> Column:
    """``type [NOT NULL] [DEFAULT x]`` of a column row (prefix ``p`` for aliased frames)."""
    return F.concat_ws(" ", F.col(p + "data_type"),
                       F.when(~F.col(p + "is_nullable"), F.lit("NOT NULL")),
                       F.when(F.col(p + "column_default").isNotNull(),
                              F.concat(F.lit("DEFAULT "), F.col(p + "column_default"))))


def _table_signatures(columns: DataFrame) -> DataFrame:
    """Per table: column count and a text of all column definitions in order."""
    g = columns.groupBy("schema", "table").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.sort_array(F.collect_list(F.struct("ordinal_position", F.concat_ws(" ", "name", column_desc())
                                             .alias("d")))).alias("defs"))
    return g.select("schema", "table", "n_columns",
                    F.array_join(F.transform("defs", lambda x: x["d"]), ", ").alias("signature"))


def diff_tables(base: Snapshot, cur: Snapshot) -> DataFrame:
    b = base.tables.select("schema", "name", F.lit(True).alias("_in_b"))
    c = cur.tables.select("schema", "name", F.lit(True).alias("_in_c"))
    sig = _table_signatures(cur.columns).withColumnRenamed("table", "name")
    bsig = _table_signatures(base.columns).withColumnRenamed("table", "name").select(
        "schema", "name", F.col("signature").alias("_bsig"))
    j = b.join(c, ["schema", "name"], "full_outer").filter(F.col("_in_b").isNull() | F.col("_in_c").isNull())
    j = j.join(sig, ["schema", "name"], "left").join(bsig, ["schema", "name"], "left")
    obj = F.concat_ws(".", "schema", "name")
    added = F.col("_in_b").isNull()
    return j.select(
        F.when(added, F.lit("added")).otherwise(F.lit("removed")).alias("change_type"),
        F.lit("table").alias("object_kind"),
        obj.alias("object_name"),
        F.when(added, F.format_string("table %s added (%d columns)", obj, F.coalesce("n_columns", F.lit(0))))
        .otherwise(F.format_string("table %s removed", obj)).alias("detail"),
        F.when(~added, F.col("_bsig")).alias("base_value"),
        F.when(added, F.col("signature")).alias("new_value"),
        obj.alias("parent"), F.lit(0).alias("group_rank"), F.lit(0).alias("change_rank"))


def diff_columns(base: Snapshot, cur: Snapshot) -> DataFrame:
    both = base.tables.join(cur.tables, ["schema", "name"], "inner").select("schema", F.col("name").alias("table"))
    bc = base.columns.join(both, ["schema", "table"], "left_semi")
    cc = cur.columns.join(both, ["schema", "table"], "left_semi")
    bcols = [F.col(x).alias("b_" + x) for x in ("data_type", "is_nullable", "column_default")]
    ccols = [F.col(x).alias("c_" + x) for x in ("data_type", "is_nullable", "column_default")]
    j = bc.select("schema", "table", "name", F.lit(True).alias("_in_b"), *bcols).join(
        cc.select("schema", "table", "name", F.lit(True).alias("_in_c"), *ccols),
        ["schema", "table", "name"], "full_outer")
    obj = F.concat_ws(".", "schema", "table", "name")
    bt, ct = F.col("b_data_type"), F.col("c_data_type")
    bn, cn = F.col("b_is_nullable"), F.col("c_is_nullable")
    bd, cd = F.coalesce("b_column_default", F.lit("")), F.coalesce("c_column_default", F.lit(""))
    changes = F.array(
        F.when(F.col("_in_b").isNull(), _change(
            "added", F.format_string("column %s added (%s)", obj, ct), F.lit(None), column_desc("c_"))),
        F.when(F.col("_in_c").isNull(), _change(
            "removed", F.format_string("column %s removed", obj), column_desc("b_"), F.lit(None))),
        F.when(F.col("_in_b") & F.col("_in_c") & (bt != ct), _change(
            "modified", F.format_string("column %s type changed: %s -> %s", obj, bt, ct), bt, ct, 0)),
        F.when(F.col("_in_b") & F.col("_in_c") & (bn != cn), _change(
            "modified", F.format_string("column %s nullable changed: %s -> %s", obj, bn.cast("string"),
                                        cn.cast("string")), bn, cn, 1)),
        F.when(F.col("_in_b") & F.col("_in_c") & (bd != cd), _change(
            "modified", F.format_string("column %s default changed", obj), F.col("b_column_default"),
            F.col("c_column_default"), 2)),
    )
    e = j.select(obj.alias("object_name"), F.concat_ws(".", "schema", "table").alias("parent"),
                 F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("ch"))
    return e.select(F.col("ch.change_type").alias("change_type"), F.lit("column").alias("object_kind"),
                    "object_name", F.col("ch.detail").alias("detail"), F.col("ch.base_value").alias("base_value"),
                    F.col("ch.new_value").alias("new_value"), "parent", F.lit(0).alias("group_rank"),
                    F.col("ch.change_rank").alias("change_rank"))


def _definition_diff(b: DataFrame, c: DataFrame, keys: list[str], kind: str, group_rank: int,
                     added_suffix=None) -> DataFrame:
    bs = b.select(*keys, F.col("table").alias("_b_table"), F.col("definition").alias("_b_def"),
                  *([F.col("type").alias("_b_type")] if "type" in b.columns else []))
    cs = c.select(*keys, F.col("table").alias("_c_table"), F.col("definition").alias("_c_def"),
                  *([F.col("type").alias("_c_type")] if "type" in c.columns else []))
    j = bs.join(cs, keys, "full_outer")
    j = j.filter(F.col("_b_def").isNull() | F.col("_c_def").isNull() | (F.col("_b_def") != F.col("_c_def")))
    obj = F.concat_ws(".", "schema", "name")
    added, removed = F.col("_b_def").isNull(), F.col("_c_def").isNull()
    added_text = (F.format_string(f"{kind} %s added (%s)", obj, F.col("_c_type")) if added_suffix
                  else F.format_string(f"{kind} %s added", obj))
    return j.select(
        F.when(added, F.lit("added")).when(removed, F.lit("removed")).otherwise(F.lit("modified")).alias("change_type"),
        F.lit(kind).alias("object_kind"), obj.alias("object_name"),
        F.when(added, added_text).when(removed, F.format_string(f"{kind} %s removed", obj))
        .otherwise(F.format_string(f"{kind} %s definition changed", obj)).alias("detail"),
        F.col("_b_def").alias("base_value"), F.col("_c_def").alias("new_value"),
        F.concat_ws(".", "schema", F.coalesce("_c_table", "_b_table")).alias("parent"),
        F.lit(group_rank).alias("group_rank"), F.lit(0).alias("change_rank"))


def diff_indexes(base: Snapshot, cur: Snapshot) -> DataFrame:
    return _definition_diff(base.indexes, cur.indexes, ["schema", "name"], "index", 1)


def diff_constraints(base: Snapshot, cur: Snapshot) -> DataFrame:
    # Keyed by table as well: equal constraint names on two tables of one schema stay apart.
    return _definition_diff(base.constraints, cur.constraints, ["schema", "table", "name"], "constraint", 2,
                            added_suffix=True)


def schema_diff(base: Snapshot, cur: Snapshot) -> DataFrame:
    """All schema changes from ``base`` to ``cur`` (see module doc for columns)."""
    return (diff_tables(base, cur).unionByName(diff_columns(base, cur))
            .unionByName(diff_indexes(base, cur)).unionByName(diff_constraints(base, cur))).coalesce(1)


def ordered(changes: DataFrame) -> DataFrame:
    """Report order: tables and columns by name, then indexes, then constraints."""
    return changes.orderBy("group_rank", "object_name", "change_rank", "detail")


def change_symbol(change_type: Column) -> Column:
    return (F.when(change_type == "added", F.lit("+")).when(change_type == "removed", F.lit("-"))
            .when(change_type == "modified", F.lit("~")).otherwise(F.lit(" ")))


def format_changes(changes: DataFrame) -> str:
    """Report text; collects the (small) list of changes."""
    rows = ordered(changes).select(change_symbol(F.col("change_type")).alias("s"), "detail").collect()
    if not rows:
        return "No schema changes."
    return f"Schema changes ({len(rows)}):\n" + "".join(f"  {r.s} {r.detail}\n" for r in rows)
