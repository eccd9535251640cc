"""Three-way schema merge plan: classify each branch change against main's changes.

Per branch change (both sides diffed against the branch point):

* main did not touch the object -> ``ok``; an index or constraint of a table the branch adds
  is ``skipped`` "(included in table DDL)";
* main made exactly the same set of changes to the object (values included) -> ``skipped``
  "(same on both sides)";
* it removes an index or constraint of a table that the branch removes -> ``skipped`` "(included in table
  removal)": the table's own removal decides;
* otherwise a conflict, or with ``resolve='branch'`` ``ok`` "(branch wins)", with
  ``resolve='main'`` ``skipped`` "(main wins, skipping branch change)".

Objects are keyed by (kind, name), and a change to a column, index or constraint conflicts with
the removal of its table on the other side (and the other way round), unless the child goes because
its side removed the table; a table that both sides remove is the same change on both sides.
Everything is a join of small change DataFrames; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESOLVE_MODES = (None, "branch", "main")


def merge_rank(kind):
    return (F.when(kind == "table", F.lit(0)).when(kind == "column", F.lit(1)).otherwise(F.lit(2)))


def _object_sets(changes: DataFrame, p: str) -> DataFrame:
    return changes.groupBy("object_kind", "object_name").agg(
        F.sort_array(F.collect_list(F.struct("change_rank", "change_type", "detail", "base_value", "new_value")))
        .alias(p + "set"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change_rank", "detail"))),
                                 lambda x: x["detail"]), "; ").alias(p + "details"))


def plan_schema(main_changes: DataFrame, branch_changes: DataFrame, resolve: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schema_ops, conflicts)."""
    ops = plan_schema_with_sides(main_changes, branch_changes, resolve)
    return ops.drop("main_side"), schema_conflicts(ops)


def plan_schema_with_sides(main_changes: DataFrame, branch_changes: DataFrame, resolve: str | None = None) -> DataFrame:
    """schema_ops with main_side, what main did to the object.

    schema_ops: merge_rank, object_kind, object_name, change_type, change_rank, detail, description,
    status (ok | skipped | conflict), base_value, new_value, parent.
    conflicts: type, object_name, branch_side, main_side.
    """
    if resolve not in RESOLVE_MODES:
        raise ValueError(f"resolve must be one of {RESOLVE_MODES}, got {resolve!r}")
    key = ["object_kind", "object_name"]
    m_sets = _object_sets(main_changes, "m_")
    b_sets = _object_sets(branch_changes, "b_").select(*key, "b_set")

    # Removal of a table on one side against changes to its children on the other.
    m_removed_tables = main_changes.filter((F.col("object_kind") == "table") & (F.col("change_type") == "removed")) \
        .select(F.col("object_name").alias("parent"), F.col("detail").alias("m_parent_removed"))
    # What main removed with a whole table is no change to the table's children.
    m_child_changes = main_changes.filter(F.col("object_kind") != "table").join(
        m_removed_tables.select("parent"), "parent", "left_anti").groupBy("parent").agg(
        F.min("detail").alias("m_child_change"))
    b_removed_tables = branch_changes.filter((F.col("object_kind") == "table") & (F.col("change_type") == "removed")) \
        .select(F.col("object_name").alias("parent"), F.lit(True).alias("parent_removed"))
    b_added_tables = branch_changes.filter((F.col("object_kind") == "table") & (F.col("change_type") == "added")) \
        .select(F.col("object_name").alias("parent"), F.lit(True).alias("parent_added"))

    j = (branch_changes.join(m_sets, key, "left").join(b_sets, key, "left")
         .join(m_removed_tables, "parent", "left")
         .join(m_child_changes.withColumnRenamed("parent", "object_name"), "object_name", "left")
         .join(b_added_tables, "parent", "left").join(b_removed_tables, "parent", "left"))

    is_table = F.col("object_kind") == "table"
    # Objects with the same changes on both sides agree, whatever became of their table.
    same = F.col("m_set").isNotNull() & (F.col("m_set") == F.col("b_set"))
    goes_with_table = ((~is_table) & (F.col("change_type") == "removed")
                       & F.coalesce(F.col("parent_removed"), F.lit(False)))
    child_vs_removed_parent = (~is_table) & F.col("m_parent_removed").isNotNull()
    removed_vs_child = is_table & (F.col("change_type") == "removed") & F.col("m_child_change").isNotNull()
    main_changed = F.col("m_set").isNotNull() | child_vs_removed_parent | removed_vs_child
    main_side = F.coalesce(F.col("m_details"),
                           F.when(child_vs_removed_parent, F.col("m_parent_removed")),
                           F.when(removed_vs_child, F.col("m_child_change")))
    implied = (F.col("object_kind").isin("index", "constraint") & (F.col("change_type") == "added")
               & F.coalesce(F.col("parent_added"), F.lit(False)))

    d = F.col("detail")
    if resolve == "branch":
        conflict_status, conflict_desc = F.lit("ok"), F.concat(d, F.lit(" (branch wins)"))
    elif resolve == "main":
        conflict_status = F.lit("skipped")
        conflict_desc = F.concat(main_side, F.lit(" (main wins, skipping branch change)"))
    else:
        conflict_status, conflict_desc = F.lit("conflict"), d

    status = (F.when(same | goes_with_table, F.lit("skipped")).when(~main_changed & implied, F.lit("skipped"))
              .when(~main_changed, F.lit("ok")).otherwise(conflict_status))
    description = (F.when(same, F.concat(d, F.lit(" (same on both sides)")))
                   .when(goes_with_table, F.concat(d, F.lit(" (included in table removal)")))
                   .when(~main_changed & implied, F.concat(d, F.lit(" (included in table DDL)")))
                   .when(~main_changed, d).otherwise(conflict_desc))
    is_conflict = main_changed & ~same & ~goes_with_table

    return j.select(merge_rank(F.col("object_kind")).alias("merge_rank"), "object_kind", "object_name",
                   "change_type", "change_rank", "detail", description.alias("description"),
                   status.alias("status"), "base_value", "new_value", "parent",
                   is_conflict.alias("is_conflict"), main_side.alias("main_side"))


def schema_conflicts(ops: DataFrame) -> DataFrame:
    return ops.filter(F.col("status") == "conflict").select(
        F.lit("schema").alias("type"), "object_name", F.col("detail").alias("branch_side"), "main_side")


def ordered_ops(ops: DataFrame) -> DataFrame:
    """Processing order: tables, then columns, then indexes and constraints."""
    return ops.orderBy("merge_rank", "object_name", "change_rank", "detail")
