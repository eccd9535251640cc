"""

Every query reads the driver's test tables whole (or data Spark derives from them through the
branch scenario in ``scenario.py``). Column names are the same on both sides.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles as O  # noqa: E402
import scenario as S  # noqa: E402
from branchwise.functions.local import local_frame  # noqa: E402
from branchwise.functions.names import qualify, split_name  # noqa: E402
from branchwise.operators import buckets, clustered  # noqa: E402
from branchwise.operators.changelog import log_as_of, newest_change  # noqa: E402
from branchwise.operators.checks import check_constraints  # noqa: E402
from branchwise.operators.datadiff import compare_data, data_change_lines, divergent_tables  # noqa: E402
from branchwise.operators.evolve import ColumnOp, evolve  # noqa: E402
from branchwise.operators.filesums import FileSums  # noqa: E402
from branchwise.operators.fingerprint import fingerprint, fingerprint_all  # noqa: E402
from branchwise.operators.impact import profile, with_impact  # noqa: E402
from branchwise.operators.rows import inserted_counts, merge_rows, new_rows  # noqa: E402
from branchwise.operators.schemadiff import schema_diff  # noqa: E402
from branchwise.plans.data_plan import key_frame, plan_data  # noqa: E402
from branchwise.plans.early import first_difference  # noqa: E402
from branchwise.plans.levels import apply_levels  # noqa: E402
from branchwise.plans.merge import diff_branch, merge  # noqa: E402
from branchwise.plans.schema_plan import plan_schema  # noqa: E402
from branchwise.session import ensure_checkpoint_dir, scratch_path  # noqa: E402
from branchwise.sources.namespace import Namespace, copy_namespace  # noqa: E402
from branchwise.sources.snapshot import take_snapshot  # noqa: E402
from branchwise.sources.spec import ForeignKey, TableSpec  # noqa: E402
from branchwise.streaming.logtail import read_newest, tail_newest  # noqa: E402

# The training-data operators are an optional subpackage; if it is there, what it fails to import is an error.
if find_spec("branchwise.llm") and find_spec("corpus_pipeline"):
    from branchwise.llm import queries as llm_queries
else:
    llm_queries = None

FLAGSHIP_SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------------------------------
# helpers shared by the queries

def _ns(spark, sf, side):
    return S.namespace(spark, sf, side)


def _fp_side(spark, sf, side):
    return fingerprint_all(_ns(spark, sf, side))


def _keys(side):
    return {n: s.primary_key for n, s in S.side_specs(side).items()}


def _snap(spark, sf, side):
    return take_snapshot(S.evolved_namespace(spark, sf, side), S.side_specs(side), spark)


def _changes(spark, sf, side):
    return schema_diff(_snap(spark, sf, "base"), _snap(spark, sf, side))


def _plan(spark, sf, resolve):
    """Plan and conflicts, with what they mean for main's rows."""
    ops, conflicts = plan_schema(_changes(spark, sf, "main"), _changes(spark, sf, "branch"), resolve)
    ops = with_impact(ops, S.evolved_namespace(spark, sf, "main"))
    return ops.select("object_kind", "object_name", "change_type", "detail", "description", "status", "parent",
                      "rows_affected", "rows_failing"), conflicts


def _data_plan(spark, sf, only_meta=False, meta=None):
    mk = key_frame(spark, _keys("main"))
    bk = key_frame(spark, _keys("branch"))
    m, b = _ns(spark, sf, "main"), _ns(spark, sf, "branch")
    only = [n for n in b if n.split(".", 1)[1] in (meta or [])] if only_meta else None
    # With data merge off only bookkeeping tables are fingerprinted; nothing else is read.
    p = plan_data(fingerprint_all(m, only), fingerprint_all(b, only), mk, bk, meta, only_meta,
                  _snap(spark, sf, "base").tables)
    return p.select("table", "operation", "row_key", "status",
                    F.array_join("pk_columns", ",").alias("key_columns"), "branch_rows", "main_rows", "new_table")


def _side(spark, sf, side, t):
    return S.side_table(spark, sf, side, t)


# ---------------------------------------------------------------------------------------------
# queries

def q_fingerprint(table):
    return lambda spark, sf: fingerprint(S.read_table(spark, sf, table))


def q_fingerprint_all_tables(spark, sf):
    return fingerprint_all(_all_tables(spark, sf))


def q_fingerprint_empty(spark, sf):
    return fingerprint(S.read_table(spark, sf, "region").filter("r_regionkey < 0"))


def q_compare_tables(spark, sf):
    return compare_data(_fp_side(spark, sf, "main"), _fp_side(spark, sf, "branch"))


def q_divergent_tables(spark, sf):
    return divergent_tables(_fp_side(spark, sf, "main"), _fp_side(spark, sf, "branch"))


def q_data_change_lines(spark, sf):
    return data_change_lines(q_compare_tables(spark, sf))


def q_new_rows_orders(spark, sf):
    return new_rows(_side(spark, sf, "branch", "orders"), _side(spark, sf, "main", "orders"), ["o_orderkey"])


def q_new_rows_conversations(spark, sf):
    return new_rows(_side(spark, sf, "branch", "conversations"), _side(spark, sf, "main", "conversations"),
                    ["conv_id", "turn"])


def q_merged_orders(spark, sf):
    return merge_rows(_side(spark, sf, "main", "orders"), _side(spark, sf, "branch", "orders"), ["o_orderkey"])


def q_merged_new_table_labels(spark, sf):
    # main holds a third of the rows, with another quality; the rest is new
    b = _side(spark, sf, "branch", "labels")
    main = b.filter("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))
    return merge_rows(main, b, ["doc_id"])


def q_inserted_counts(spark, sf):
    m, b = _ns(spark, sf, "main"), _ns(spark, sf, "branch")
    pairs = {}
    for t in ("orders", "conversations", "benchmark", "region", "labels"):
        n = qualify(t)
        main_t = m.get(n, b[n].filter(F.lit(False)))
        pairs[n] = (b[n], main_t, S.KEYS[t])
    return inserted_counts(pairs)


def q_data_merge_plan(spark, sf):
    return _data_plan(spark, sf)


def q_data_merge_plan_no_data(spark, sf):
    return _data_plan(spark, sf, only_meta=True, meta=["benchmark"])


def _all_tables(spark, sf):
    return {qualify(t): S.read_table(spark, sf, t) for t in S.TABLES}


def q_table_list(spark, sf):
    """Tables of the snapshot with their rows."""
    tables = _all_tables(spark, sf)
    rows = profile(tables).groupBy("table").agg(F.max("row_count").alias("row_count"))
    listed = take_snapshot(tables, S.base_specs(), spark).tables
    return listed.join(rows, F.concat_ws(".", "schema", "name") == F.col("table")).select("schema", "name", "row_count")


def q_column_snapshot(spark, sf):
    """Columns of the snapshot with their rows and NULLs."""
    tables = _all_tables(spark, sf)
    listed = take_snapshot(tables, S.base_specs(), spark).columns.withColumnRenamed("table", "t")
    p = profile(tables)
    return listed.join(p, (F.concat_ws(".", "schema", "t") == F.col("table")) & (F.col("name") == F.col("column"))).select(
        "schema", F.col("t").alias("table"), "name", "data_type", "is_nullable", "ordinal_position", "row_count", "null_count")


def _diff_kind(kind):
    def q(spark, sf):
        changes = _changes(spark, sf, "branch").filter(F.col("object_kind") == kind).drop("group_rank")
        return with_impact(changes, S.evolved_namespace(spark, sf, "base"))
    return q


def q_schema_plan(resolve):
    return lambda spark, sf: _plan(spark, sf, resolve)[0]


def q_schema_conflicts(spark, sf):
    plan, conflicts = _plan(spark, sf, None)
    rows = plan.select("object_name", "rows_affected").distinct()
    return conflicts.join(rows, "object_name")


def q_implied_children_skipped(spark, sf):
    return _plan(spark, sf, None)[0].filter(F.col("description").contains(" (included in table "))


def q_diff_branch(spark, sf):
    """The diff report's data side, once on all columns and once on those that both sides have."""
    base = _snap(spark, sf, "base")
    main, branch = S.evolved_namespace(spark, sf, "main"), S.evolved_namespace(spark, sf, "branch")
    whole = diff_branch(base, main, branch, S.side_specs("branch"))[1]
    shared = diff_branch(base, main, branch, S.side_specs("branch"), common_columns=True)[1]
    return whole.join(shared.select("schema", "table", F.col("has_change").alias("common_change")), ["schema", "table"])


def q_evolve_add_column(spark, sf):
    return evolve(S.read_table(spark, sf, "orders"), [ColumnOp("add_column", "o_channel", "string", "'web'")])


def q_evolve_cast_column(spark, sf):
    return evolve(S.read_table(spark, sf, "lineitem"), [ColumnOp("cast_column", "l_linenumber", "bigint"),
                                                      ColumnOp("cast_column", "l_quantity", "decimal(12,2)")])


def q_evolve_drop_column(spark, sf):
    return evolve(S.read_table(spark, sf, "customer"), [ColumnOp("drop_column", "c_mktsegment")])


def q_check_pk_lineitem(spark, sf):
    return check_constraints({"lineitem": S.read_table(spark, sf, "lineitem")},
                             {"lineitem": TableSpec(primary_key=["l_orderkey", "l_linenumber"])})


def q_check_fk_orders(spark, sf):
    cust = S.read_table(spark, sf, "customer").filter("c_custkey % 50 <> 0")
    tables = {"customer": cust, "orders": S.read_table(spark, sf, "orders")}
    specs = {"orders": TableSpec(foreign_keys={"orders_custkey_fkey": ForeignKey(["o_custkey"], "customer",
                                                                                 ["c_custkey"])})}
    return check_constraints(tables, specs)


def q_check_not_null(spark, sf):
    ev = S.read_table(spark, sf, "events").withColumn(
        "props", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("props")))
    return check_constraints({"events": ev}, {"events": TableSpec(not_null=["props", "event_type", "ts"])})


def q_check_predicate(spark, sf):
    return check_constraints({"lineitem": S.read_table(spark, sf, "lineitem")}, {"lineitem": TableSpec(checks={
        "lineitem_discount_check": "l_discount <= 0.05", "lineitem_quantity_check": "l_quantity > 0",
        "lineitem_ship_check": "l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'"})})


def q_check_unique(spark, sf):
    return check_constraints({"events": S.read_table(spark, sf, "events")},
                             {"events": TableSpec(unique={"events_user_type_key": ["user_id", "event_type"]})})


def q_check_fk_composite(spark, sf):
    turns = S.read_table(spark, sf, "conversations")
    answers = turns.filter("turn > 0").withColumn("before", F.col("turn") - 1)
    questions = turns.filter("role <> 'system'")
    spec = TableSpec(foreign_keys={"answers_turn_fkey": ForeignKey(["conv_id", "before"], "questions", ["conv_id", "turn"])})
    return check_constraints({"answers": answers, "questions": questions}, {"answers": spec})


def q_check_fk_self_append(spark, sf):
    """New rows of a table that refers to itself, against all of its rows."""
    every = S.read_table(spark, sf, "conversations").withColumn("before", F.when(F.col("turn") > 0, F.col("turn") - 1))
    kept = every.filter("(conv_id + turn) % 5 <> 1")
    spec = TableSpec(foreign_keys={"turns_before_fkey": ForeignKey(["conv_id", "before"], "turns", ["conv_id", "turn"])})
    return check_constraints({"turns": kept.filter("turn > 1")}, {"turns": spec}, parents={"public.turns": kept})


def q_branch_copy_proof(spark, sf):
    return copy_namespace(_all_tables(spark, sf), scratch_path(spark, "copy"), specs=S.base_specs())


def _merged(spark, sf):
    """The scenario's branch merged into its main, both committed namespaces; the branch wins conflicts."""
    root = scratch_path(spark, "merge")
    main, branch = (S.commit_side(spark, sf, side, f"{root}/{side}") for side in ("main", "branch"))
    merge(_snap(spark, sf, "base"), main, branch, target=f"{root}/merged", resolve="branch")
    return Namespace.load(spark, f"{root}/merged")


def q_fingerprint_by_file(spark, sf):
    """Fingerprints of main's edited tables after an append: the files of the first commit are known and aren't read again."""
    root, names = scratch_path(spark, "by-file"), ("orders", "lineitem", "conversations")
    paths, halves = {}, ("{0} % 3 = 0", "{0} % 3 <> 0")
    for t in names:
        df, key = _side(spark, sf, "main", t), S.BY_FILE_KEY[t]
        paths[qualify(t)] = [f"{root}/{t}-{k}" for k in range(2)]
        for path, rows in zip(paths[qualify(t)], halves):
            df.filter(rows.format(key)).write.parquet(path)
    first = Namespace.from_paths(spark, {t: p[:1] for t, p in paths.items()})
    known = FileSums(spark, {"main": first.scans()})
    now = Namespace.from_paths(spark, paths)
    return FileSums(spark, {"main": now.scans()}, known.sums).fingerprints("main")


def q_new_rows_localised(spark, sf):
    """New orders and turns, each joined only in the key buckets that differ."""
    o = buckets.new_rows(_side(spark, sf, "branch", "orders"), _side(spark, sf, "main", "orders"), ["o_orderkey"])
    c = buckets.new_rows(_side(spark, sf, "branch", "conversations"), _side(spark, sf, "main", "conversations"), ["conv_id", "turn"])
    none = F.lit(None).cast("long")
    return o.select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("a"), none.alias("b"), F.col("o_orderstatus").alias("v")).unionByName(
        c.select(F.lit("conversations").alias("t"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.col("text").alias("v")))


def q_row_changes_orders(spark, sf):
    return buckets.row_changes(_side(spark, sf, "base", "orders"), _side(spark, sf, "branch", "orders"), ["o_orderkey"])


def _three_way_sides(spark, sf):
    """The scenario's sides; on main alone nation has lost rows as well."""
    sides = {side: _ns(spark, sf, side) for side in ("base", "main", "branch")}
    sides["main"]["public.nation"] = sides["main"]["public.nation"].filter("n_nationkey % 5 <> 2")
    return sides


def q_data_merge_plan_three_way(spark, sf):
    fp = {side: fingerprint_all(tables) for side, tables in _three_way_sides(spark, sf).items()}
    p = plan_data(fp["main"], fp["branch"], key_frame(spark, _keys("main")), key_frame(spark, _keys("branch")),
                  base_tables=_snap(spark, sf, "base").tables, base_fp=fp["base"])
    return p.select("table", "operation", "row_key", "status", "branch_rows", "main_rows", "new_table", "changed_by")


def _log_objects(spark, sf):
    return S.read_table(spark, sf, "events").selectExpr(f"{S.LOG_OBJECTS.format(string='STRING')} AS object_name").distinct()


def q_log_newest_contains(spark, sf):
    return newest_change(S.change_log(spark, sf), _log_objects(spark, sf), match="contains").select("branch", "object_name", "id")


def q_log_as_of_branches(spark, sf):
    """For each order the state of one branch's log at the order's time, moved to the log's years."""
    points = S.read_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS point", "concat('b', CAST(o_custkey % 9 AS STRING)) AS branch",
        "timestampadd(SECOND, CAST((o_orderkey * 7919) % 2700000 AS INT), TIMESTAMP_NTZ '2023-12-31 12:00:00') AS at")
    found = log_as_of(S.change_log(spark, sf), points)
    return found.select("point", "branch", "id", "object_identity")


def q_log_tail_newest(spark, sf):
    """Newest entry per branch and object, by a stream over the log's files."""
    root = scratch_path(spark, "tail")
    S.change_log(spark, sf).withColumn("event_time", F.col("event_time").cast("timestamp")).repartition(4).write.parquet(f"{root}/log")
    tail_newest(spark, f"{root}/log", f"{root}/newest", f"{root}/checkpoint", files_per_batch=2).awaitTermination()
    return read_newest(spark, f"{root}/newest").select("branch", "object_identity", "id", "command_tag", "command")


def q_new_rows_clustered(spark, sf):
    """New orders among the branch's later ones; of main, written in ranges of the key, only the files of these are read."""
    path = scratch_path(spark, "clustered")
    main = _side(spark, sf, "main", "orders")
    clustered.clustered(main, ["o_orderkey"], 8).write.parquet(path)
    most = S.read_table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    late = _side(spark, sf, "branch", "orders").filter(F.col("o_orderkey") * 4 >= 3 * most)
    return clustered.new_rows(late, spark.read.schema(main.schema).parquet(path), ["o_orderkey"])


def _level_specs(specs):
    """The specs with foreign keys in a chain and a circle: orders refer to customers, these and the nations to each other."""
    specs = {t: s.copy() for t, s in specs.items()}
    specs["public.customer"].foreign_keys["customer_home_fkey"] = ForeignKey(["c_nationkey"], "nation", ["n_nationkey"])
    specs["public.nation"].foreign_keys["nation_customer_fkey"] = ForeignKey(["n_nationkey"], "customer", ["c_nationkey"])
    specs["public.nation"].foreign_keys["nation_region_fkey"] = ForeignKey(["n_regionkey"], "region", ["r_regionkey"])
    return specs


def q_merge_by_levels(spark, sf):
    """The merge, staged and checked level by level in files of ranges of the keys; each table's level, rows and digest."""
    root = scratch_path(spark, "levels")
    main, branch = (S.commit_side(spark, sf, side, f"{root}/{side}") for side in ("main", "branch"))
    specs = {side: _level_specs(S.side_specs(side)) for side in ("base", "main", "branch")}
    base = take_snapshot(S.evolved_namespace(spark, sf, "base"), specs["base"], spark)
    merge(base, main, branch, specs["main"], specs["branch"], target=f"{root}/merged", resolve="branch", by_level=True, rows_per_file=4000)
    merged = Namespace.load(spark, f"{root}/merged")
    levels = [(*split_name(t), k) for k, level in enumerate(apply_levels(merged.specs)) for c in level for t in c]
    return fingerprint_all(merged.tables).join(local_frame(spark, levels, "schema string, table string, level int"), ["schema", "table"])


def q_first_difference(spark, sf):
    """The first table found to differ: main from the branch, the tables from their own rows in other files, and from an edited nation."""
    root = scratch_path(spark, "early")
    paths = {qualify(t): [f"{sf}/{t}.parquet"] for t in ("nation", "customer", "orders", "events")}
    given = Namespace.from_paths(spark, paths)
    for t in paths:
        given.tables[t].repartition(3).write.parquet(f"{root}/{t}")
    copied = Namespace.from_paths(spark, {t: f"{root}/{t}" for t in paths})
    name = F.when(F.col("n_nationkey") == 7, F.upper(F.concat("n_name", F.lit("x")))).otherwise(F.col("n_name"))
    given.tables["public.nation"].withColumn("n_name", name).write.parquet(f"{root}/edited")
    edited = Namespace.from_paths(spark, {**{t: f"{root}/{t}" for t in paths}, "public.nation": f"{root}/edited"})
    sides = [("branch", _ns(spark, sf, "main"), _ns(spark, sf, "branch")), ("copied", given, copied), ("edited", given, edited)]
    return local_frame(spark, [(k, first_difference(a, b)) for k, a, b in sides], "pair string, table string")


def q_catalog_snapshot(spark, sf):
    """Tables and columns of a database of the session catalog over the given files, with their rows."""
    name = f"bw_{zlib.crc32(sf.encode())}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch_path(spark, 'catalog')}'")
    for t in S.TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}.{t} USING parquet LOCATION '{sf}/{t}.parquet'")
    ns = Namespace.from_catalog(spark, name)
    listed = take_snapshot(ns.tables, spark=spark).columns
    p = profile(ns.tables).withColumn("table", F.substring_index("table", ".", -1))
    listed = listed.select(F.col("table").alias("t"), "name", "data_type", "ordinal_position")
    return listed.join(p, (F.col("t") == F.col("table")) & (F.col("name") == F.col("column"))).select(
        "table", "name", "data_type", "ordinal_position", "row_count", "null_count")


def q_merge_orders_end_to_end(spark, sf):
    return _merged(spark, sf).tables["public.orders"]


def q_merge_namespace_fingerprints(spark, sf):
    """Rows, digest, key and constraint names of every table after the merge, as a reader finds them."""
    merged = _merged(spark, sf)
    names = local_frame(spark, [(*n.split(".", 1), ",".join(s.primary_key), ",".join(sorted([*s.checks, *s.foreign_keys, *s.indexes])))
                                for n, s in merged.specs.items()], "schema string, table string, key_columns string, named string")
    return fingerprint_all(merged.tables).join(names, ["schema", "table"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "fingerprint_orders": q_fingerprint("orders"),
        "fingerprint_lineitem": q_fingerprint("lineitem"),
        "fingerprint_documents": q_fingerprint("documents"),
        "fingerprint_embeddings": q_fingerprint("embeddings"),
        "fingerprint_all_main": q_fingerprint_all_tables,
        "fingerprint_empty": q_fingerprint_empty,
        "compare_tables": q_compare_tables,
        "divergent_tables": q_divergent_tables,
        "data_change_lines": q_data_change_lines,
        "new_rows_orders": q_new_rows_orders,
        "new_rows_conversations": q_new_rows_conversations,
        "merged_orders": q_merged_orders,
        "merged_new_table_labels": q_merged_new_table_labels,
        "inserted_counts": q_inserted_counts,
        "data_merge_plan": q_data_merge_plan,
        "data_merge_plan_no_data": q_data_merge_plan_no_data,
        "table_list": q_table_list,
        "column_snapshot": q_column_snapshot,
        "schema_diff_tables": _diff_kind("table"),
        "schema_diff_columns": _diff_kind("column"),
        "schema_diff_indexes": _diff_kind("index"),
        "schema_diff_constraints": _diff_kind("constraint"),
        "schema_merge_plan": q_schema_plan(None),
        "schema_merge_branch_wins": q_schema_plan("branch"),
        "schema_merge_main_wins": q_schema_plan("main"),
        "schema_conflicts": q_schema_conflicts,
        "implied_children_skipped": q_implied_children_skipped,
        "evolve_add_column": q_evolve_add_column,
        "evolve_cast_column": q_evolve_cast_column,
        "evolve_drop_column": q_evolve_drop_column,
        "check_pk_lineitem": q_check_pk_lineitem,
        "check_fk_orders": q_check_fk_orders,
        "check_not_null": q_check_not_null,
        "check_predicate": q_check_predicate,
        "check_unique": q_check_unique,
        "check_fk_composite": q_check_fk_composite,
        "check_fk_self_append": q_check_fk_self_append,
        "diff_branch": q_diff_branch,
        "fingerprint_by_file": q_fingerprint_by_file,
        "new_rows_localised": q_new_rows_localised,
        "row_changes_orders": q_row_changes_orders,
        "data_merge_plan_three_way": q_data_merge_plan_three_way,
        "log_newest_contains": q_log_newest_contains,
        "log_as_of_branches": q_log_as_of_branches,
        "log_tail_newest": q_log_tail_newest,
        "catalog_snapshot": q_catalog_snapshot,
        "new_rows_clustered": q_new_rows_clustered,
        "merge_by_levels": q_merge_by_levels,
        "first_difference": q_first_difference,
        "branch_copy_proof": q_branch_copy_proof,
        "merge_orders_end_to_end": q_merge_orders_end_to_end,
        "merge_namespace_fingerprints": q_merge_namespace_fingerprints,
    }
    if llm_queries is not None:
        out |= llm_queries.queries()
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: which tables differ between main and branch, and by how many rows."""
    ensure_checkpoint_dir(spark)
    return q_compare_tables(spark, FLAGSHIP_SF)


# ---------------------------------------------------------------------------------------------
# oracle SQL (DuckDB)

def _cols(t):
    return O.TESTDATA_SCHEMAS[t]


def _fp_sql(side, t):
    return O.duck_fingerprint(S.side_sql(side, t), _cols(t))


def _fp_all_sql(side):
    parts = [f"SELECT 'public' AS schema, '{t}' AS \"table\", row_count, checksum FROM ({_fp_sql(side, t)})"
             for t in S.side_tables(side)]
    return " UNION ALL ".join(parts)


def _compare_sql():
    return (f"WITH b AS ({_fp_all_sql('main')}), c AS ({_fp_all_sql('branch')}) "
            f"SELECT coalesce(b.schema, c.schema) AS schema, coalesce(b.\"table\", c.\"table\") AS \"table\", "
            f"coalesce(b.row_count, 0) AS base_rows, coalesce(c.row_count, 0) AS curr_rows, "
            f"CASE WHEN b.checksum IS NULL THEN c.row_count > 0 WHEN c.checksum IS NULL THEN true "
            f"ELSE b.checksum <> c.checksum END AS has_change "
            f"FROM b FULL OUTER JOIN c ON b.schema = c.schema AND b.\"table\" = c.\"table\"")


def _anti_sql(t, keys):
    cond = " AND ".join(f"m.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    return (f"SELECT * FROM {S.side_sql('branch', t)} b "
            f"WHERE NOT EXISTS (SELECT 1 FROM {S.side_sql('main', t)} m WHERE {cond})")


def _keys_sql(side):
    rows = [("public", t, ",".join(S.KEYS[t])) for t in S.side_tables(side) if t in S.KEYS]
    return f"SELECT * FROM {O.values(rows, 'schema, tname, key_columns')}"


def _data_plan_sql(only_meta=False, meta=None):
    meta_filter, was = "", ", ".join(O.lit(t) for t in S.side_tables("base"))
    if only_meta:
        names = ", ".join(O.lit(m) for m in meta)
        meta_filter = f"WHERE (b.\"table\" IN ({names}) OR b.schema || '.' || b.\"table\" IN ({names}))"
    return (f"WITH m AS ({_fp_all_sql('main')}), b AS ({_fp_all_sql('branch')}), "
            f"mk AS ({_keys_sql('main')}), bk AS ({_keys_sql('branch')}), "
            f"j AS (SELECT b.schema, b.\"table\", b.row_count AS branch_rows, m.row_count AS main_rows, "
            f"m.checksum IS NULL AS new_table, m.checksum IS NULL AND b.\"table\" IN ({was}) AS dropped, b.checksum AS b_sum, m.checksum AS m_sum, "
            f"CASE WHEN m.checksum IS NULL THEN bk.key_columns ELSE mk.key_columns END AS pk "
            f"FROM b LEFT JOIN m ON m.schema = b.schema AND m.\"table\" = b.\"table\" "
            f"LEFT JOIN mk ON mk.schema = b.schema AND mk.tname = b.\"table\" "
            f"LEFT JOIN bk ON bk.schema = b.schema AND bk.tname = b.\"table\" {meta_filter}) "
            f"SELECT schema || '.' || \"table\" AS \"table\", "
            f"CASE WHEN pk IS NOT NULL THEN 'INSERT_PK' ELSE 'SYNC' END AS operation, "
            f"(CASE WHEN dropped THEN branch_rows || ' row(s) (dropped on main)' WHEN new_table THEN branch_rows || ' row(s) (new table)' "
            f"ELSE branch_rows || ' rows (branch) vs ' || main_rows || ' rows (main)' END) || "
            f"CASE WHEN pk IS NULL THEN ' (no primary key)' ELSE '' END AS row_key, CASE WHEN dropped THEN 'conflict' ELSE 'ok' END AS status, "
            f"coalesce(pk, '') AS key_columns, branch_rows, coalesce(main_rows, 0) AS main_rows, new_table "
            f"FROM j WHERE (new_table AND branch_rows > 0) OR (NOT new_table AND b_sum <> m_sum)")


def _rows_sql(side, t):
    source = S.side_sql(side, t)
    return f"(SELECT count(*) FROM {source})" if source else "CAST(0 AS BIGINT)"


def _impact_sql(side):
    """Rows per parent table, and the values that a change of a column would lose."""
    parents = sorted({r[7] for r in O.CHANGES})
    return (f"n AS (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {O.lit(p)} AS parent, {_rows_sql(side, p.split('.')[1])} AS rows_affected" for p in parents) + ")), "
        f"f AS (SELECT 'public.part.p_name' AS object_name, count(*) FILTER (WHERE p_name IS NULL) AS rows_failing FROM part "
        f"UNION ALL SELECT 'public.supplier.s_nationkey', count(*) FILTER (WHERE s_nationkey IS NOT NULL AND "
        f"TRY_CAST(s_nationkey AS BIGINT) IS NULL) FROM supplier)")


def _plan_sql(resolve, where="true"):
    rows = O.planned(resolve)
    return (f"WITH {_impact_sql('main')}, p AS (SELECT * FROM {O.values(rows, 'object_kind, object_name, change_type, change_rank, detail, parent, new_value, description, status, main_side')}) "
            f"SELECT object_kind, object_name, change_type, detail, description, status, parent, rows_affected, "
            f"coalesce(rows_failing, 0) AS rows_failing FROM p JOIN n USING (parent) LEFT JOIN f USING (object_name) WHERE {where}")


def _diff_sql(kind):
    rows = [r[:8] for r in O.CHANGES if r[0] == kind]
    return (f"WITH {_impact_sql('base')}, d AS (SELECT * FROM {O.values(rows, 'object_kind, object_name, change_type, change_rank, detail, base_value, new_value, parent')}) "
            f"SELECT change_type, object_kind, object_name, detail, CAST(base_value AS VARCHAR) AS base_value, CAST(new_value AS VARCHAR) AS new_value, "
            f"parent, CAST(change_rank AS INTEGER) AS change_rank, rows_affected, coalesce(rows_failing, 0) AS rows_failing "
            f"FROM d JOIN n USING (parent) LEFT JOIN f USING (object_name)")


def _columns_sql():
    parts = []
    for t in S.TABLES:
        for k, (c, kind) in enumerate(_cols(t), start=1):
            free = "false" if c in S.KEYS.get(t, ()) else "true"
            parts.append(f"SELECT 'public' AS schema, '{t}' AS \"table\", '{c}' AS name, '{kind}' AS data_type, {free} AS is_nullable, "
                         f"CAST({k} AS INTEGER) AS ordinal_position, count(*) AS row_count, count(*) - count({c}) AS null_count FROM {t}")
    return " UNION ALL ".join(parts)


def _all_fp_sql():
    return " UNION ALL ".join(f"SELECT 'public' AS schema, '{t}' AS \"table\", row_count, checksum FROM "
                              f"({O.duck_fingerprint(t, _cols(t))})" for t in S.TABLES)


#: The scenario's column edits per side and table, for DuckDB: (select list, columns).
def _evolved(side, t):
    cols, source = list(_cols(t)), S.side_sql(side, t)
    if source is None:
        return None
    if t == "supplier" and side != "base":
        cols = [(c, "bigint" if c == "s_nationkey" else k) for c, k in cols]
    if t == "customer" and side == "branch":
        cols = [x for x in cols if x[0] != "c_mktsegment"]
    extra = {("main", "orders"): ("o_channel", "int", "CAST(NULL AS INTEGER)"), ("branch", "orders"): ("o_channel", "string", "'web'"),
             ("main", "part"): ("p_note", "string", "CAST(NULL AS VARCHAR)")}.get((side, t))
    names = ", ".join(c for c, _ in cols)
    if extra:
        return f"(SELECT {names}, {extra[2]} AS {extra[0]} FROM {source})", [*cols, extra[:2]]
    return f"(SELECT {names} FROM {source})", cols


def _diff_branch_sql():
    parts = []
    for t in S.TABLES:
        a, b = _evolved("main", t), _evolved("branch", t)
        if not a and not b:
            continue
        if not a or not b:
            here = (a or b)[0]
            rows = f"(SELECT count(*) FROM {here})"
            change = "true" if a else f"{rows} > 0"
            parts.append(f"SELECT 'public' AS schema, '{t}' AS \"table\", {rows if a else 'CAST(0 AS BIGINT)'} AS base_rows, "
                         f"{rows if b else 'CAST(0 AS BIGINT)'} AS curr_rows, {change} AS has_change, {change} AS common_change")
            continue
        both = [x for x in a[1] if x in b[1]]
        fp = lambda e, cols: f"(SELECT checksum FROM ({O.duck_fingerprint(e, cols)}))"
        parts.append(f"SELECT 'public', '{t}', (SELECT count(*) FROM {a[0]}), (SELECT count(*) FROM {b[0]}), "
                     f"{fp(*a)} <> {fp(*b)}, {fp(a[0], both)} <> {fp(b[0], both)}")
    return (f"SELECT * FROM ({' UNION ALL '.join(parts)}) d(schema, \"table\", base_rows, curr_rows, has_change, common_change)")


def _merged_sql():
    """Every table after the merge (the branch wins): rows by the rules of the scenario, keys and names by hand."""
    named = {"orders": "idx_orders_cust,orders_custkey_fkey,orders_price_check", "customer": "customer_nation_fkey",
             "events": "idx_events_user", "lineitem": "idx_lineitem_ship"}
    parts = []
    for t in S.TABLES:
        if t in ("pages", "embeddings"):  # dropped on the branch, and on both sides
            continue
        cols = list(_cols(t))
        main, branch = S.side_sql("main", t), S.side_sql("branch", t)
        if main is None:
            source = branch
        elif t in S.KEYS and t not in ("region",):
            source = f"(SELECT * FROM {main} UNION ALL {_anti_sql(t, S.KEYS[t])})"
        else:
            source = main
        if t == "orders":
            names = ", ".join(c for c, _ in cols)
            source = (f"(SELECT {names}, CAST(NULL AS VARCHAR) AS o_channel FROM {main} UNION ALL "
                      f"SELECT {names}, 'web' FROM ({_anti_sql('orders', ['o_orderkey'])}))")
            cols.append(("o_channel", "string"))
        if t == "part":
            source, cols = f"(SELECT *, CAST(NULL AS VARCHAR) AS p_note FROM {source})", [*cols, ("p_note", "string")]
        if t == "customer":
            cols = [x for x in cols if x[0] != "c_mktsegment"]
        parts.append(f"SELECT 'public' AS schema, '{t}' AS \"table\", row_count, checksum, '{','.join(S.KEYS.get(t, []))}' AS key_columns, "
                     f"'{named.get(t, '')}' AS named FROM ({O.duck_fingerprint(source, cols)})")
    return " UNION ALL ".join(parts)


def _three_way_sql():
    """The plan from counts and digests of the three sides; nation as main alone has it."""
    main = _fp_all_sql("main").replace(_fp_sql("main", "nation"), O.duck_fingerprint("(SELECT * FROM nation WHERE n_nationkey % 5 <> 2)", _cols("nation")))
    return (f"WITH o AS ({_fp_all_sql('base')}), m AS ({main}), b AS ({_fp_all_sql('branch')}), "
            f"mk AS ({_keys_sql('main')}), bk AS ({_keys_sql('branch')}), "
            f"j AS (SELECT b.schema || '.' || b.\"table\" AS \"table\", b.row_count AS branch_rows, coalesce(m.row_count, 0) AS main_rows, "
            f"m.checksum IS NULL AS new_table, o.checksum AS o_sum, m.checksum AS m_sum, "
            f"CASE WHEN m.checksum IS NULL THEN bk.key_columns ELSE mk.key_columns END AS pk FROM b "
            f"LEFT JOIN m ON m.schema = b.schema AND m.\"table\" = b.\"table\" LEFT JOIN o ON o.schema = b.schema AND o.\"table\" = b.\"table\" "
            f"LEFT JOIN mk ON mk.schema = b.schema AND mk.tname = b.\"table\" LEFT JOIN bk ON bk.schema = b.schema AND bk.tname = b.\"table\" "
            f"WHERE (o.checksum IS NULL OR o.checksum <> b.checksum) AND ((m.checksum IS NULL AND b.row_count > 0) OR m.checksum <> b.checksum)) "
            f"SELECT \"table\", CASE WHEN pk IS NOT NULL THEN 'INSERT_PK' ELSE 'SYNC' END AS operation, "
            f"CASE WHEN new_table AND o_sum IS NOT NULL THEN branch_rows || ' row(s) (dropped on main)' WHEN new_table THEN branch_rows || ' row(s) (new table)' "
            f"ELSE branch_rows || ' rows (branch) vs ' || main_rows || ' rows (main)' END || CASE WHEN pk IS NULL THEN ' (no primary key)' ELSE '' END AS row_key, "
            f"CASE WHEN new_table AND o_sum IS NOT NULL THEN 'conflict' ELSE 'ok' END AS status, branch_rows, main_rows, new_table, "
            f"CASE WHEN o_sum IS NULL THEN NULL WHEN m_sum IS NOT DISTINCT FROM o_sum THEN 'branch' ELSE 'both' END AS changed_by FROM j")


def oracle_sql() -> dict[str, str]:
    orders_cols = ", ".join(c for c, _ in _cols("orders"))
    out = {
        "fingerprint_orders": O.duck_fingerprint("orders", _cols("orders")),
        "fingerprint_lineitem": O.duck_fingerprint("lineitem", _cols("lineitem")),
        "fingerprint_documents": O.duck_fingerprint("documents", _cols("documents")),
        "fingerprint_embeddings": O.duck_fingerprint("embeddings", _cols("embeddings")),
        "fingerprint_all_main": _all_fp_sql(),
        "fingerprint_empty": O.duck_fingerprint("(SELECT * FROM region WHERE r_regionkey < 0)", _cols("region")),
        "compare_tables": _compare_sql(),
        "divergent_tables": (f"WITH m AS ({_fp_all_sql('main')}), b AS ({_fp_all_sql('branch')}) "
                             f"SELECT m.schema, m.\"table\", m.row_count AS main_rows, b.row_count AS branch_rows "
                             f"FROM m JOIN b ON m.schema = b.schema AND m.\"table\" = b.\"table\" "
                             f"WHERE m.checksum <> b.checksum"),
        "data_change_lines": (f"SELECT schema, \"table\", base_rows, curr_rows, curr_rows - base_rows AS row_diff, "
                              f"'  ~ ' || schema || '.' || \"table\" || ' (' || base_rows || ' -> ' || curr_rows || "
                              f"' rows, ' || CASE WHEN curr_rows - base_rows >= 0 THEN '+' ELSE '' END || "
                              f"(curr_rows - base_rows) || ')' AS line FROM ({_compare_sql()}) WHERE has_change"),
        "new_rows_orders": _anti_sql("orders", ["o_orderkey"]),
        "new_rows_conversations": _anti_sql("conversations", ["conv_id", "turn"]),
        "merged_orders": f"SELECT * FROM {S.side_sql('main', 'orders')} UNION ALL {_anti_sql('orders', ['o_orderkey'])}",
        "merged_new_table_labels": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels",
        "inserted_counts": " UNION ALL ".join(
            f"SELECT 'public.{t}' AS \"table\", count(*) AS inserted FROM ("
            + (_anti_sql(t, S.KEYS[t]) if S.side_sql("main", t) else f"SELECT * FROM {S.side_sql('branch', t)}") + ")"
            for t in ("orders", "conversations", "benchmark", "region", "labels")),
        "data_merge_plan": _data_plan_sql(),
        "data_merge_plan_no_data": _data_plan_sql(True, ["benchmark"]),
        "table_list": " UNION ALL ".join(f"SELECT 'public' AS schema, '{t}' AS name, count(*) AS row_count FROM {t}" for t in S.TABLES),
        "column_snapshot": _columns_sql(),
        "schema_diff_tables": _diff_sql("table"),
        "schema_diff_columns": _diff_sql("column"),
        "schema_diff_indexes": _diff_sql("index"),
        "schema_diff_constraints": _diff_sql("constraint"),
        "schema_merge_plan": _plan_sql(None),
        "schema_merge_branch_wins": _plan_sql("branch"),
        "schema_merge_main_wins": _plan_sql("main"),
        "schema_conflicts": "SELECT 'schema' AS type, object_name, detail AS branch_side, main_side, rows_affected FROM "
                            + O.values([r for r in O.planned(None) if r[8] == "conflict"],
                                       "object_kind, object_name, change_type, change_rank, detail, parent, new_value, description, status, main_side")
                            + f" JOIN (WITH {_impact_sql('main')} SELECT * FROM n) USING (parent)",
        "implied_children_skipped": _plan_sql(None, "contains(description, ' (included in table ')"),
        "diff_branch": _diff_branch_sql(),
        "evolve_add_column": "SELECT *, 'web' AS o_channel FROM orders",
        "evolve_cast_column": ("SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, "
                               "CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity) FROM lineitem"),
        "evolve_drop_column": "SELECT * EXCLUDE (c_mktsegment) FROM customer",
        "check_pk_lineitem": ("SELECT 'public.lineitem' AS \"table\", 'lineitem_pkey' AS constraint_name, "
                              "'PRIMARY KEY' AS type, CAST(coalesce(sum(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL "
                              "THEN n WHEN n > 1 THEN n END), 0) AS BIGINT) AS violations FROM (SELECT l_orderkey, "
                              "l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"),
        "check_fk_orders": ("SELECT 'public.orders' AS \"table\", 'orders_custkey_fkey' AS constraint_name, "
                            "'FOREIGN KEY' AS type, count(*) AS violations FROM orders o WHERE o.o_custkey IS NOT NULL "
                            "AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey % 50 <> 0 "
                            "AND c.c_custkey = o.o_custkey)"),
        "check_not_null": ("SELECT 'public.events' AS \"table\", 'events_' || c || '_not_null' AS constraint_name, "
                           "'NOT NULL' AS type, v AS violations FROM (SELECT "
                           "count(*) FILTER (WHERE event_id % 7 = 0 OR props IS NULL) AS props, "
                           "count(*) FILTER (WHERE event_type IS NULL) AS event_type, "
                           "count(*) FILTER (WHERE ts IS NULL) AS ts FROM events) "
                           "UNPIVOT (v FOR c IN (props, event_type, ts))"),
        "check_predicate": ("SELECT 'public.lineitem' AS \"table\", c AS constraint_name, 'CHECK' AS type, v AS violations "
                            "FROM (SELECT count(*) FILTER (WHERE NOT coalesce(l_discount <= 0.05, true)) AS "
                            "lineitem_discount_check, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, true)) AS "
                            "lineitem_quantity_check, count(*) FILTER (WHERE NOT coalesce(l_shipdate >= "
                            "TIMESTAMP '1995-01-01 00:00:00', true)) AS lineitem_ship_check FROM lineitem) "
                            "UNPIVOT (v FOR c IN (lineitem_discount_check, lineitem_quantity_check, lineitem_ship_check))"),
        "check_unique": ("SELECT 'public.events' AS \"table\", 'events_user_type_key' AS constraint_name, 'UNIQUE' AS type, "
                         "CAST(coalesce(sum(n), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM events WHERE user_id IS NOT "
                         "NULL AND event_type IS NOT NULL GROUP BY user_id, event_type HAVING count(*) > 1)"),
        "check_fk_composite": ("SELECT 'public.answers' AS \"table\", 'answers_turn_fkey' AS constraint_name, 'FOREIGN KEY' AS type, "
                               "count(*) AS violations FROM conversations a WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations q "
                               "WHERE q.role <> 'system' AND q.conv_id = a.conv_id AND q.turn = a.turn - 1)"),
        "check_fk_self_append": ("SELECT 'public.turns' AS \"table\", 'turns_before_fkey' AS constraint_name, 'FOREIGN KEY' AS type, "
                                 "count(*) AS violations FROM conversations a WHERE turn > 1 AND (conv_id + turn) % 5 <> 1 AND NOT EXISTS "
                                 "(SELECT 1 FROM conversations q WHERE (q.conv_id + q.turn) % 5 <> 1 AND q.conv_id = a.conv_id AND "
                                 "q.turn = a.turn - 1)"),
        "fingerprint_by_file": f"SELECT * FROM ({_fp_all_sql('main')}) WHERE \"table\" IN ('orders', 'lineitem', 'conversations')",
        "new_rows_localised": ("SELECT 'orders' AS t, o_orderkey AS a, CAST(NULL AS BIGINT) AS b, o_orderstatus AS v FROM ("
                               + _anti_sql("orders", ["o_orderkey"]) + ") UNION ALL SELECT 'conversations', conv_id, turn, text FROM ("
                               + _anti_sql("conversations", ["conv_id", "turn"]) + ")"),
        "row_changes_orders": (f"SELECT coalesce(b.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' "
                               f"WHEN c.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM {S.side_sql('base', 'orders')} b "
                               f"FULL OUTER JOIN {S.side_sql('branch', 'orders')} c ON b.o_orderkey = c.o_orderkey WHERE b.o_orderkey IS NULL OR "
                               f"c.o_orderkey IS NULL OR " + " OR ".join(f"b.{c} IS DISTINCT FROM c.{c}" for c, _ in _cols("orders"))),
        "data_merge_plan_three_way": _three_way_sql(),
        "log_newest_contains": (f"WITH l AS ({S.log_sql('VARCHAR')}), o AS (SELECT DISTINCT {S.LOG_OBJECTS.format(string='VARCHAR')} AS object_name FROM events) "
                                f"SELECT l.branch, o.object_name, max(l.id) AS id FROM l JOIN o ON l.object_identity = o.object_name OR "
                                f"contains(l.command, o.object_name) OR contains(l.command, split_part(o.object_name, '.', 2)) GROUP BY ALL"),
        "log_as_of_branches": (f"WITH l AS ({S.log_sql('VARCHAR')}), p AS (SELECT o_orderkey AS point, concat('b', CAST(o_custkey % 9 AS VARCHAR)) AS branch, "
                               f"TIMESTAMP '2023-12-31 12:00:00' + to_seconds(CAST((o_orderkey * 7919) % 2700000 AS INTEGER)) AS at FROM orders) "
                               f"SELECT p.point, p.branch, l.id, l.object_identity FROM p ASOF LEFT JOIN l ON p.branch = l.branch AND p.at >= l.event_time"),
        "log_tail_newest": (f"SELECT branch, object_identity, id, command_tag, command FROM ({S.log_sql('VARCHAR')}) "
                            f"QUALIFY row_number() OVER (PARTITION BY branch, object_identity ORDER BY id DESC) = 1"),
        "new_rows_clustered": (f"SELECT * FROM ({_anti_sql('orders', ['o_orderkey'])}) "
                               f"WHERE o_orderkey * 4 >= 3 * (SELECT max(o_orderkey) FROM orders)"),
        "merge_by_levels": (f"SELECT schema, \"table\", row_count, checksum, CAST(CASE \"table\" WHEN 'orders' THEN 2 WHEN 'customer' THEN 1 WHEN 'nation' THEN 1 "
                            f"ELSE 0 END AS INTEGER) AS level FROM ({_merged_sql()})"),
        "first_difference": ("SELECT 'branch' AS pair, CASE WHEN (SELECT count(*) FROM documents) > 0 THEN 'public.documents' END AS \"table\" UNION ALL "
                             "SELECT 'copied', NULL UNION ALL SELECT 'edited', CASE WHEN (SELECT count(*) FROM nation WHERE n_nationkey = 7) > 0 "
                             "THEN 'public.nation' END"),
        "catalog_snapshot": f"SELECT * EXCLUDE (schema, is_nullable) FROM ({_columns_sql()})",
        "merge_namespace_fingerprints": _merged_sql(),
        "branch_copy_proof": (f"SELECT schema || '.' || \"table\" AS \"table\", row_count, checksum, true AS copied_ok "
                              f"FROM ({_all_fp_sql()})"),
        "merge_orders_end_to_end": (f"SELECT {orders_cols}, CAST(NULL AS VARCHAR) AS o_channel FROM "
                                    f"{S.side_sql('main', 'orders')} UNION ALL SELECT {orders_cols}, 'web' AS o_channel "
                                    f"FROM ({_anti_sql('orders', ['o_orderkey'])})"),
    }
    if llm_queries is not None:
        out |= llm_queries.oracle_sql()
    return out
