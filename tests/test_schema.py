from pyspark.sql import functions as F
from branchwise.operators import changelog
from branchwise.operators.schemadiff import format_changes, schema_diff
from branchwise.plans.schema_plan import plan_schema
from branchwise.sources.snapshot import from_json, take_snapshot, to_json
from branchwise.sources.spec import ForeignKey, Index, TableSpec


def sites(spark, extra=""):
    return spark.createDataFrame([], "id int, name string, code string" + extra)


def details(changes):
    return sorted(r.detail for r in changes.collect())


def test_table_added_and_removed(spark):
    base = take_snapshot({"sites": sites(spark)})
    cur = take_snapshot({"visits": spark.createDataFrame([], "id int, title string")})
    assert details(schema_diff(base, cur)) == ["table public.sites removed", "table public.visits added (2 columns)"]


def test_column_added_and_type_changed(spark):
    base = take_snapshot({"sites": spark.createDataFrame([], "id int, status int")})
    cur = take_snapshot({"sites": spark.createDataFrame([], "id int, status bigint, note string")})
    assert details(schema_diff(base, cur)) == ["column public.sites.note added (string)",
                                               "column public.sites.status type changed: int -> bigint"]


def test_nullable_and_default_changes(spark):
    t = {"sites": sites(spark)}
    base = take_snapshot(t, {"sites": TableSpec(primary_key=["id"])})
    cur = take_snapshot(t, {"sites": TableSpec(primary_key=["id"], not_null=["name"], defaults={"code": "'x'"})})
    assert details(schema_diff(base, cur)) == ["column public.sites.code default changed",
                                               "column public.sites.name nullable changed: true -> false"]


def test_indexes_and_constraints(spark):
    t = {"sites": sites(spark), "orders": spark.createDataFrame([], "id int, user_id int, total decimal(10,2)")}
    base_specs = {"sites": TableSpec(primary_key=["id"], indexes={"idx_a": Index(["name"]), "idx_b": Index(["code"])}),
                  "orders": TableSpec(foreign_keys={"orders_user_fk": ForeignKey(["user_id"], "sites", ["id"])})}
    cur_specs = {"sites": TableSpec(primary_key=["id"], indexes={"idx_a": Index(["name", "code"]),
                                                                 "idx_c": Index(["code"], unique=True)}),
                 "orders": TableSpec(foreign_keys={"orders_user_fk": ForeignKey(["user_id", "id"], "sites", ["id", "id"])},
                                     checks={"orders_total_check": "total > 0"})}
    ch = schema_diff(take_snapshot(t, base_specs), take_snapshot(t, cur_specs))
    assert details(ch) == ["constraint public.orders_total_check added (CHECK)",
                           "constraint public.orders_user_fk definition changed",
                           "index public.idx_a definition changed", "index public.idx_b removed",
                           "index public.idx_c added"]
    text = format_changes(ch)
    assert text.startswith("Schema changes (5):") and "  ~ index public.idx_a definition changed" in text


def test_no_changes_text(spark):
    s = take_snapshot({"sites": sites(spark)})
    assert format_changes(schema_diff(s, s)) == "No schema changes."


def test_snapshot_json_roundtrip(spark):
    snap = take_snapshot({"sites": sites(spark)}, {"sites": TableSpec(primary_key=["id"], defaults={"name": "'n'"})})
    back = from_json(to_json(snap))
    for a, b in ((snap.columns, back.columns), (snap.indexes, back.indexes), (snap.constraints, back.constraints)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert len([c for c in back.columns.collect() if c.table == "sites"]) >= 3


def _plan(spark, main_extra, branch_extra, resolve=None):
    base = take_snapshot({"sites": spark.createDataFrame([], "id int, name string")})
    m = take_snapshot({"sites": spark.createDataFrame([], "id int, name string" + main_extra)})
    b = take_snapshot({"sites": spark.createDataFrame([], "id int, name string" + branch_extra)})
    return plan_schema(schema_diff(base, m), schema_diff(base, b), resolve)


def test_different_columns_do_not_conflict(spark):
    ops, conflicts = _plan(spark, ", age int", ", note string")
    assert conflicts.count() == 0
    assert [(r.description, r.status) for r in ops.collect()] == [("column public.sites.note added (string)", "ok")]


def test_same_column_other_type_conflicts(spark):
    ops, conflicts = _plan(spark, ", status int", ", status string")
    c = conflicts.collect()
    assert len(c) == 1 and c[0].object_name == "public.sites.status"
    assert c[0].branch_side == "column public.sites.status added (string)"
    assert c[0].main_side == "column public.sites.status added (int)"
    ops_b, conf_b = _plan(spark, ", status int", ", status string", "branch")
    assert conf_b.count() == 0 and ops_b.collect()[0].description.endswith(" (branch wins)")
    ops_m, conf_m = _plan(spark, ", status int", ", status string", "main")
    r = ops_m.collect()[0]
    assert conf_m.count() == 0 and r.status == "skipped" and "main wins" in r.description


def test_same_change_converges_and_new_table_children_skip(spark):
    base = take_snapshot({"sites": sites(spark)})
    m = take_snapshot({"sites": sites(spark, ", age int")})
    b_tables = {"sites": sites(spark, ", age int"), "visits": spark.createDataFrame([], "id int, title string")}
    b = take_snapshot(b_tables, {"visits": TableSpec(primary_key=["id"])})
    ops, conflicts = plan_schema(schema_diff(base, m), schema_diff(base, b))
    got = {(r.description, r.status) for r in ops.collect()}
    assert ("column public.sites.age added (int) (same on both sides)", "skipped") in got
    assert ("index public.visits_pkey added (included in table DDL)", "skipped") in got
    assert ("constraint public.visits_pkey added (PRIMARY KEY) (included in table DDL)", "skipped") in got
    assert ("table public.visits added (2 columns)", "ok") in got and conflicts.count() == 0


def test_child_change_against_removed_table_conflicts(spark):
    base = take_snapshot({"sites": sites(spark)})
    m = take_snapshot({"other": spark.createDataFrame([], "x int")})
    b = take_snapshot({"sites": sites(spark, ", note string")})
    _, conflicts = plan_schema(schema_diff(base, m), schema_diff(base, b))
    c = conflicts.collect()
    assert len(c) == 1 and c[0].object_name == "public.sites.note" and c[0].main_side == "table public.sites removed"


def test_changelog_newest_entry(spark):
    rows = [("alpha", 1, "CREATE TABLE", "lake.trips", "CREATE TABLE lake.trips (fare DOUBLE)"),
            ("alpha", 2, "ALTER TABLE", "lake.trips", "ALTER TABLE lake.trips ADD COLUMN tip DOUBLE"),
            ("alpha", 3, "CREATE TABLE", "lake.zones", "CREATE TABLE lake.zones (id INT)"),
            ("alpha", 4, "CREATE INDEX", None, "CREATE INDEX trips_by_fare ON lake.trips (fare)"),
            ("beta", 1, "DROP TABLE", "lake.trips", "DROP TABLE lake.trips"),
            ("beta", 2, "CREATE TABLE", "lake.tripsheets", "CREATE TABLE lake.tripsheets (id INT)")]
    log = spark.createDataFrame([(b, i, None, tag, "table", "lake", o, c) for b, i, tag, o, c in rows], changelog.LOG_SCHEMA)
    objs = spark.createDataFrame([("lake.trips",), ("lake.nowhere",), ("lake.trips_by_fare",)], "object_name string")
    newest = lambda o, match: {(r.branch, r.object_name): r.id for r in changelog.newest_change(log, o, match).collect()}
    assert newest(objs, "exact") == {("alpha", "lake.trips"): 2, ("beta", "lake.trips"): 1}
    assert newest(objs, "loose") == {("alpha", "lake.trips"): 4, ("beta", "lake.trips"): 1, ("alpha", "lake.trips_by_fare"): 4}
    assert newest(objs, "contains")[("beta", "lake.trips")] == 2  # part of another name
    only = spark.createDataFrame([("beta", "lake.trips")], "branch string, object_name string")
    assert newest(only, "loose") == {("beta", "lake.trips"): 1}
    plan = changelog.newest_change(log, objs, "loose")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    lines = [r.line for r in changelog.status_lines(log, "alpha").orderBy("id").collect()]
    assert lines[0] == "CREATE TABLE table lake.trips" and lines[3] == "CREATE INDEX table "
    more = spark.createDataFrame([("beta", 1, None, "ALTER TABLE", "table", "lake", "lake.zones", "x"),
                                  ("gamma", 1, None, "ALTER TABLE", "table", "lake", "lake.zones", "y")], changelog.LOG_SCHEMA)
    grown = changelog.append(log, more)
    assert sorted((r.branch, r.id) for r in grown.where("object_identity = 'lake.zones'").collect()) == [
        ("alpha", 3), ("beta", 3), ("gamma", 1)]
    shown = [r.line for r in changelog.log_lines(grown.fillna({"object_identity": ""}).withColumn(
        "event_time", F.lit("2024-05-06 07:08:09").cast("timestamp")), "beta", verbose=True).orderBy("id").collect()]
    assert shown[0] == "  2024-05-06 07:08:09  DROP TABLE lake.trips\n           DROP TABLE lake.trips"


def test_log_tail_stream(spark, tmp_root):
    from branchwise.streaming.logtail import tail_status
    log = spark.createDataFrame([("dev", 1, None, "CREATE TABLE", "table", "public", "public.sites", "c")],
                                changelog.LOG_SCHEMA)
    log.write.parquet(tmp_root + "/log/part1")
    q = tail_status(spark, tmp_root + "/log/part1", tmp_root + "/status", checkpoint=tmp_root + "/ckpt")
    q.awaitTermination(120)
    lines = [r.line for r in spark.read.parquet(tmp_root + "/status").collect()]
    assert lines == ["CREATE TABLE table public.sites"]


def test_table_dropped_on_both_sides_is_no_conflict(spark):
    spec = {"sites": TableSpec(primary_key=["id"], checks={"c": "id > 0"}, indexes={"i": Index(["code"])})}
    other = {"other": spark.createDataFrame([], "x int")}
    base = take_snapshot({"sites": sites(spark), **other}, spec)
    gone = schema_diff(base, take_snapshot(other))
    ops, conflicts = plan_schema(gone, gone)
    assert conflicts.count() == 0
    assert {(r.object_kind, r.object_name, r.status, r.description.split(" (")[-1]) for r in ops.collect()} == {
        ("table", "public.sites", "skipped", "same on both sides)"), ("index", "public.sites_pkey", "skipped", "same on both sides)"),
        ("index", "public.i", "skipped", "same on both sides)"), ("constraint", "public.sites_pkey", "skipped", "same on both sides)"),
        ("constraint", "public.c", "skipped", "same on both sides)")}


def test_children_go_with_the_table_that_the_branch_drops(spark):
    spec = {"sites": TableSpec(primary_key=["id"])}
    other = {"other": spark.createDataFrame([], "x int")}
    base = take_snapshot({"sites": sites(spark), **other}, spec)
    same, gone = take_snapshot({"sites": sites(spark), **other}, spec), take_snapshot(other)
    ops, conflicts = plan_schema(schema_diff(base, same), schema_diff(base, gone))
    assert conflicts.count() == 0 and {(r.object_kind, r.status) for r in ops.collect()} == {
        ("table", "ok"), ("index", "skipped"), ("constraint", "skipped")}
    more = take_snapshot({"sites": sites(spark, ", note string"), **other}, spec)
    for resolve, status in ((None, "conflict"), ("branch", "ok"), ("main", "skipped")):
        ops, conflicts = plan_schema(schema_diff(base, more), schema_diff(base, gone), resolve)
        got = {(r.object_kind, r.status) for r in ops.collect()}
        assert got == {("table", status), ("index", "skipped"), ("constraint", "skipped")}
        assert conflicts.count() == (resolve is None)
    plan = plan_schema(schema_diff(base, more), schema_diff(base, gone))[0]._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan.split("== Physical Plan ==")[1]


def test_hidden_schemas_are_left_out(spark):
    frames = {"a.t": sites(spark), "b.t": sites(spark), "information_schema.t": sites(spark)}
    assert {r.schema for r in take_snapshot(frames).tables.collect()} == {"a", "b"}
    assert {r.schema for r in take_snapshot(frames, hidden=["a"]).columns.collect()} == {"b", "information_schema"}


def test_dropped_column_takes_its_constraints_along():
    from branchwise.operators.evolve import ColumnOp, evolve_spec
    spec = TableSpec(primary_key=["a", "e"], unique={"q": ["e"], "r": ["b"]}, checks={"c": "e > 0", "d": "bee > 0 AND b <> 'e'"},
                     foreign_keys={"f": ForeignKey(["e"], "p", ["x"])}, indexes={"i": Index(["e"]), "j": Index(["b"])}, not_null=["e"])
    got = evolve_spec(spec, [ColumnOp("drop_column", "e")])
    assert got == TableSpec(unique={"r": ["b"]}, checks={"d": "bee > 0 AND b <> 'e'"}, indexes={"j": Index(["b"])})
    assert TableSpec.from_json(spec.to_json()) == spec
