import pytest
from pyspark.sql import functions as F

from branchwise.operators.checks import check_constraints
from branchwise.operators.rows import merge_rows, new_rows
from branchwise.plans.merge import MergeCheckError, MergeConflictError, diff_branch, merge
from branchwise.sources import registry
from branchwise.sources.namespace import Namespace, copy_namespace
from branchwise.sources.snapshot import take_snapshot
from branchwise.sources.spec import ForeignKey, Index, TableSpec

SITES = "id int, name string, code string"
SPECS = {"sites": TableSpec(primary_key=["id"], not_null=["name"], unique={"sites_code_key": ["code"]}),
         "visits": TableSpec(primary_key=["id"], not_null=["title"]),
         "sequelize_meta": TableSpec(primary_key=["name"]),
         "local_releases": TableSpec(primary_key=["id"])}


def sites(spark, rows):
    return spark.createDataFrame(rows, SITES)


BASE_SITES = [(1, "Harbour", "H-1"), (2, "Quarry", "Q-2")]


def test_new_rows_composite_key_and_null_equality(spark):
    main = spark.createDataFrame([(1, 1, "a"), (1, None, "b")], "k1 int, k2 int, v string")
    branch = spark.createDataFrame([(1, 1, "x"), (1, None, "y"), (2, 1, "z")], "k1 int, k2 int, v string")
    assert [tuple(r) for r in new_rows(branch, main, ["k1", "k2"]).collect()] == [(2, 1, "z")]
    merged = merge_rows(main, branch, ["k1", "k2"])
    assert merged.count() == 3
    assert merge_rows(merged, branch, ["k1", "k2"]).count() == 3  # idempotent


def test_dry_run_plans_insert_and_leaves_main(spark):
    base = take_snapshot({"sites": sites(spark, BASE_SITES)}, SPECS)
    main = {"sites": sites(spark, BASE_SITES)}
    branch = {"sites": sites(spark, BASE_SITES + [(3, "Mill", "M-3")])}
    res = merge(base, main, branch, SPECS, SPECS)
    ops = res.data_ops.collect()
    assert [(o.operation, o.table) for o in ops] == [("INSERT_PK", "public.sites")]
    assert "3 rows" in ops[0].row_key and "2 rows" in ops[0].row_key
    assert not res.pending_data_changes() and not res.applied
    assert res.summary().startswith("=== DRY RUN (no changes applied) ===")


def test_apply_inserts_once_and_adds_column(spark, tmp_root):
    base = take_snapshot({"sites": sites(spark, BASE_SITES)}, SPECS)
    main = {"sites": sites(spark, BASE_SITES + [(10, "Depot", "X-9")])}
    branch_sites = sites(spark, BASE_SITES + [(10, "Annex", "Y-9"), (3, "Mill", "M-3")]) \
        .withColumn("note", F.lit("hi"))
    visits = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "id int, title string")
    res = merge(base, main, {"sites": branch_sites, "visits": visits}, SPECS, SPECS, target=tmp_root)
    assert res.applied and res.inserted == {"public.sites": 1, "public.visits": 3}
    out = Namespace.load(spark, tmp_root)
    u = {r.id: (r.name, r.note) for r in out.tables["public.sites"].collect()}
    assert u == {1: ("Harbour", None), 2: ("Quarry", None), 10: ("Depot", None), 3: ("Mill", "hi")}
    assert out.tables["public.visits"].count() == 3
    assert "Merge applied successfully." in res.summary()
    # a second merge of the same branch inserts nothing new
    again = merge(base, out.tables, {"sites": branch_sites, "visits": visits}, SPECS, SPECS,
                  target=tmp_root + "/again")
    assert sum(again.inserted.values()) == 0


def test_keyless_table_is_sync_and_not_applied(spark, tmp_root):
    ev = "at timestamp, kind string"
    e1 = spark.createDataFrame([("2024-01-01 00:00:00", "a")], "at string, kind string").select(
        F.col("at").cast("timestamp").alias("at"), "kind")
    e2 = e1.unionByName(e1.withColumn("kind", F.lit("b")))
    base = take_snapshot({"events": e1})
    res = merge(base, {"events": e1}, {"events": e2}, target=tmp_root)
    op = res.data_ops.collect()[0]
    assert op.operation == "SYNC" and "no primary key" in op.row_key and res.pending_data_changes()
    s = res.summary()
    assert "[NOT APPLIED]" in s and "DETECTED but NOT APPLIED" in s and "Merge applied successfully." not in s
    assert Namespace.load(spark, tmp_root).tables["public.events"].count() == 1
    assert ev


def test_no_data_still_merges_bookkeeping(spark, tmp_root):
    meta = "name string"
    m_meta = spark.createDataFrame([("001",)], meta)
    b_meta = spark.createDataFrame([("001",), ("002",), ("003",)], meta)
    base = take_snapshot({"sites": sites(spark, BASE_SITES), "sequelize_meta": m_meta}, SPECS)
    main = {"sites": sites(spark, BASE_SITES), "sequelize_meta": m_meta}
    branch = {"sites": sites(spark, BASE_SITES + [(3, "C", "M-3")]), "sequelize_meta": b_meta}
    res = merge(base, main, branch, SPECS, SPECS, no_data=True, target=tmp_root)
    assert [o.table for o in res.data_ops.collect()] == ["public.sequelize_meta"]
    out = Namespace.load(spark, tmp_root)
    assert out.tables["public.sequelize_meta"].count() == 3 and out.tables["public.sites"].count() == 2
    # a custom list replaces the defaults
    v_m = spark.createDataFrame([], "id int, label string")
    v_b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    base2 = take_snapshot({"sequelize_meta": m_meta, "local_releases": v_m}, SPECS)
    res2 = merge(base2, {"sequelize_meta": m_meta, "local_releases": v_m},
                 {"sequelize_meta": b_meta, "local_releases": v_b}, SPECS, SPECS, no_data=True,
                 meta_tables=["local_releases"], target=tmp_root + "/2")
    out2 = Namespace.load(spark, tmp_root + "/2")
    assert out2.tables["public.local_releases"].count() == 2 and out2.tables["public.sequelize_meta"].count() == 1
    assert res2.applied
    none = merge(base, main, branch, SPECS, SPECS, no_data=True, meta_tables=[])
    assert none.data_ops.count() == 0


def test_conflict_raises_on_apply_and_resolves(spark, tmp_root):
    base = take_snapshot({"sites": sites(spark, BASE_SITES)}, SPECS)
    main = {"sites": sites(spark, BASE_SITES).withColumn("status", F.lit(1))}
    branch = {"sites": sites(spark, BASE_SITES).withColumn("status", F.lit("active"))}
    dry = merge(base, main, branch, SPECS, SPECS)
    assert dry.has_conflicts() and "CONFLICTS (1):" in dry.summary()
    with pytest.raises(MergeConflictError, match="merge has 1 conflicts"):
        merge(base, main, branch, SPECS, SPECS, target=tmp_root + "/x")
    res = merge(base, main, branch, SPECS, SPECS, target=tmp_root + "/b", resolve="branch")
    out = Namespace.load(spark, tmp_root + "/b").tables["public.sites"]
    assert dict(out.dtypes)["status"] == "string" and res.applied
    res_m = merge(base, main, branch, SPECS, SPECS, resolve="main")
    assert "main wins" in res_m.summary() and "CONFLICTS" not in res_m.summary()


def test_constraint_violation_aborts_without_commit(spark, tmp_root):
    base = take_snapshot({"sites": sites(spark, BASE_SITES)}, SPECS)
    main = {"sites": sites(spark, BASE_SITES)}
    branch = {"sites": sites(spark, BASE_SITES + [(3, "C", "H-1")])}  # duplicate code
    with pytest.raises(MergeCheckError, match="sites_code_key"):
        merge(base, main, branch, SPECS, SPECS, target=tmp_root)
    with pytest.raises(Exception):
        Namespace.load(spark, tmp_root)


def test_checks(spark):
    cust = spark.createDataFrame([(1,), (2,)], "c int")
    orders = spark.createDataFrame([(1, 1, 5.0), (2, 3, -1.0), (2, None, None), (3, 3, 1.0)], "id int, c int, t double")
    specs = {"orders": TableSpec(primary_key=["id"], not_null=["t"], checks={"t_pos": "t > 0"},
                                 foreign_keys={"fk": ForeignKey(["c"], "cust", ["c"])})}
    got = {r.constraint_name: r.violations for r in check_constraints({"cust": cust, "orders": orders}, specs).collect()}
    assert got == {"orders_pkey": 2, "fk": 2, "orders_t_not_null": 1, "t_pos": 1}


def test_copy_with_proof_and_registry(spark, tmp_root):
    t = {"sites": sites(spark, BASE_SITES), "empty": spark.createDataFrame([], "id int")}
    proof = copy_namespace(t, tmp_root + "/copy")
    assert all(r.copied_ok for r in proof.collect()) and proof.count() == 2
    reg = registry.empty_registry(spark)
    reg, _ = registry.create_branch(reg, "dev", t, SPECS, tmp_root + "/dev", created_at="2024-01-01 00:00:00")
    reg = registry.register_branch(reg, "feat", tmp_root + "/feat", "main", take_snapshot(t, SPECS),
                                   created_at="2024-01-02 00:00:00")
    rows = registry.list_branches(reg, current="feat").collect()
    assert [(r.name, r.is_current) for r in rows] == [("dev", False), ("feat", True)]
    with pytest.raises(ValueError):
        registry.register_branch(reg, "dev", "x", "main", take_snapshot(t))
    snap = registry.load_snapshot(reg, "dev")
    assert snap.columns.filter("table = 'sites'").count() == 3
    with pytest.raises(KeyError):
        registry.load_snapshot(reg, "missing")
    lines = registry.list_lines(reg, "main_db", "feat")
    assert lines[0] == "    main (main_db)" and lines[2].startswith("  * feat (")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 13 and set(df.columns) == {"schema", "table", "base_rows", "curr_rows", "has_change"}
    own = set(E.queries()) - (set(E.llm_queries.queries()) if E.llm_queries else set())
    assert own - set(E.oracle_sql()) == set()


def committed(spark, root, tables, specs):
    copy_namespace(tables, root, specs=specs)
    return Namespace.load(spark, root)


def test_merged_specs_are_kept_and_a_second_merge_has_nothing_to_do(spark, tmp_root):
    old = {"sites": TableSpec(primary_key=["id"])}
    new = {"sites": TableSpec(primary_key=["id"], not_null=["name"], defaults={"code": "'none'"}, checks={"named": "name <> ''"},
                              indexes={"by_code": Index(["code"])})}
    main = committed(spark, tmp_root + "/main", {"sites": sites(spark, BASE_SITES)}, old)
    branch = committed(spark, tmp_root + "/branch", {"sites": sites(spark, BASE_SITES + [(3, "Mill", "M-3")])}, new)
    assert main.specs["public.sites"] == old["sites"]
    base = take_snapshot(main.tables, main.specs)
    merge(base, main, branch, target=tmp_root + "/merged")
    merged = Namespace.load(spark, tmp_root + "/merged")
    assert merged.specs["public.sites"] == new["sites"] and merged.tables["public.sites"].count() == 3
    again = merge(base, merged, branch, target=tmp_root + "/again")
    assert again.schema_ops.filter("status <> 'skipped'").count() == 0
    assert again.conflicts.count() == 0 and sum(again.inserted.values()) == 0


def test_table_that_only_main_dropped(spark, tmp_root):
    spec = {"sites": TableSpec(primary_key=["id"]), "kept": TableSpec(primary_key=["id"])}
    kept = spark.createDataFrame([(1,)], "id int")
    base = take_snapshot({"sites": sites(spark, BASE_SITES), "kept": kept}, spec)
    branch = {"sites": sites(spark, BASE_SITES), "kept": kept}
    main_spec = {"kept": spec["kept"]}
    plan = merge(base, {"kept": kept}, branch, main_spec, spec)
    assert [(r.type, r.object_name) for r in plan.conflicts.collect()] == [("data", "public.sites")]
    with pytest.raises(MergeConflictError):
        merge(base, {"kept": kept}, branch, main_spec, spec, target=tmp_root + "/0")
    merge(base, {"kept": kept}, branch, main_spec, spec, target=tmp_root + "/1", resolve="main")
    assert set(Namespace.load(spark, tmp_root + "/1").tables) == {"public.kept"}
    done = merge(base, {"kept": kept}, branch, main_spec, spec, target=tmp_root + "/2", resolve="branch")
    out = Namespace.load(spark, tmp_root + "/2")
    assert done.inserted == {"public.sites": 2} and out.tables["public.sites"].count() == 2
    assert out.specs["public.sites"] == spec["sites"]
    # the branch also added a column: the whole table comes back with it
    wider = {"sites": sites(spark, BASE_SITES).withColumn("note", F.lit("x")), "kept": kept}
    merge(base, {"kept": kept}, wider, main_spec, spec, target=tmp_root + "/3", resolve="branch")
    assert {r.note for r in Namespace.load(spark, tmp_root + "/3").tables["public.sites"].collect()} == {"x"}


def test_retyped_column_that_main_dropped(spark, tmp_root):
    spec = {"sites": TableSpec(primary_key=["id"])}
    base = take_snapshot({"sites": sites(spark, BASE_SITES)}, spec)
    main = {"sites": sites(spark, BASE_SITES).drop("code")}
    branch = {"sites": sites(spark, BASE_SITES).withColumn("code", F.lit(7))}
    merge(base, main, branch, spec, spec, target=tmp_root + "/t", resolve="branch")
    out = Namespace.load(spark, tmp_root + "/t").tables["public.sites"]
    assert dict(out.dtypes)["code"] == "int" and out.count() == 2


def test_self_reference_and_lost_parent(spark, tmp_root):
    staff = lambda rows: spark.createDataFrame(rows, "id int, boss int")
    spec = {"staff": TableSpec(primary_key=["id"], foreign_keys={"staff_boss": ForeignKey(["boss"], "staff", ["id"])})}
    main = committed(spark, tmp_root + "/m", {"staff": staff([(1, None), (2, 1)])}, spec)
    base = take_snapshot(main.tables, main.specs)
    merge(base, main, {"staff": staff([(1, None), (2, 1), (3, 1), (4, 3)])}, branch_specs=spec, target=tmp_root + "/ok")
    assert Namespace.load(spark, tmp_root + "/ok").tables["public.staff"].count() == 4
    with pytest.raises(MergeCheckError, match="staff_boss"):
        merge(base, main, {"staff": staff([(1, None), (2, 1), (5, 9)])}, branch_specs=spec, target=tmp_root + "/bad")
    cust, order = spark.createDataFrame([(1,)], "c int"), spark.createDataFrame([(1, 1)], "o int, c int")
    specs = {"cust": TableSpec(primary_key=["c"]), "ord": TableSpec(primary_key=["o"], foreign_keys={"ord_c": ForeignKey(["c"], "cust", ["c"])})}
    both = {"cust": cust, "ord": order}
    base = take_snapshot(both, specs)
    with pytest.raises(MergeCheckError, match="ord_c"):
        merge(base, both, {"ord": order}, specs, {"ord": specs["ord"]}, target=tmp_root + "/lost")


def test_common_columns_and_equal_files(spark, tmp_root):
    main = committed(spark, tmp_root + "/m", {"sites": sites(spark, BASE_SITES), "big": spark.range(5).toDF("id")}, SPECS)
    branch = Namespace({**main.tables, "public.sites": main.tables["public.sites"].withColumn("note", F.lit(1))},
                       {"public.big": main.paths["public.big"]}, main.specs)
    base = take_snapshot(main.tables, main.specs)
    assert [r.table for r in merge(base, main, branch).data_ops.collect()] == ["public.sites"]
    assert merge(base, main, branch, common_columns=True).data_ops.count() == 0
    changes, data = diff_branch(base, main, branch)
    assert {r.table for r in data.filter("has_change").collect()} == {"sites"} and changes.count() == 1
    assert diff_branch(base, main, branch, common_columns=True)[1].filter("has_change").count() == 0
    done = merge(base, main, branch, target=tmp_root + "/t")
    out = Namespace.load(spark, tmp_root + "/t")
    assert done.applied and out.paths["public.big"] == main.paths["public.big"]


def test_append_only_merge_references_main_files(spark, tmp_root):
    sites(spark, BASE_SITES).write.parquet(tmp_root + "/main/sites")
    main = Namespace.from_paths(spark, {"sites": tmp_root + "/main/sites"}, SPECS)
    base = take_snapshot(main.tables, SPECS)
    branch = {"sites": sites(spark, BASE_SITES + [(3, "C", "M-3")])}
    res = merge(base, main, branch, SPECS, SPECS, target=tmp_root + "/t1")
    out = Namespace.load(spark, tmp_root + "/t1")
    assert res.inserted == {"public.sites": 1}
    assert out.paths["public.sites"][0] == tmp_root + "/main/sites"
    assert out.paths["public.sites"][1].endswith(".appended")
    assert sorted(r.id for r in out.tables["public.sites"].collect()) == [1, 2, 3]
    clash = {"sites": sites(spark, BASE_SITES + [(4, "D", "H-1")])}
    with pytest.raises(MergeCheckError, match="sites_code_key"):
        merge(base, main, clash, SPECS, SPECS, target=tmp_root + "/t2")
