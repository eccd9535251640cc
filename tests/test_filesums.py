import pytest
from pyspark.sql import functions as F

from branchwise.operators.filesums import FileSums
from branchwise.operators.fingerprint import fingerprint, fingerprint_all
from branchwise.plans.merge import diff_branch, merge, side_fingerprints
from branchwise.sources import registry
from branchwise.sources.namespace import Namespace, copy_namespace
from branchwise.sources.snapshot import from_json, take_snapshot, to_json
from branchwise.sources.spec import TableSpec

SPECS = {"ships": TableSpec(primary_key=["id"]), "crew": TableSpec(primary_key=["id"])}


def ships(spark, a, b):
    return spark.range(a, b).select(F.col("id").cast("int"), F.concat(F.lit("ship "), F.col("id")).alias("name"), (F.col("id") / 3).alias("load"))


def rows(fp):
    return {r.table: (r.row_count, r.checksum) for r in fp.collect()}


def test_only_files_that_came_since_are_read(spark, tmp_root):
    first, second = f"{tmp_root}/a", f"{tmp_root}/b"
    ships(spark, 0, 5000).repartition(4).write.parquet(first)
    known = FileSums(spark, {"main": Namespace.from_paths(spark, {"ships": first}).scans()})
    assert len(known.read) == 4
    ships(spark, 5000, 6000).repartition(2).write.parquet(second)
    now = Namespace.from_paths(spark, {"ships": [first, second]})
    more = FileSums(spark, {"main": now.scans()}, known.sums)
    assert len(more.read) == 2 and all("/b/" in f for f in more.read)
    whole = fingerprint(ships(spark, 0, 6000)).first()
    assert rows(more.fingerprints("main")) == {"ships": (6000, whole.checksum)}
    again = FileSums(spark, {"main": now.scans()}, more.sums)
    assert again.read == [] and rows(again.fingerprints("main")) == rows(more.fingerprints("main"))


def test_tables_with_too_many_files_to_name_are_read_whole(spark, tmp_root, monkeypatch):
    from branchwise.operators import filesums

    ships(spark, 0, 600).repartition(6).write.parquet(f"{tmp_root}/a")
    ships(spark, 600, 630).repartition(3).write.parquet(f"{tmp_root}/b")
    one, both = (Namespace.from_paths(spark, {"ships": p}) for p in (f"{tmp_root}/a", [f"{tmp_root}/a", f"{tmp_root}/b"]))
    monkeypatch.setattr(filesums, "NAMED", 2)
    files = FileSums(spark, {"one": one.scans(), "both": both.scans()})
    assert files.read == [] and files.sums.count() == 9
    assert rows(files.fingerprints("one"))["ships"] == tuple(fingerprint(ships(spark, 0, 600)).first())
    assert rows(files.fingerprints("both"))["ships"] == tuple(fingerprint(ships(spark, 0, 630)).first())


def test_replaced_files_other_columns_and_empty_files_are_read_anew(spark, tmp_root):
    path = f"{tmp_root}/t"
    ships(spark, 0, 100).coalesce(1).write.parquet(path)
    ns = Namespace.from_paths(spark, {"ships": path})
    known = FileSums(spark, {"m": ns.scans()})
    fewer = FileSums(spark, {"m": ns.scans()}, known.sums, columns={"public.ships": ["id", "name"]})
    assert len(fewer.read) == 1
    assert rows(fewer.fingerprints("m"))["ships"] == tuple(fingerprint(ns.tables["public.ships"], ["id", "name"]).first())
    ships(spark, 0, 101).coalesce(1).write.mode("overwrite").parquet(path)
    ns = Namespace.from_paths(spark, {"ships": path})
    assert len(FileSums(spark, {"m": ns.scans()}, known.sums).read) == 1
    ships(spark, 0, 0).coalesce(1).write.parquet(f"{tmp_root}/empty")
    ns = Namespace.from_paths(spark, {"none": f"{tmp_root}/empty"})
    files = FileSums(spark, {"m": ns.scans()})
    assert rows(files.fingerprints("m")) == {"none": tuple(fingerprint(ships(spark, 0, 0)).first())}
    assert FileSums(spark, {"m": ns.scans()}, files.sums).read == []


def test_formats_and_duplicate_rows(spark, tmp_root):
    df = ships(spark, 0, 50).unionByName(ships(spark, 0, 50))
    df.write.json(f"{tmp_root}/j")
    df.write.orc(f"{tmp_root}/o")
    ns = Namespace.from_paths(spark, {"j": f"{tmp_root}/j", "o": f"{tmp_root}/o"}, formats={"j": "json", "o": "orc"}, schemas={"j": df.schema})
    got = rows(FileSums(spark, {"m": ns.scans()}).fingerprints("m"))
    assert got["j"] == got["o"] == tuple(fingerprint(df).first())


def test_a_file_of_both_sides_is_read_once_and_a_copy_is_known(spark, tmp_root):
    tables = {"ships": ships(spark, 0, 300), "crew": ships(spark, 0, 40)}
    proof = copy_namespace(tables, f"{tmp_root}/main", specs=SPECS)
    assert all(r.copied_ok for r in proof.collect())
    main = Namespace.load(spark, f"{tmp_root}/main")
    ships(spark, 300, 310).coalesce(1).write.parquet(f"{tmp_root}/more")
    branch = Namespace.from_paths(spark, {"ships": [*main.paths["public.ships"], f"{tmp_root}/more"], "crew": main.paths["public.crew"]}, SPECS)
    a, b, files = side_fingerprints(main, branch, main.tables)
    assert len(files.read) == 1 and "/more/" in files.read[0]
    assert rows(a) == rows(fingerprint_all(main.tables)) and rows(b) == rows(fingerprint_all(branch.tables))
    # a bare frame on one side is scanned
    a, b, files = side_fingerprints(main, Namespace({"public.ships": ships(spark, 0, 300)}), main.tables)
    assert files.read == [] and rows(b)["ships"] == rows(a)["ships"]


def test_merge_keeps_what_is_known(spark, tmp_root):
    copy_namespace({"ships": ships(spark, 0, 300), "crew": ships(spark, 0, 40)}, f"{tmp_root}/main", specs=SPECS)
    main = Namespace.load(spark, f"{tmp_root}/main")
    base = take_snapshot(main.tables, main.specs)
    ships(spark, 300, 310).coalesce(1).write.parquet(f"{tmp_root}/more")
    branch = Namespace.from_paths(spark, {"ships": [*main.paths["public.ships"], f"{tmp_root}/more"], "crew": main.paths["public.crew"]}, SPECS)
    result = merge(base, main, branch, target=f"{tmp_root}/merged")
    assert result.inserted == {"public.ships": 10}
    merged = Namespace.load(spark, f"{tmp_root}/merged")
    files = FileSums(spark, {"m": merged.scans()}, merged.sums)
    assert files.read and all(".appended/" in f for f in files.read)
    changes = diff_branch(base, main, merged)[1].collect()
    assert {(r.table, r.has_change, r.curr_rows - r.base_rows) for r in changes} == {("ships", True, 10), ("crew", False, 0)}


def test_branch_point_fingerprints_travel_with_the_snapshot(spark, tmp_root):
    tables = {"ships": ships(spark, 0, 30), "crew": ships(spark, 0, 4)}
    reg, _ = registry.create_branch(registry.empty_registry(spark), "dev", tables, SPECS, f"{tmp_root}/dev")
    snap = registry.load_snapshot(reg, "dev")
    assert rows(snap.fingerprints) == rows(fingerprint_all(tables))
    bare = take_snapshot(tables, SPECS)
    assert from_json(to_json(bare)).fingerprints is None


def test_three_way_plan(spark, tmp_root):
    tables = {t: ships(spark, 0, 30) for t in ("left_alone", "main_only", "branch_only", "both", "dropped", "dropped_and_changed", "gone")}
    specs = {t: TableSpec(primary_key=["id"]) for t in tables}
    reg, _ = registry.create_branch(registry.empty_registry(spark), "dev", tables, specs, f"{tmp_root}/dev")
    snap = registry.load_snapshot(reg, "dev")
    main = {t: df for t, df in tables.items() if not t.startswith("dropped")}
    branch = {t: df for t, df in tables.items() if t != "gone"}
    main |= {t: ships(spark, 0, 33) for t in ("main_only", "both")}
    branch |= {t: ships(spark, 2, 40) for t in ("branch_only", "both", "dropped_and_changed", "new")}
    specs["new"] = specs["both"]
    got = {r.table_name: (r.status, r.changed_by, r.row_key) for r in merge(snap, main, branch, specs, specs).data_ops.collect()}
    assert {t: x[:2] for t, x in got.items()} == {"branch_only": ("ok", "branch"), "both": ("ok", "both"),
                                                  "dropped_and_changed": ("conflict", "both"), "new": ("ok", None)}
    # without fingerprints of the branch point a table that main alone changed is an operation, and its drop a conflict
    snap.fingerprints = None
    got = {r.table_name: r.status for r in merge(snap, main, branch, specs, specs).data_ops.collect()}
    assert got == {"branch_only": "ok", "both": "ok", "main_only": "ok", "dropped": "conflict", "dropped_and_changed": "conflict", "new": "ok"}


def test_catalog_namespace(spark, tmp_root):
    spark.sql(f"CREATE DATABASE harbour LOCATION '{tmp_root}/db'")
    ships(spark, 0, 20).write.parquet(f"{tmp_root}/ships")
    spark.sql(f"CREATE TABLE harbour.ships USING parquet LOCATION '{tmp_root}/ships'")
    ships(spark, 0, 20).withColumn("dock", F.col("id") % 3).write.partitionBy("dock").saveAsTable("harbour.visits")
    spark.sql("CREATE VIEW harbour.big AS SELECT * FROM harbour.ships WHERE load > 3")
    ns = Namespace.from_catalog(spark, "harbour", {"harbour.ships": TableSpec(primary_key=["id"])})
    assert sorted(ns.tables) == ["harbour.ships", "harbour.visits"] and list(ns.paths) == ["harbour.ships"]
    cols = {(r.table, r.name) for r in take_snapshot(ns.tables, ns.specs).columns.collect()}
    assert ("visits", "dock") in cols and len(cols) == 7
    got = rows(side_fingerprints(ns, ns, ns.tables)[0])
    assert got == rows(fingerprint_all(ns.tables)) and got["visits"][0] == 20
    with pytest.raises(Exception, match="(?i)schema"):
        Namespace.from_catalog(spark, "no_such_place")
    spark.sql("DROP DATABASE harbour CASCADE")
