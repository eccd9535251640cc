import random

import pytest
from pyspark.sql import functions as F

from branchwise.operators import clustered as C
from branchwise.operators import changelog
from branchwise.operators.filesums import FileSums
from branchwise.operators.fingerprint import fingerprint_all
from branchwise.operators.rows import new_rows
from branchwise.plans.early import first_conflict, first_difference
from branchwise.plans.levels import apply_levels
from branchwise.plans.merge import MergeCheckError, merge
from branchwise.sources.namespace import Namespace
from branchwise.sources.snapshot import take_snapshot
from branchwise.sources.spec import ForeignKey, TableSpec
from branchwise.streaming.logtail import compact_newest, newest, read_newest, tail_newest


def rows_read(df):
    """Rows that the one scan of ``df`` hands on, after files and row groups are pruned."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def keyed(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"), F.concat(F.lit("v"), F.col("id")).alias("v"))


def test_ranges_join_and_stay_few():
    assert C.join_ranges([], 4) == [] and C.join_ranges([(5, 9), (1, 3), (2, 6)], 4) == [(1, 9)]
    rnd = random.Random(1)
    for _ in range(100):
        ranges = [(a, a + rnd.randint(0, 5)) for a in (rnd.randint(0, 200) for _ in range(rnd.randint(1, 60)))]
        out = C.join_ranges(ranges, 8)
        assert len(out) <= 8 and out == sorted(out) and all(any(x <= a and b <= y for x, y in out) for a, b in ranges)


def test_anti_join_reads_only_the_ranges_it_needs(spark, tmp_root):
    C.clustered(keyed(spark, 0, 8000), ["k"], 16).write.parquet(f"{tmp_root}/main")
    main = spark.read.parquet(f"{tmp_root}/main")
    C.clustered(keyed(spark, 7000, 9000).where("k % 3 = 0"), ["k"], 4).write.parquet(f"{tmp_root}/branch")
    keyed(spark, 100, 140).coalesce(1).write.mode("append").parquet(f"{tmp_root}/branch")
    branch = spark.read.parquet(f"{tmp_root}/branch")
    assert rows_read(main) == 8000 and rows_read(C.pruned(main, branch, "k")) <= 3000
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(C.new_rows(branch, main, ["k", "j"])) == order(new_rows(branch, main, ["k", "j"]))
    nulls = branch.withColumn("k", F.when(F.col("k") % 2 == 0, F.col("k")))
    assert C.new_rows(nulls, main, ["k"]).count() == new_rows(nulls, main, ["k"]).count()
    assert C.new_rows(branch.limit(0), main, ["k"]).count() == 0 and C.new_rows(branch, main.limit(0), ["k"]).count() == branch.count()


def test_merge_writes_ranges_and_skips_rows_of_shared_files(spark, tmp_root):
    C.clustered(keyed(spark, 0, 3000), ["k"], 3).write.parquet(f"{tmp_root}/main")
    keyed(spark, 2990, 3500).coalesce(1).write.parquet(f"{tmp_root}/more")
    specs = {"t": TableSpec(primary_key=["k"])}
    main = Namespace.from_paths(spark, {"t": f"{tmp_root}/main"}, specs)
    branch = Namespace.from_paths(spark, {"t": [f"{tmp_root}/main", f"{tmp_root}/more"]}, specs)
    result = merge(take_snapshot(main.tables, specs), main, branch, target=f"{tmp_root}/merged", rows_per_file=2000)
    assert result.inserted == {"public.t": 500}
    merged = Namespace.load(spark, f"{tmp_root}/merged").tables["public.t"]
    assert sorted(r.k for r in merged.collect()) == list(range(3500))
    added = merged.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b")).where("f like '%.appended%'")
    spans = sorted((r.a, r.b) for r in added.collect())
    assert len(spans) == 4 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_a_task_writes_several_ranges_where_there_are_many(spark, tmp_root):
    specs = {"t": TableSpec(primary_key=["k"])}
    keyed(spark, 0, 2000).write.parquet(f"{tmp_root}/main")
    keyed(spark, 0, 5000).repartition(3).write.parquet(f"{tmp_root}/branch")
    main, branch = (Namespace.from_paths(spark, {"t": f"{tmp_root}/{side}"}, specs) for side in ("main", "branch"))
    merge(take_snapshot(main.tables, specs), main, branch, target=f"{tmp_root}/merged", rows_per_file=10)
    merged = Namespace.load(spark, f"{tmp_root}/merged").tables["public.t"]
    assert sorted(r.k for r in merged.collect()) == list(range(5000))
    added = merged.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).where("f like '%.appended%'").collect()
    spans = sorted((r.a, r.b) for r in added)
    assert len(spans) >= 300 and all(r.n <= 10 for r in added) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert len({r.f.rsplit("/part-", 1)[1][:5] for r in added}) <= 64  # tasks


def specs_of(edges, tables):
    out = {t: TableSpec(primary_key=["id"]) for t in tables}
    for a, b in edges:
        out[a].foreign_keys[f"{a}_{b}"] = ForeignKey([f"{b}_id"], b, ["id"])
    return out


def test_levels():
    flat = lambda levels: [[[n.split(".")[1] for n in c] for c in level] for level in levels]
    assert flat(apply_levels(specs_of([("c", "b"), ("b", "a"), ("d", "a"), ("a", "a")], "abcd"))) == [[["a"]], [["b"], ["d"]], [["c"]]]
    circle = specs_of([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("b", "e"), ("e", "gone")], "abcdef")
    assert flat(apply_levels(circle)) == [[["e"], ["f"]], [["a", "b", "c"]], [["d"]]]
    assert apply_levels({}) == []
    rnd = random.Random(2)
    for _ in range(50):
        names = [f"t{k}" for k in range(12)]
        edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(14)}
        levels = flat(apply_levels(specs_of(edges, names)))
        place = {t: (k, i) for k, level in enumerate(levels) for i, c in enumerate(level) for t in c}
        assert sorted(place) == sorted(names)
        for a, b in edges:
            assert place[b][0] < place[a][0] or place[a] == place[b]


def test_a_broken_parent_ends_the_merge_before_its_children(spark, tmp_root):
    import os

    specs = specs_of([("b", "a"), ("c", "b")], "abc")
    specs["a"].checks["a_check"] = "id < 100"
    t = lambda n, cols: spark.range(n).select("id", *[F.col("id").alias(c) for c in cols])
    main = {"a": t(3, []), "b": t(3, ["a_id"]), "c": t(3, ["b_id"])}
    branch = {"a": t(3, []).unionByName(spark.range(500, 501)), "b": t(4, ["a_id"]), "c": t(5, ["b_id"])}
    base = take_snapshot(main, specs)
    with pytest.raises(MergeCheckError, match="a_check"):
        merge(base, main, branch, specs, specs, target=f"{tmp_root}/x", by_level=True)
    assert sorted(n for n in os.listdir(f"{tmp_root}/x") if n.startswith("public")) == ["public.a"]
    with pytest.raises(MergeCheckError, match="b_a"):  # b refers to a row that a lacks; c isn't written
        merge(base, main, branch | {"a": main["a"]}, specs, specs, target=f"{tmp_root}/y", by_level=True)
    assert "public.c" not in os.listdir(f"{tmp_root}/y")
    good = {"a": t(6, []), "b": t(5, ["a_id"]), "c": t(4, ["b_id"])}
    assert merge(base, main, good, specs, specs, target=f"{tmp_root}/z", by_level=True).inserted == {"public.a": 3, "public.b": 2, "public.c": 1}


def test_first_difference_reads_no_more_than_it_must(spark, tmp_root):
    def namespace(name, edited=()):
        for t, n in (("big", 4000), ("mid", 400), ("tiny", 4)):
            df = keyed(spark, 0, n)
            df = df.withColumn("v", F.when(F.col("k") == 1, "edited").otherwise(F.col("v"))) if t in edited else df
            df.coalesce(2).write.parquet(f"{tmp_root}/{name}/{t}")
        return Namespace.from_paths(spark, {t: f"{tmp_root}/{name}/{t}" for t in ("big", "mid", "tiny")})

    main, same, tiny, two = namespace("main"), namespace("same"), namespace("tiny", ["tiny"]), namespace("two", ["mid", "big"])
    whole = len(FileSums(spark, {"a": main.scans(), "b": two.scans()}).read)
    read = []
    assert first_difference(main, tiny, read=read) == "public.tiny" and 0 < len(read) < whole and all("/tiny" in f for f in read)
    read = []
    assert first_difference(main, two, read=read) == "public.mid" and 0 < len(read) < whole and not any("/big" in f for f in read)
    assert first_difference(main, main, read=read) is None and first_difference(main, same) is None
    read = []
    fewer = Namespace.from_paths(spark, {"big": f"{tmp_root}/main/mid", "mid": f"{tmp_root}/main/mid", "tiny": f"{tmp_root}/main/tiny"})
    assert first_difference(main, fewer, read=read) == "public.big" and read == []  # counts tell
    assert first_difference(main, {"public.big": main.tables["public.big"]}) == "public.mid"
    base = fingerprint_all(main.tables)
    assert first_conflict(base, main, two) is None
    other = namespace("other", ["mid"])
    other.tables["public.mid"] = keyed(spark, 0, 401)
    other.paths.pop("public.mid")
    read = []
    assert first_conflict(base, other, two, read=read) == "public.mid" and not any("/big" in f for f in read)


def test_newest_tail_gives_the_batch_result_whatever_the_order(spark, tmp_root):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), k, None, "T", "table", "s", rnd.choice(["x", "y", "z", None]), f"c{k}") for k in range(60)]
    log = spark.createDataFrame(rows, changelog.LOG_SCHEMA)
    parts = list(range(6))
    rnd.shuffle(parts)  # files come in any order
    want = sorted(tuple(r) for r in newest(log).collect())

    def tail():
        tail_newest(spark, f"{tmp_root}/log", f"{tmp_root}/out", f"{tmp_root}/ckpt", files_per_batch=1).awaitTermination(120)
        return sorted(tuple(r) for r in read_newest(spark, f"{tmp_root}/out").collect())

    for n, k in enumerate(parts):
        log.where(F.col("id") % 6 == k).coalesce(1).write.mode("append").parquet(f"{tmp_root}/log")
        if n in (1, 5):
            got = tail()
    assert got == want and tail() == want
    # a replayed epoch and an older one change nothing
    epochs = [r.epoch for r in spark.read.parquet(f"{tmp_root}/out").select("epoch").distinct().collect()]
    first = spark.read.parquet(f"{tmp_root}/out/epoch={min(epochs)}")
    first.write.parquet(f"{tmp_root}/out/epoch=99")
    assert sorted(tuple(r) for r in read_newest(spark, f"{tmp_root}/out").collect()) == want
    assert sorted(tuple(r) for r in compact_newest(spark, f"{tmp_root}/out", f"{tmp_root}/small").collect()) == want
