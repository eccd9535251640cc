import pytest
from pyspark.sql import functions as F

from branchwise.operators import buckets as B
from branchwise.operators.fingerprint import _LIMBS
from branchwise.operators.rows import new_rows


def table(spark, n, seed=0):
    return spark.range(n).select((F.col("id") % 977).alias("a"), F.when(F.col("id") % 50 != 7, F.col("id")).alias("b"),
                                 F.concat(F.lit("v"), F.col("id") + seed).alias("v"))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_new_rows_are_those_of_the_plain_join(spark):
    main, branch = table(spark, 3000).where("b is null or b % 11 <> 3"), table(spark, 3100, 5)
    assert found(B.new_rows(branch, main, ["a", "b"])) == found(new_rows(branch, main, ["a", "b"]))
    assert found(B.new_rows(main, main, ["a", "b"])) == []
    empty = main.where("a < 0")
    assert B.new_rows(branch, empty, ["b"]).count() == branch.count() and B.new_rows(empty, main, ["b"]).count() == 0


def test_descent_looks_only_below_differing_nodes_and_joins_only_their_rows(spark, tmp_root):
    main = table(spark, 20_000).where("b is not null")
    branch = main.unionByName(spark.createDataFrame([(1, 10**9, "new"), (2, 10**9 + 1, "newer")], "a long, b long, v string"))
    trees = [B.write_tree(df, ["a", "b"], f"{tmp_root}/{k}", ["a", "b"]) for k, df in enumerate((main, branch))]
    seen = []
    leaves = B.differing(*trees, seen)
    assert leaves.count() == 2 and seen[0] == 16 and all(n <= 32 for n in seen[1:])
    assert B.within(main, ["a", "b"], leaves).count() < 20
    got = B.new_rows(branch, main, ["a", "b"], trees[1], trees[0])
    assert found(got) == [(1, 10**9, "new"), (2, 10**9 + 1, "newer")]
    plan = got._jdf.queryExecution().toString()
    assert plan.count("BroadcastHashJoin") >= 2  # the leaf list goes to the rows, not the rows to a shuffle
    seen = []
    assert B.differing(trees[0], trees[0], seen).count() == 0 and seen == [16]


def test_levels_add_up(spark):
    sums = B.leaves(table(spark, 500), ["a"])
    totals = {r.bits: tuple(r)[1:] for r in B.tree(sums).groupBy("bits").agg(*[F.sum(c) for c in ("row_count", *_LIMBS)]).collect()}
    assert sorted(totals) == sorted(B.LEVELS) and len(set(totals.values())) == 1
    with pytest.raises(ValueError):
        B.leaves(table(spark, 5), [])


def test_row_changes(spark):
    base = table(spark, 2000).where("b is not null")
    now = base.where("b % 100 <> 1").withColumn("v", F.when(F.col("b") % 100 == 2, "edited").otherwise(F.col("v")))
    now = now.unionByName(spark.createDataFrame([(5, 10**9, "x"), (5, None, "y")], "a long, b long, v string"))
    got = {(r.a, r.b): r.change for r in B.row_changes(base, now, ["a", "b"]).collect()}
    ids = [r.b for r in base.collect()]
    want = {(b % 977, b): "removed" for b in ids if b % 100 == 1} | {(b % 977, b): "modified" for b in ids if b % 100 == 2}
    assert got == want | {(5, 10**9): "added", (5, None): "added"}
