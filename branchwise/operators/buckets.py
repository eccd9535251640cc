"""Localised differences: a tree of bucket sums by key, and joins over the buckets that differ only.

A row's bucket is the top ``LEAF_BITS`` bits of its key's hash; a bucket's sum is the sum of its rows' hashes, as in a
fingerprint, so the sums of a node's children add up to its own. ``leaves`` sums a table's leaf buckets in one scan
that pre-aggregates per task, ``tree`` adds the levels above, and ``differing`` goes down from the top, looking only at children of
nodes that differ. A tree has at most 70,000 rows whatever the table's size; stored (``write_tree``) it stands for the table until the table
changes, so neither side need be scanned to see where they differ.

``new_rows`` and ``row_changes`` then shuffle only the rows of differing buckets; the list of these (at most 2**LEAF_BITS
numbers) is broadcast. Equal sums of a bucket are taken for equal rows, as equal fingerprints are.

NULL key parts are values like others. Duplicate keys and rows count. Both sides' key columns must have one type.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.rowtext import row_hash
from ..session import scratch_path
from . import rows as R
from .fingerprint import _LIMBS, limb_columns, union_all

LEAF_BITS = 16
#: Bits of the nodes of each level; the last ones are the leaves.
LEVELS = (4, 8, 12, LEAF_BITS)

_SUMS = ("row_count", *_LIMBS)


def leaf_of(keys: Sequence[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.col(R._q(k)) for k in keys]), 64 - LEAF_BITS).cast("int")


def leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """DF[leaf, row_count, limb sums] over ``columns`` (all by default); empty buckets have no row."""
    if not keys:
        raise ValueError("buckets need key columns")
    hashed = df.select(leaf_of(keys).alias("leaf"), row_hash(df, list(columns) if columns is not None else None).alias("_h"))
    return hashed.select("leaf", *limb_columns(F.col("_h"))).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(n).alias(n) for n in _LIMBS])


def tree(leaf_sums: DataFrame) -> DataFrame:
    """DF[bits, node, row_count, limb sums]: all levels over the leaves."""
    out = []
    for bits in LEVELS:
        node = F.shiftright(F.col("leaf"), LEAF_BITS - bits)
        out.append(leaf_sums.groupBy(node.alias("node")).agg(*[F.sum(c).alias(c) for c in _SUMS]).select(
            F.lit(bits).alias("bits"), "node", *_SUMS))
    return union_all(out)


def write_tree(df: DataFrame, keys: Sequence[str], path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The tree of ``df``, written to a fresh folder and read back; the leaves are summed once."""
    sums = leaves(df, keys, columns)
    sums.write.mode("errorifexists").parquet(f"{path}/leaves")
    spark = df.sparkSession
    tree(spark.read.schema(sums.schema).parquet(f"{path}/leaves")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/tree")
    return read_tree(spark, path)


def read_tree(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree")


def _own_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    return write_tree(df, keys, scratch_path(df.sparkSession, "tree"), columns)


def differing(a: DataFrame, b: DataFrame, seen: list[int] | None = None) -> DataFrame:
    """DF[leaf]: leaves in which two trees differ. Ends at the first level without a difference; ``seen`` collects how many nodes of
    each level were compared.
    """
    def level(t, bits):
        return t.where(F.col("bits") == bits).select("node", F.struct(*_SUMS).alias("s"))

    above, found = None, None
    for bits in LEVELS:
        left, right = level(a, bits), level(b, bits)
        if above is not None:
            parent = F.shiftright(F.col("node"), bits - above[0])
            left, right = (x.join(F.broadcast(above[1].withColumnRenamed("node", "up")), parent == F.col("up"), "left_semi") for x in (left, right))
        both = left.withColumnRenamed("s", "l").join(right.withColumnRenamed("s", "r"), "node", "full_outer")
        if seen is not None:
            seen.append(both.count())
        found = both.where(~F.col("l").eqNullSafe(F.col("r"))).select("node")
        nodes = found.collect()  # at most 2**bits numbers
        found = _nodes(a, [r.node for r in nodes])
        if not nodes:
            break
        above = (bits, found)
    return found.withColumnRenamed("node", "leaf")


def _nodes(like: DataFrame, nodes: list[int]) -> DataFrame:
    return local_frame(like.sparkSession, [(n,) for n in nodes], "node int")


def within(df: DataFrame, keys: Sequence[str], leaf_list: DataFrame) -> DataFrame:
    """Rows of ``df`` in the listed leaves; the list is broadcast, ``df`` isn't shuffled."""
    listed = F.broadcast(leaf_list.select(F.col("leaf").alias("__leaf")))
    return df.join(listed, leaf_of(keys) == F.col("__leaf"), "left_semi")


def new_rows(branch: DataFrame, main: DataFrame, pk: Sequence[str], branch_tree: DataFrame | None = None,
             main_tree: DataFrame | None = None) -> DataFrame:
    """What ``rows.new_rows`` returns, joining only buckets whose keys differ. Trees, if given, are over the key columns."""
    a = _own_tree(branch, pk, pk) if branch_tree is None else branch_tree
    b = _own_tree(main, pk, pk) if main_tree is None else main_tree
    found = differing(a, b)
    return R.new_rows(within(branch, pk, found), within(main.select(*[R._q(k) for k in pk]), pk, found), list(pk))


def row_changes(base: DataFrame, current: DataFrame, pk: Sequence[str], base_tree: DataFrame | None = None,
                current_tree: DataFrame | None = None) -> DataFrame:
    """DF[key columns, change]: ``added``, ``removed`` or ``modified`` rows between two tables with the same columns and unique keys.

    Trees, if given, are over all columns. Only rows of differing buckets are read for more than their sums.
    """
    a = _own_tree(base, pk) if base_tree is None else base_tree
    b = _own_tree(current, pk) if current_tree is None else current_tree
    found = differing(a, b)
    sides = []
    for df, name in ((within(base, pk, found), "b"), (within(current, pk, found), "c")):
        sides.append(df.select(*[F.col(R._q(k)).alias(f"__{name}{i}") for i, k in enumerate(pk)], row_hash(df).alias(f"__{name}")))
    on = reduce(lambda x, y: x & y, [F.col(f"__b{i}").eqNullSafe(F.col(f"__c{i}")) for i in range(len(pk))])
    both = sides[0].join(sides[1], on, "full_outer").where(~F.col("__b").eqNullSafe(F.col("__c")))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__c").isNull(), "removed").otherwise("modified")
    key = [F.when(F.col("__b").isNull(), F.col(f"__c{i}")).otherwise(F.col(f"__b{i}")).alias(k) for i, k in enumerate(pk)]
    return both.select(*key, change.alias("change"))
