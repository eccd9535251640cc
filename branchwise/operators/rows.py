"""Key-based append merge: branch rows whose key main lacks, and the merged table.

``new_rows`` is a left anti join on the key tuple with NULL-safe equality (a NULL key part
equals a NULL key part, as keys compared by value text do). Only the key columns of main are
read. Catalyst plans it as a sort-merge or shuffled hash join on the key (broadcast only
when main's key set is under the broadcast threshold by Spark's own size estimate), and
adaptive execution splits a skewed branch-side key partition.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key_names(n: int) -> list[str]:
    return [f"__main_key_{i}" for i in range(n)]


def new_rows(branch: DataFrame, main: DataFrame, pk: list[str]) -> DataFrame:
    """Rows of ``branch`` whose key tuple does not occur in ``main``."""
    if not pk:
        raise ValueError("new_rows needs key columns")
    names = _key_names(len(pk))
    keys = main.select(*[F.col(_q(k)).alias(n) for k, n in zip(pk, names)])
    cond = reduce(lambda a, b: a & b, [branch[_q(k)].eqNullSafe(keys[n]) for k, n in zip(pk, names)])
    return branch.join(keys, cond, "left_anti")


def align(df: DataFrame, schema: T.StructType, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones get their default or NULL."""
    have = set(df.columns)
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(_q(f.name))
            cols.append((c if df.schema[f.name].dataType == f.dataType else c.cast(f.dataType)).alias(f.name))
        elif f.name in defaults and defaults[f.name] is not None:
            cols.append(F.expr(defaults[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def merge_rows(main: DataFrame, branch: DataFrame, pk: list[str],
               defaults: Mapping[str, str] | None = None) -> DataFrame:
    """main ∪ (branch rows with a key main lacks), in main's schema. Updates and deletes made on
    the branch are not merged: for a key on both sides main's row stays."""
    return main.unionByName(new_rows(align(branch, main.schema, defaults), main, pk))


def inserted_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """DF[table, inserted] for ``{name: (branch, main, pk)}``, as one job."""
    parts = [new_rows(b, m, pk).agg(F.count(F.lit(1)).alias("inserted")).select(F.lit(n).alias("table"), "inserted")
             for n, (b, m, pk) in sorted(pairs.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
